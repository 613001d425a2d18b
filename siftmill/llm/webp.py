"""Lossless WebP: a reader of the whole format, and a writer that uses palettes, predictors, cross-colour, back-references, a colour cache and prefix codes.

The reader decodes prefix codes by tables, follows back-references, keeps the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms.  The writer takes a palette where an image has few colours.  Any other
image gets predictors and cross-colour elements by tile, whichever leave the least entropy.  Samples of one channel can also be
written as a palette with codes of one length; where all codes have one length, the reader takes an image's pixels at once.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_left
from functools import cached_property, lru_cache

import numpy as np

# Fixed values of the format: the order in which lengths of code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (x, y) of the 120 nearest pixels that short distance codes stand for.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MOST = 1 << 14  # pixels on a side


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        #: At each byte the 64 bits from there on.
        padded = np.frombuffer(data + bytes(16), dtype=np.uint8)
        self.numbers = np.lib.stride_tricks.as_strided(padded, shape=(len(data) + 8, 8), strides=(1, 1)).copy().view("<u8").reshape(-1)

    @cached_property
    def words(self) -> list[int]:
        return self.numbers.tolist()

    def ahead(self) -> int:
        """At least 57 bits from here on, or zeros."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        """The next n bits, at most 32."""
        first, self.at = self.at, self.at + n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends too soon")
        return int.from_bytes(self.data[first >> 3 : (first >> 3) + 8], "little") >> (first & 7) & ((1 << n) - 1)


_REVERSED: dict[int, np.ndarray] = {}


def reversed_bits(n: int) -> np.ndarray:
    """Numbers of n bits with their bits in reverse order."""
    if n not in _REVERSED:
        x, out = np.arange(1 << n), np.zeros(1 << n, dtype=np.int64)
        for k in range(n):
            out |= (x >> k & 1) << (n - 1 - k)
        _REVERSED[n] = out
    return _REVERSED[n]


def reversed_list(n: int, held: dict[int, list[int]] = {}) -> list[int]:  # noqa: B006
    if n not in held:
        held[n] = reversed_bits(n).tolist()
    return held[n]


class Code:
    """A canonical prefix code as a table: for the next ``wide`` bits the symbol times 16 plus its length."""

    def __init__(self, lengths: dict[int, int]):
        """Lengths of the symbols that have one."""
        self.lengths = lengths
        self.wide = max(lengths.values()) if len(lengths) > 1 else 0
        self.mask = (1 << self.wide) - 1
        if self.wide and sum([1 << (self.wide - n) for n in lengths.values()]) != 1 << self.wide:
            raise ValueError("a prefix code is not complete")
        #: The one length of all symbols, or None.
        self.even = self.wide if len(lengths) == 1 << self.wide and self.wide <= 8 or len(lengths) < 2 else None

    @cached_property
    def table(self) -> list[int]:
        if not self.wide:
            return [s << 4 for s in self.lengths] or [0]
        out: list[int] = []
        for x in sorted([n << 16 | s for s, n in self.lengths.items()]):
            n = x >> 16
            out += [(x & 0xFFFF) << 4 | n] * (1 << (self.wide - n))
        return [out[k] for k in reversed_list(self.wide)]

    def read(self, bits: Bits) -> int:
        entry = self.table[bits.words[bits.at >> 3] >> (bits.at & 7) & self.mask]
        bits.read(entry & 15)
        return entry >> 4


@lru_cache(maxsize=1 << 12)
def lone_code(symbol: int, size: int) -> Code:
    if symbol >= size:
        raise ValueError("no such symbol")
    return Code({symbol: 1})


def read_code(bits: Bits, size: int, last_code: Code | None = None) -> Code:
    """A prefix code; if it is the same as the one before it, that one."""
    lengths: dict[int, int] = {}
    x = bits.ahead()
    if x & 7 == 0b101:  # one symbol of eight bits
        bits.read(11)
        return lone_code(x >> 3 & 255, size)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        if max(lengths) >= size:
            raise ValueError("no such symbol")
        return Code(lengths)
    own = {}
    for k in range(bits.read(4) + 4):
        if n := bits.read(3):
            own[LENGTH_ORDER[k]] = n
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    symbol, last = 0, 8
    if not code.wide and (n := code.table[0] >> 4) < 16:  # one length for all
        return Code(dict.fromkeys(range(min(size, left)), n) if n else {})
    words, at, table, mask = bits.words, bits.at, code.table, code.mask
    while symbol < size and left:
        left -= 1
        x = words[at >> 3] >> (at & 7)
        entry = table[x & mask]
        n, used = entry >> 4, entry & 15
        if n < 16:
            at += used
            if n:
                lengths[symbol] = last = n
            symbol += 1
            continue
        x >>= used
        if n == 16:
            times, used = 3 + (x & 3), used + 2
            lengths.update(dict.fromkeys(range(symbol, symbol + times), last))
        else:
            times, used = (3 + (x & 7), used + 3) if n == 17 else (11 + (x & 127), used + 7)
        at += used
        symbol += times
        if symbol > size:
            raise ValueError("too many code lengths")
    bits.at = at
    bits.read(0)
    return last_code if last_code is not None and last_code.lengths == lengths else Code(lengths)


def read_value(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix code and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers, row after row."""
    return coded_pixels(bits, *read_codes(bits, width, height, main), width, width * height)


def read_codes(bits: Bits, width: int, height: int, main: bool) -> tuple[list[list[Code]], list[int] | None, int, int]:
    """What stands before an image's pixels: its codes, the group of each tile if there are several, the size of tiles and the bits of the colour cache."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tile = None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        groups = (read_pixels(bits, (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile, False) >> 8 & 0xFFFF).tolist()
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = []
    for _ in range(max(groups) + 1 if groups else 1):
        own: list[Code] = []
        for n in sizes:
            own.append(read_code(bits, n, own[-1] if own else None))
        codes.append(own)
    return codes, groups, tile, cache_bits


def alike(codes: list[list[Code]], groups: list[int] | None, cache_bits: int) -> bool:
    """Whether an image has literals alone, all with as many bits."""
    return groups is None and not cache_bits and all(c.even is not None for c in codes[0][:4]) and max(codes[0][0].lengths, default=0) < 256


def coded_pixels(bits: Bits, codes: list[list[Code]], groups: list[int] | None, tile: int, cache_bits: int, width: int, total: int) -> np.ndarray:
    if alike(codes, groups, cache_bits):
        if not any(c.even for c in codes[0][:4]):
            return np.full(total, sum(next(iter(c.lengths), 0) << shift for c, shift in zip(codes[0], (8, 16, 0, 24), strict=False)), dtype=np.uint32)
        return _decoded_even(bits, codes[0], total)
    try:
        return np.asarray(_decoded(bits, codes, groups, tile, cache_bits, width, total), dtype=np.uint32)
    except IndexError:
        raise ValueError("the stream ends too soon") from None


def _decoded_even(bits: Bits, codes: list[Code], n: int) -> np.ndarray:
    """Literals alone, with codes of one length for each channel."""
    sizes = [c.even for c in codes[:4]]
    each = sum(sizes)
    first, bits.at = bits.at, bits.at + n * each
    bits.read(0)
    raw = np.unpackbits(np.frombuffer(bits.data, dtype=np.uint8)[first >> 3 : (bits.at + 7) >> 3], bitorder="little")[first & 7 :][: n * each].reshape(n, each)
    argb, at = np.zeros(n, dtype=np.uint32), 0
    for code, size, shift in zip(codes, sizes, (8, 16, 0, 24), strict=False):
        symbols = np.array(sorted(code.lengths) or [0], dtype=np.uint32) << np.uint32(shift)
        padded = np.zeros((n, 8), dtype=np.uint8)
        padded[:, 8 - size :] = raw[:, at : at + size]
        argb |= symbols[np.packbits(padded)] if size else symbols[0]
        at += size
    return argb


def _decoded(bits: Bits, codes: list[list[Code]], groups: list[int] | None, tile: int, cache_bits: int, width: int, total: int, before: list[int] | None = None, cache: list[int] | None = None) -> list[int]:
    """All pixels; those ``before`` are known already, and so is the colour cache behind them."""
    out, done, across = [*(before or ()), *[0] * (total - len(before or ()))], len(before or ()), (width + (1 << tile) - 1) >> tile
    cache, shift = cache or [0] * (1 << cache_bits), 32 - cache_bits
    words, at = bits.words, bits.at
    code, last = codes[0], None
    while done < total:
        if groups:
            code = codes[groups[(done // width >> tile) * across + (done % width >> tile)]]
        if code is not last:
            last = code
            green, red, blue, alpha, distance = code
            greens, green_mask, reds, red_mask, blues, blue_mask = green.table, green.mask, red.table, red.mask, blue.table, blue.mask
            alphas, alpha_mask = alpha.table, alpha.mask
            alone = not (red_mask or blue_mask or alpha_mask)  # only green takes bits
            base = alphas[0] << 20 | (reds[0] >> 4) << 16 | blues[0] >> 4 if alone else alphas[0] << 20
        x = words[at >> 3] >> (at & 7)
        entry = greens[x & green_mask]
        n, s = entry & 15, entry >> 4
        if s < 256:
            if alone:
                at += n
                argb = base | s << 8
            else:
                x >>= n
                r = reds[x & red_mask]
                x >>= r & 15
                b = blues[x & blue_mask]
                at += n + (r & 15) + (b & 15)
                argb = (r >> 4) << 16 | s << 8 | b >> 4
                if alpha_mask:
                    a = alphas[words[at >> 3] >> (at & 7) & alpha_mask]
                    at += a & 15
                    argb |= (a >> 4) << 24
                else:
                    argb |= base
            out[done] = argb
            if cache_bits:
                cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> shift] = argb
            done += 1
        elif s < 280:
            bits.at = at + n
            n = read_value(bits, s - 256)
            d = read_value(bits, distance.read(bits))
            at = bits.at
            d = max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width) if d <= 120 else d - 120
            if d > done or done + n > total:
                raise ValueError("a back-reference leaves the image")
            part = out[done - d : done - d + n] if d >= n else (out[done - d : done] * (n // d + 1))[:n]
            out[done : done + n] = part
            if cache_bits:
                for argb in part:
                    cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> shift] = argb
            done += n
        else:
            at += n
            out[done] = argb = cache[s - 280]
            cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> shift] = argb
            done += 1
    bits.at = at
    bits.read(0)
    return out


def _mean(a: int, b: int) -> int:
    return (a + b) >> 1


def _one(mode: int, left: list[int], top: list[int], right: list[int], corner: list[int]) -> list[int]:
    """What a mode that looks at the pixel to the left predicts."""
    if mode == 11:
        nearer = sum(abs(t - c) - abs(p - c) for p, t, c in zip(left, top, corner, strict=True)) < 0
        return left if nearer else top
    out = []
    for p, t, r, c in zip(left, top, right, corner, strict=True):
        if mode == 5:
            v = _mean(_mean(p, r), t)
        elif mode == 6:
            v = _mean(p, c)
        elif mode == 7:
            v = _mean(p, t)
        elif mode == 10:
            v = _mean(_mean(p, c), _mean(t, r))
        elif mode == 12:
            v = max(0, min(255, p + t - c))
        else:
            m = _mean(p, t)
            v = max(0, min(255, m + int((m - c) / 2)))
        out.append(v)
    return out


def undo_predictor(argb: np.ndarray, width: int, height: int, tile: int, modes: np.ndarray) -> np.ndarray:
    """Add to each pixel what its tile's mode predicts from the pixels before it.

    Where a row of tiles has one mode that predicts a constant, the pixel to the left or the one above, it is undone as a
    whole; other rows go run by run, and pixel by pixel only for modes that mix the pixel to the left with others."""
    c = argb.astype("<u4").view(np.uint8).reshape(height, width, 4)
    across = (width + (1 << tile) - 1) >> tile
    mode = (modes >> 8 & 15).reshape(-1, across)
    c[0, 0, 3] = (int(c[0, 0, 3]) + 255) & 255
    c[0] = np.cumsum(c[0], axis=0, dtype=np.uint8)
    for band in range((height + (1 << tile) - 1) >> tile):
        first, last = max(1, band << tile), min(height, (band + 1) << tile)
        if first >= last:
            continue
        kinds = set(mode[band].tolist())
        block = c[first:last]
        block[:, 0] = np.cumsum(np.concatenate([c[first - 1 : first, 0], block[:, 0]]), axis=0, dtype=np.uint8)[1:]
        if kinds <= {0, 14, 15}:
            block[:, 1:, 3] += 255
        elif kinds == {1}:
            block[:] = np.cumsum(block, axis=1, dtype=np.uint8)
        elif kinds == {2}:
            block[:, 1:] = np.cumsum(np.concatenate([c[first - 1 : first, 1:], block[:, 1:]]), axis=0, dtype=np.uint8)[1:]
        else:
            for y in range(first, last):
                _undo_row(c, y, width, tile, mode[band].tolist())
    return c.view("<u4").reshape(-1).astype(np.uint32)


def _undo_row(c: np.ndarray, y: int, width: int, tile: int, modes: list[int]) -> None:
    """Undo one row of which the first pixel is known."""
    row, up = c[y], c[y - 1]
    right = np.concatenate([up[1:], row[:1]])
    for k, mode in enumerate(modes):
        a, b = max(1, k << tile), min(width, (k + 1) << tile)
        if a >= b:
            continue
        if mode in (0, 14, 15):
            row[a:b, 3] += 255
        elif mode == 1:
            row[a:b] = np.cumsum(row[a - 1 : b], axis=0, dtype=np.uint8)[1:]
        elif mode in (2, 3, 4):
            row[a:b] += (up[a:b], right[a:b], up[a - 1 : b - 1])[mode - 2]
        elif mode in (8, 9):
            other = up[a - 1 : b - 1] if mode == 8 else right[a:b]
            row[a:b] += ((up[a:b].astype(np.uint16) + other) >> 1).astype(np.uint8)
        else:
            above, behind, out = up[a - 1 : b].tolist(), right[a:b].tolist(), row[a - 1 : b].tolist()
            for x in range(1, b - a + 1):
                p = _one(mode, out[x - 1], above[x], behind[x - 1], above[x - 1])
                out[x] = [(v + w) & 255 for v, w in zip(out[x], p, strict=True)]
            row[a - 1 : b] = out


def undo_cross_colour(argb: np.ndarray, width: int, height: int, tile: int, elements: np.ndarray) -> np.ndarray:
    across = (width + (1 << tile) - 1) >> tile
    e = np.repeat(np.repeat(elements.reshape(-1, across), 1 << tile, axis=0)[:height], 1 << tile, axis=1)[:, :width].reshape(-1)
    signed = lambda x: (x & 0xFF).astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(argb >> 8)
    red = ((argb >> 16 & 0xFF).astype(np.int32) + (signed(e) * green >> 5)) & 0xFF
    blue = ((argb & 0xFF).astype(np.int32) + (signed(e >> 8) * green >> 5) + (signed(e >> 16) * signed(red.astype(np.uint32)) >> 5)) & 0xFF
    return argb & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def add_channels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype("<u4").view(np.uint8) + b.astype("<u4").view(np.uint8)).view("<u4").astype(np.uint32)


def packed_bits(colours: int) -> int:
    """Palette indices are bundled, 2 to this power of them in a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(argb: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    index, bundle = (argb >> 8 & 0xFF).astype(np.uint8), packed_bits(len(palette))
    if bundle:
        each = 8 >> bundle
        index = (index.reshape(height, -1, 1) >> (np.arange(1 << bundle, dtype=np.uint8) * each)[None, None] & ((1 << each) - 1)).reshape(height, -1)[:, :width].reshape(-1)
    full = np.zeros(256, dtype=np.uint32)
    full[: len(palette)] = palette
    return full[index]


class Opened:
    """A file up to its main image: bits, width, height, transforms (kind, width, tile, numbers), and the width of what is stored."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25 or data[20] != 0x2F:
            raise ValueError("not a lossless WebP file")
        self.bits = bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        self.transforms: list[tuple] = []
        self.seen: set[int] = set()
        self.stored, self.colours = self.width, 0

    def advance(self) -> bool:
        """Read on, up to a palette, of which the number of colours is then known, or to the main image; whether it is a palette."""
        bits, w = self.bits, self.stored
        while bits.read(1):
            kind = bits.read(2)
            if kind in self.seen:
                raise ValueError("a transform occurs twice")
            self.seen.add(kind)
            if kind in (PREDICTOR, CROSS_COLOUR):
                tile = bits.read(3) + 2
                side = lambda n: (n + (1 << tile) - 1) >> tile  # noqa: B023, E731
                self.transforms.append((kind, w, tile, read_pixels(bits, side(w), side(self.height), False)))
            elif kind == PALETTE:
                self.colours = bits.read(8) + 1
                return True
            else:
                self.transforms.append((kind, w, 0, None))
        return False

    def add_palette(self, argb: np.ndarray) -> None:
        n = self.colours
        palette = np.cumsum(argb.astype("<u4").view(np.uint8).reshape(n, 4), axis=0, dtype=np.uint8).view("<u4").reshape(-1).astype(np.uint32)
        self.transforms.append((PALETTE, self.stored, 0, palette))
        self.stored = (self.stored + (1 << packed_bits(n)) - 1) >> packed_bits(n)

    def undone(self, argb: np.ndarray) -> np.ndarray:
        """The main image after its transforms: height, width and the channels red, green, blue and alpha."""
        for kind, w, tile, x in reversed(self.transforms):
            if kind == PREDICTOR:
                argb = undo_predictor(argb, w, self.height, tile, x)
            elif kind == CROSS_COLOUR:
                argb = undo_cross_colour(argb, w, self.height, tile, x)
            elif kind == PALETTE:
                argb = undo_palette(argb, w, self.height, x)
            else:
                green = argb >> 8 & np.uint32(0xFF)
                argb = add_channels(argb, green << np.uint32(16) | green)
        return argb.astype("<u4").view(np.uint8).reshape(self.height, self.width, 4)[:, :, [2, 1, 0, 3]]


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file as an array of height, width and the channels red, green, blue and alpha."""
    head = Opened(data)
    while head.advance():
        head.add_palette(read_pixels(head.bits, head.colours, 1, False))
    return head.undone(read_pixels(head.bits, head.stored, head.height, True))


class Writer:
    """Bits into bytes, lowest first."""

    def __init__(self):
        self.values, self.sizes = [], []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def single(self, symbol: int) -> None:
        """A simple prefix code with one symbol, which then takes no bits."""
        self.put(0b101, 3)
        self.put(symbol, 8)

    def pair(self, low: int, high: int) -> None:
        """A simple prefix code with two symbols: a 0 stands for the lower one."""
        self.put(0b111, 3)
        self.put(low, 8)
        self.put(high, 8)

    def even(self, n: int) -> None:
        """A prefix code in which each of the symbols below 2 to the n has n bits."""
        k = max(4, LENGTH_ORDER.index(n) + 1)
        self.put(0, 1)
        self.put(k - 4, 4)
        for x in LENGTH_ORDER[:k]:
            self.put(int(x == n), 3)
        self.put(1, 1)
        self.put(3, 3)
        self.put((1 << n) - 2, 8)

    def prefix(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write a prefix code for symbols that occur so often; returns for each symbol its code, first bit lowest, and length."""
        used = np.flatnonzero(counts)
        if len(used) < 3 and (not len(used) or used[-1] < 256):
            lengths = np.zeros(len(counts), dtype=np.int64)
            if len(used) == 2:
                self.pair(int(used[0]), int(used[1]))
                lengths[used] = 1
            else:
                self.single(int(used[0]) if len(used) else 0)
            return code_words(lengths), lengths
        lengths = code_lengths(counts, 15)
        runs = run_lengths(lengths)
        own = code_lengths(np.bincount([s for s, _, _ in runs], minlength=19), 7)
        words = code_words(own)
        order = own[list(LENGTH_ORDER)]
        n = max(4, int(np.flatnonzero(order)[-1]) + 1)
        self.put(0, 1)
        self.put(n - 4, 4)
        self.values += order[:n].tolist()
        self.sizes += [3] * n
        self.put(0, 1)
        alone = np.count_nonzero(own) == 1
        words, own = words.tolist(), [0] * 19 if alone else own.tolist()
        for s, more, bits in runs:  # further bits stand behind a symbol's code
            self.values.append(words[s] | more << own[s])
            self.sizes.append(own[s] + bits)
        return code_words(lengths), lengths

    def bits(self) -> np.ndarray:
        return bits_of(np.array(self.values, dtype=np.int64), np.array(self.sizes, dtype=np.int64))


def bits_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lowest so many bits of each value, one after another."""
    index = np.repeat(np.arange(len(values)), sizes)
    place = np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (values[index] >> place & 1).astype(np.uint8)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a Huffman code of at most ``most`` bits; a lone symbol has 1.  Too long codes are made again from flatter counts."""
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), dtype=np.int64)
    weights = counts[used].tolist()
    while len(used) > 1:
        n = len(used)
        leaves = sorted(range(n), key=weights.__getitem__)
        light = [*[weights[k] for k in leaves], math.inf]
        joined, parent, i, j = [math.inf] * n, [0] * (2 * n - 1), 0, 0  # joined weights only rise: two queues stand for a heap
        for new in range(n, 2 * n - 1):
            if light[i] <= joined[j]:
                weight, parent[leaves[i]], i = light[i], new, i + 1
            else:
                weight, parent[n + j], j = joined[j], new, j + 1
            if light[i] <= joined[j]:
                weight, parent[leaves[i]], i = weight + light[i], new, i + 1
            else:
                weight, parent[n + j], j = weight + joined[j], new, j + 1
            joined[new - n] = weight
        n = 2 * n - 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        out[used] = depth[: len(used)]
        if max(depth) <= most:
            return out
        weights = [(w + 1) // 2 + 1 for w in weights]
    out[used] = 1
    return out


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, its first bit lowest."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[order]
    out = np.zeros(len(lengths), dtype=np.int64)
    if len(order):
        wide = int(sizes[-1])
        starts = np.cumsum(1 << (wide - sizes)) - (1 << (wide - sizes))
        out[order] = reversed_bits(wide)[starts % (1 << wide)]
    return out


def run_lengths(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Code lengths as symbols with their further bits and the number of these: 16 repeats the last length, 17 and 18 are runs of zeros."""
    out, last = [], 8
    starts = np.flatnonzero(np.diff(lengths, prepend=-1))
    for x, n in zip(lengths[starts].tolist(), np.diff(starts, append=len(lengths)).tolist(), strict=True):
        if x and x != last:
            out.append((x, 0, 0))
            last, n = x, n - 1
        while n > 0:
            if x == 0 and n > 10:
                k = min(n, 138)
                out.append((18, k - 11, 7))
            elif n > 2:
                k = min(n, 10 if x == 0 else 6)
                out.append((17, k - 3, 3) if x == 0 else (16, k - 3, 2))
            else:
                k = 1
                out.append((x, 0, 0))
            n -= k
    return out


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, further bits and their number for lengths and distances from 1 on."""
    x = value - 1
    high = np.maximum(np.frexp(x.astype(np.float64))[1] - 1, 1)
    extra = high - 1
    small = x < 4
    return np.where(small, x, 2 * high + (x >> extra & 1)), np.where(small, 0, x & ((1 << extra) - 1)), np.where(small, 0, extra)


#: Pixels that a copy has at least, and at most.
LEAST_COPY, MOST_COPY = 4, 4096
CACHE_BITS = 8


def copies(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and distance of copies, from left to right: at each place as long as the last occurrence of its next pixels reaches."""
    n = len(pixels) - LEAST_COPY + 1
    if n < 2:
        return []
    x = pixels.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = x[:n] * np.uint64(0x9E3779B97F4A7C15) + x[1 : n + 1] * np.uint64(0xBF58476D1CE4E5B9) + x[2 : n + 2] * np.uint64(0x94D049BB133111EB) + x[3 : n + 3] * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h, kind="stable")
    a, b = order[:-1], order[1:]
    same = h[a] == h[b]
    a, b = a[same], b[same]
    for k in range(LEAST_COPY):
        good = pixels[a + k] == pixels[b + k]
        a, b = a[good], b[good]
    if not len(b):
        return []
    far = np.zeros(n, dtype=np.int64)
    far[b] = b - a
    far[far > (1 << 20) - 120] = 0
    ends = np.append(np.flatnonzero(far[1:] != far[:-1]) + 1, n)  # of runs of one distance
    starts = np.flatnonzero(far)
    reach = (ends[np.searchsorted(ends, starts, side="right")] - starts + LEAST_COPY - 1).tolist()
    starts, far, out, at, k = starts.tolist(), far[starts].tolist(), [], 0, 0
    while True:
        k = bisect_left(starts, at, k)
        if k == len(starts):
            return out
        n = min(reach[k], MOST_COPY)
        out.append((starts[k], n, far[k]))
        at = starts[k] + n


def write_pixels(pixels: np.ndarray, main: bool) -> list[np.ndarray]:
    """An entropy-coded image of ARGB numbers as bits: literals, copies and hits in the colour cache."""
    n = len(pixels)
    if (pixels == pixels[0]).all():  # five codes of one symbol say all
        w = Writer()
        w.put(0, 2 if main else 1)
        for shift in (8, 16, 0, 24):
            w.single(int(pixels[0]) >> shift & 255)
        w.single(0)
        return [w.bits()]
    found = copies(pixels)
    literal = np.ones(n, dtype=bool)
    for a, length, _ in found:
        literal[a : a + length] = False
    cache_bits = 0
    if n >= 1 << CACHE_BITS:
        slot = ((pixels.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        a, b = order[:-1], order[1:]
        hit = np.zeros(n, dtype=bool)
        hit[b[(slot[a] == slot[b]) & (pixels[a] == pixels[b])]] = True
        hit &= literal
        if hit.sum() >= 2 * len(np.unique(slot[hit])):  # each entry in use lengthens the code of green
            cache_bits = CACHE_BITS
    w = Writer()
    w.put(1, 1) if cache_bits else w.put(0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)  # one group of prefix codes
    # tokens in order: a symbol of green each, and up to three more fields
    where = np.concatenate([np.flatnonzero(literal), np.array([a for a, _, _ in found], dtype=np.int64)])
    order = np.argsort(where, kind="stable")
    at = where[order]
    size, size_more, size_bits = prefix_of(np.array([m for _, m, _ in found], dtype=np.int64))
    far, far_more, far_bits = prefix_of(np.array([d for _, _, d in found], dtype=np.int64) + 120)
    copied = order >= len(where) - len(found)
    cached = hit[at] & ~copied if cache_bits else np.zeros(len(at), dtype=bool)
    plain = ~copied & ~cached
    p = pixels[at].astype(np.int64)
    green = p >> 8 & 255
    green[copied] = 256 + size
    if cache_bits:
        green[cached] = 280 + slot[at[cached]]
    fields = [p >> 16 & 255, p & 255, p >> 24 & 255]
    symbols = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    values, lengths = np.zeros((len(at), 4), dtype=np.int64), np.zeros((len(at), 4), dtype=np.int64)
    words, sizes = w.prefix(np.bincount(green, minlength=symbols[0]))
    values[:, 0], lengths[:, 0] = words[green], sizes[green]
    red, blue, alpha = (f[plain] for f in fields)
    mark = len(w.values)
    words, sizes = w.prefix(np.bincount(red, minlength=256) + np.bincount(blue, minlength=256))
    w.values += w.values[mark:]  # one code for both, written twice
    w.sizes += w.sizes[mark:]
    values[plain, 1], lengths[plain, 1], values[plain, 2], lengths[plain, 2] = words[red], sizes[red], words[blue], sizes[blue]
    words, sizes = w.prefix(np.bincount(alpha, minlength=256))
    values[plain, 3], lengths[plain, 3] = words[alpha], sizes[alpha]
    words, sizes = w.prefix(np.bincount(far, minlength=40))
    values[copied, 1], lengths[copied, 1] = size_more, size_bits
    values[copied, 2], lengths[copied, 2] = words[far], sizes[far]
    values[copied, 3], lengths[copied, 3] = far_more, far_bits
    return [w.bits(), bits_of(values.reshape(-1), lengths.reshape(-1))]


TILE = 6
MODES = (0, 1, 2)


_COUNTS = np.arange(1 << 14)
#: A count times its binary logarithm.
WEIGHED = _COUNTS * np.log2(np.maximum(_COUNTS, 1))


def weighed(counts: np.ndarray) -> np.ndarray:
    return WEIGHED[counts] if counts.max() < len(WEIGHED) else counts * np.log2(np.maximum(counts, 1))


@lru_cache(maxsize=64)
def _places(height: int, width: int, n: int, tile: int) -> np.ndarray:
    """256 times the number of each sample's tile and plane."""
    return (np.repeat(np.arange(height) >> tile, width * n) * n + np.tile(np.arange(n), height * width)) * 256


def tile_costs(planes: np.ndarray, tile: int) -> np.ndarray:
    """Entropy in bits of the samples (height, width, planes) of each tile; tiles take whole rows."""
    height, width, n = planes.shape
    tiles = (height + (1 << tile) - 1) >> tile
    of = (_places if height <= 64 else _places.__wrapped__)(height, width, n, tile)
    counts = np.bincount(of + planes.reshape(-1), minlength=tiles * n * 256).reshape(tiles, n, 256)
    return (weighed(counts.sum(axis=2)) - weighed(counts).sum(axis=2)).sum(axis=1)


def predicted(c: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """What is left of pixels (height, width, 4) by the mode of each tile that leaves the least, and these modes."""
    height, width, _ = c.shape
    up = np.concatenate([c[:1], c[:-1]])
    left = np.concatenate([c[:, :1], c[:, :-1]], axis=1)
    black = np.array([0, 0, 0, 255], dtype=np.uint8)
    guesses = {0: np.broadcast_to(black, c.shape), 1: left, 2: up}
    costs = np.stack([tile_costs((c - guesses[m])[:, :, :3], tile) for m in MODES])
    best = np.argmin(costs, axis=0)
    rest = np.empty_like(c)
    for t, k in enumerate(best.tolist()):
        rows = slice(t << tile, (t + 1) << tile)
        rest[rows] = c[rows] - guesses[MODES[k]][rows]
    rest[1:, 0] = c[1:, 0] - c[:-1, 0]
    rest[0, 1:] = c[0, 1:] - c[0, :-1]
    rest[0, 0] = c[0, 0] - black
    return rest, np.array(MODES, dtype=np.uint32)[best]


def crossed(c: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Take from red and blue what green tells of them in each tile, where that leaves less; and the elements of the tiles."""
    height, width, _ = c.shape
    tiles = (height + (1 << tile) - 1) >> tile
    of = np.arange(height) >> tile
    green = c[:, :, 1].view(np.int8).astype(np.int64)
    power = np.bincount(of, weights=(green * green).sum(axis=1), minlength=tiles)
    out, elements = c.copy(), np.zeros(tiles, dtype=np.uint32)
    for channel, shift in ((2, 0), (0, 8)):  # blue, green, red, alpha in memory
        own = c[:, :, channel].view(np.int8).astype(np.int64)
        slope = np.bincount(of, weights=(green * own).sum(axis=1), minlength=tiles) / np.maximum(power, 1)
        by = np.clip(np.rint(32 * slope), -128, 127).astype(np.int64)
        tried = (own - (by[of][:, None] * green >> 5)).astype(np.uint8)
        better = tile_costs(tried[:, :, None], tile) < tile_costs(c[:, :, channel : channel + 1], tile)
        rows = better[of]
        out[rows, :, channel] = tried[rows]
        elements |= np.where(better, by & 255, 0).astype(np.uint32) << np.uint32(shift)
    return out, elements


def encode(argb: np.ndarray) -> bytes:
    """A lossless WebP file of pixels (height, width) given as ARGB numbers."""
    height, width = argb.shape
    if not (0 < height <= MOST and 0 < width <= MOST):
        raise ValueError("an image has 1 to 16384 pixels on a side")
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    w.put(1, 1)
    colours, index = np.unique(argb, return_inverse=True)
    if len(colours) <= 256:
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        steps = np.diff(colours.astype("<u4").view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), dtype=np.uint8))
        body = [w.bits(), *write_pixels(np.ascontiguousarray(steps).view("<u4").reshape(-1).astype(np.uint32), False)]
        index = bundled(index.reshape(height, width).astype(np.uint8), len(colours))
        rest = np.uint32(0xFF000000) | index.astype(np.uint32).reshape(-1) << np.uint32(8)
    else:
        tile = max(TILE, (width - 1).bit_length())
        rest, modes = predicted(argb.astype("<u4").view(np.uint8).reshape(height, width, 4), tile)
        rest, elements = crossed(rest, tile)
        body = []
        for kind, tiles in ((PREDICTOR, np.uint32(0xFF000000) | modes << np.uint32(8)), (CROSS_COLOUR, np.uint32(0xFF000000) | elements)):
            w.put(kind, 2)
            w.put(tile - 2, 3)
            body += [w.bits(), *write_pixels(tiles, False)]
            w = Writer()
            if kind == PREDICTOR:
                w.put(1, 1)
        rest = np.ascontiguousarray(rest).view("<u4").reshape(-1).astype(np.uint32)
    body += [np.zeros(1, dtype=np.uint8), *write_pixels(rest, True)]  # no further transform
    return _file(body)


def bundled(index: np.ndarray, colours: int) -> np.ndarray:
    """Palette indices (height, width), of few colours several in one."""
    bundle = packed_bits(colours)
    if not bundle:
        return index
    per, each = 1 << bundle, 8 >> bundle
    index = np.pad(index, ((0, 0), (0, -index.shape[1] % per))).reshape(len(index), -1, per)
    return np.bitwise_or.reduce(index << (np.arange(per, dtype=np.uint8) * each)[None, None], axis=2)


def _file(body: list[np.ndarray]) -> bytes:
    payload = b"\x2f" + np.packbits(np.concatenate(body), bitorder="little").tobytes()
    chunk = b"VP8L" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode_grey(samples: np.ndarray) -> bytes:
    """8-bit samples (height, width), held in green: a palette of those that occur, and codes of one length."""
    height, width = samples.shape
    if not (0 < height <= MOST and 0 < width <= MOST):
        raise ValueError("an image has 1 to 16384 pixels on a side")
    values = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256)).astype(np.uint8)
    to = np.zeros(256, dtype=np.uint8)
    to[values] = np.arange(len(values), dtype=np.uint8)
    index = bundled(to[samples], len(values))
    n = int(index.max()).bit_length()
    w = Writer()
    for value, size in ((width - 1, 14), (height - 1, 14), (0, 4), (1, 1), (PALETTE, 2), (len(values) - 1, 8), (0, 1)):
        w.put(value, size)
    w.even(8)
    w.single(0)
    w.single(0)
    w.pair(0, 255)  # the first colour is opaque, and each further one adds nothing to that
    w.single(0)
    steps = np.zeros((len(values), 9), dtype=np.uint8)
    steps[:, :8] = np.unpackbits(np.diff(values, prepend=np.uint8(0)).reshape(-1, 1), axis=1)
    steps[0, 8] = 1
    main = Writer()
    main.put(0, 3)  # no further transform, no colour cache, one group of codes
    main.even(n) if n else main.single(0)
    for x in (0, 0, 255, 0):
        main.single(x)
    body = [w.bits(), steps.reshape(-1), main.bits(), np.unpackbits(index.reshape(-1, 1), axis=1)[:, 8 - n :].reshape(-1)]
    return _file(body)


def encode_rgb(samples: np.ndarray) -> bytes:
    """8-bit samples (height, width, 3) as red, green and blue."""
    x = samples.astype(np.uint32)
    return encode(np.uint32(0xFF000000) | x[:, :, 0] << np.uint32(16) | x[:, :, 1] << np.uint32(8) | x[:, :, 2])
