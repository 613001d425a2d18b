"""Many lossless WebP files at once: the same bytes as ``webp.encode`` makes one by one, and the same pixels as ``webp.decode`` reads.

What takes many small steps a file is done in one for all files.  Fields of a stream are (key, value, size): the key tells the file
and the field's place in it.  The reader goes over all files side by side, pixel by pixel; when few are left it reads these one by one.
"""

from __future__ import annotations

import struct
from bisect import bisect_left

import numpy as np

from . import webp
from .webp import CACHE_BITS, CROSS_COLOUR, LEAST_COPY, LENGTH_ORDER, MOST, MOST_COPY, PALETTE, PREDICTOR, TILE, bundled, code_lengths, prefix_of, reversed_bits, weighed

U = np.uint64
#: Sections of a file: its head, three images of 16 each, and what stands before the second and third.
SECTIONS = 64


def parts(items: list, size, many: int, most: int):
    """The items in lists of at most so many, of sizes that add up to at most ``most`` unless one alone is larger."""
    part, total = [], 0
    for item in items:
        n = size(item)
        if part and (len(part) == many or total + n > most):
            yield part
            part, total = [], 0
        part.append(item)
        total += n
    if part:
        yield part


class Fields:
    """Fields of many streams, in any order of keys."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, key, value, size) -> None:
        key = np.asarray(key, dtype=np.int64)
        self.parts.append((key, np.broadcast_to(np.asarray(value), key.shape).astype(U), np.broadcast_to(np.asarray(size, dtype=np.int64), key.shape)))

    def streams(self, n: int) -> list[bytes]:
        """The streams of n files as bytes; a field has at most 63 bits and is zero beyond its size."""
        key, value, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key.astype(np.uint16) if n * SECTIONS <= 1 << 16 else key, kind="stable")
        value, size, of = value[order], size[order], key[order] // SECTIONS
        bits = np.bincount(of, weights=size, minlength=n).astype(np.int64)
        words = bits // 64 + 2  # of each file
        first = np.cumsum(words) - words
        ends = np.cumsum(size)
        at = ends - size + (first * 64 - (np.cumsum(bits) - bits))[of]
        place, shift = at >> 6, (at & 63).astype(U)
        out = np.zeros(int(words.sum()), dtype=U)
        cut = np.flatnonzero(np.diff(place, prepend=-1))
        out[place[cut]] = np.bitwise_or.reduceat(value << shift, cut)
        over = np.flatnonzero((at & 63) + size > 64)
        out[place[over] + 1] |= value[over] >> (U(64) - shift[over])
        raw = out.astype("<u8").tobytes()
        return [raw[a : a + m] for a, m in zip((first * 8).tolist(), ((bits + 7) // 8).tolist(), strict=True)]


def all_code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """``webp.code_lengths`` of each row of counts: in each step every row joins its two lightest symbols."""
    row, symbol = np.nonzero(counts)
    n = np.bincount(row, minlength=len(counts))
    by_size = np.argsort(-n, kind="stable")
    rank = np.empty_like(by_size)
    rank[by_size] = np.arange(len(by_size))
    order = np.lexsort((counts[row, symbol], rank[row]))
    row, symbol = row[order], symbol[order]
    n, wide = n[by_size], int(n.max())
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    # of each row the weights of leaves, then those of joined symbols; both only rise
    stride, endless = 2 * wide + 2, 1 << 62
    weights = np.full((len(counts), stride), endless, dtype=np.int64)
    weights[rank[row], within] = counts[row, symbol]
    weights, parent = weights.reshape(-1), np.zeros(len(counts) * stride, dtype=np.int64)
    leaf = np.arange(len(counts)) * stride
    joined = leaf + wide + 1
    active = np.searchsorted(-n, -np.arange(2, wide + 1), side="right").tolist()
    new = joined.copy()
    for a in active:
        i, j, k = leaf[:a], joined[:a], new[:a]
        total = 0
        for _ in range(2):
            light, heavy = weights[i], weights[j]
            first = light <= heavy
            parent[np.where(first, i, j)] = k
            total = total + np.minimum(light, heavy)
            i += first
            j += ~first
        weights[k] = total
        k += 1
    depth = np.zeros(len(parent), dtype=np.int64)
    root = np.arange(len(counts)) * stride + wide + 1 + n - 2
    for back in range(1, wide - 1):
        node = root[: np.searchsorted(-n, -(back + 2), side="right")] - back
        depth[node] = depth[parent[node]] + 1
    out = np.zeros(counts.shape, dtype=np.int64)
    out[row, symbol] = np.where(n[rank[row]] > 1, depth[parent[rank[row] * stride + within]] + 1, 1)
    for k in np.flatnonzero(out.max(axis=1) > most).tolist():
        out[k] = code_lengths(counts[k], most)
    return out


def all_code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of each row of lengths (at most 15), first bit lowest."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    order = np.argsort(row * 16 + n, kind="stable")
    row, symbol, n = row[order], symbol[order], n[order]
    take = 1 << (15 - n)
    total = np.cumsum(take) - take
    start = total - total[np.searchsorted(row, row)]
    out = np.zeros(lengths.shape, dtype=np.int64)
    out[row, symbol] = reversed_bits(15)[start & 0x7FFF]
    return out


def all_run_lengths(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``webp.run_lengths`` of each row: row, symbol, further bits and the number of these."""
    rows, width = lengths.shape
    flat = lengths.reshape(-1)
    change = np.flatnonzero((np.diff(flat, prepend=-1) != 0) | (np.arange(flat.size) % width == 0))
    x, n, row = flat[change], np.diff(change, append=flat.size), change // width
    # the last length written before a run: that of the last run that is not of zeros, or 8
    filled = np.maximum.accumulate(np.where(x > 0, np.arange(len(x)), -1))
    before = np.concatenate([[-1], filled[:-1]])
    last = np.where((before >= 0) & (row[before] == row), x[before], 8)
    lead = ((x > 0) & (x != last)).astype(np.int64)
    n = n - lead
    most = np.where(x > 0, 6, 138)
    full, rest = n // most, n % most
    tail = np.where(rest > 2, 1, rest)
    each = lead + full + tail
    run = np.repeat(np.arange(len(x)), each)
    k = np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each) - lead[run]
    x, rest, whole, zero = x[run], rest[run], (k >= 0) & (k < full[run]), x[run] == 0
    times = np.where(whole, np.where(zero, 138, 6), rest)
    plain = (k < 0) | (~whole & (rest <= 2))
    symbol = np.where(plain, x, np.where(~zero, 16, np.where(times > 10, 18, 17)))
    more = np.where(plain, 0, times - np.where(symbol == 18, 11, 3))
    return row[run], symbol, more, np.select([plain, symbol == 16, symbol == 17], [0, 2, 3], 7)


def prefixes(fields: Fields, keys: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code for each row of counts, once for each of its keys; returns codes and lengths of all symbols."""
    used = counts > 0
    n = used.sum(axis=1)
    lowest = np.argmax(used, axis=1)
    highest = counts.shape[1] - 1 - np.argmax(used[:, ::-1], axis=1)
    simple = (n < 3) & ((n == 0) | (highest < 256))
    lengths = np.zeros(counts.shape, dtype=np.int64)
    two = simple & (n == 2)
    lengths[two, lowest[two]] = lengths[two, highest[two]] = 1
    head = np.where(two, 0b111 | lowest << 3 | highest << 11, 0b101 | np.where(n > 0, lowest, 0) << 3)
    size = np.where(two, 19, 11)
    full = np.flatnonzero(~simple)
    if len(full):
        lengths[full] = all_code_lengths(counts[full], 15)
        row, symbol, more, bits = all_run_lengths(lengths[full])
        own = all_code_lengths(np.bincount(row * 19 + symbol, minlength=19 * len(full)).reshape(-1, 19), 7)
        words = all_code_words(own)
        order = own[:, list(LENGTH_ORDER)]
        stored = np.maximum(4, 19 - np.argmax(order[:, ::-1] > 0, axis=1))
        head[full] = (stored - 4) << 1 | (order << (5 + 3 * np.arange(19))).sum(axis=1)
        size[full] = 6 + 3 * stored
        own[(own > 0).sum(axis=1) == 1] = 0
    for key in keys:
        fields.put(key, head, size)
        if len(full):
            fields.put(key[full][row] + 1, words[row, symbol] | more << own[row, symbol], own[row, symbol] + bits)
    return all_code_words(lengths), lengths


def all_copies(p: np.ndarray, of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``webp.copies`` of all images, one after another in p: start, length and distance."""
    none = np.zeros(0, dtype=np.int64)
    n = len(p) - LEAST_COPY + 1
    if n < 2:
        return none, none, none
    x = p.astype(U)
    h = x[:n] * U(0x9E3779B97F4A7C15) + x[1 : n + 1] * U(0xBF58476D1CE4E5B9) + x[2 : n + 2] * U(0x94D049BB133111EB) + x[3 : n + 3] * U(0xD6E8FEB86659FD93) + of[:n].astype(U) * U(0xA0761D6478BD642F)
    inside = np.flatnonzero(np.arange(n) + LEAST_COPY <= ends[of[:n]])
    h = h[inside]
    order = np.argsort(h)
    h = h[order]
    first = np.append(True, h[1:] != h[:-1])
    lone = first & np.append(first[1:], True)
    order = np.sort((np.cumsum(first) << 32 | inside[order])[~lone])  # equal hashes in the order of their places
    a, b = order[:-1] & 0xFFFFFFFF, order[1:] & 0xFFFFFFFF
    same = (order[:-1] >> 32 == order[1:] >> 32) & (of[a] == of[b])
    a, b = a[same], b[same]
    for k in range(LEAST_COPY):
        good = p[a + k] == p[b + k]
        a, b = a[good], b[good]
    if not len(b):
        return none, none, none
    far = np.zeros(len(p), dtype=np.int64)
    far[b] = b - a
    far[far > (1 << 20) - 120] = 0
    stops = np.append(np.flatnonzero(far[1:] != far[:-1]) + 1, n)  # an image's last places have no copy, so no run goes over its end
    starts = np.flatnonzero(far)
    reach = (stops[np.searchsorted(stops, starts, side="right")] - starts + LEAST_COPY - 1).tolist()
    starts, far = starts.tolist(), far[starts].tolist()
    out, at, k = [], 0, 0
    while True:
        k = bisect_left(starts, at, k)
        if k == len(starts):
            break
        out.append(k)
        at = starts[k] + min(reach[k], MOST_COPY)
    taken = np.array(out, dtype=np.int64)
    return np.array(starts)[taken], np.minimum(np.array(reach)[taken], MOST_COPY), np.array(far)[taken]


def write_images(fields: Fields, images: list[np.ndarray], keys: np.ndarray, main: np.ndarray) -> None:
    """``webp.write_pixels`` of all images: their fields' keys begin at ``keys``."""
    sizes = np.array(list(map(len, images)))
    p = np.concatenate(images).astype(np.int64)
    firsts = np.cumsum(sizes) - sizes
    flat = np.maximum.reduceat(p, firsts) == np.minimum.reduceat(p, firsts)
    if flat.any():  # five codes of one symbol say all
        c, wide = p[firsts[flat]], np.where(main[flat], 2, 1)
        value = sum((0b101 | (c >> shift & 255) << 3) << 11 * k for k, shift in enumerate((8, 16, 0, 24))) | 0b101 << 44
        fields.put(keys[flat], value << wide, 55 + wide)
        rest = np.flatnonzero(~flat)
        if not len(rest):
            return
        images, keys, main, sizes = [images[k] for k in rest.tolist()], keys[rest], main[rest], sizes[rest]
        p = np.concatenate(images).astype(np.int64)
    many, n = len(images), len(p)
    of, ends = np.repeat(np.arange(many), sizes), np.cumsum(sizes)
    start, length, distance = all_copies(p, of, ends)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[start] += 1
    np.subtract.at(edge, start + length, 1)
    literal = np.cumsum(edge[:n]) == 0
    slot = (p.astype(U) * U(0x1E35A7BD) & U(0xFFFFFFFF)).astype(np.int64) >> (32 - CACHE_BITS)
    entry = of << CACHE_BITS | slot
    order = np.argsort(slot.astype(np.uint8), kind="stable")
    order = order[np.argsort(of[order].astype(np.uint16 if many <= 1 << 16 else np.int64), kind="stable")]
    a, b = order[:-1], order[1:]
    hit = np.zeros(n, dtype=bool)
    hit[b[(entry[a] == entry[b]) & (p[a] == p[b])]] = True
    hit &= literal
    hits = np.bincount(entry[hit], minlength=many << CACHE_BITS).reshape(many, -1)
    cache = (sizes >= 1 << CACHE_BITS) & (hits.sum(axis=1) >= 2 * (hits > 0).sum(axis=1))
    hit &= cache[of]
    # what stands before the codes
    cached = cache.astype(np.int64)
    fields.put(keys, cached | (cached * CACHE_BITS) << 1, 1 + 4 * cached + main)
    # tokens in order
    token = literal.copy()
    token[start] = True
    at = np.flatnonzero(token)
    copied = ~literal[at]
    in_cache = hit[at]
    plain = np.flatnonzero(~copied & ~in_cache)
    own, q = of[at], p[at]
    size, size_more, size_bits = prefix_of(length)
    far, far_more, far_bits = prefix_of(distance + 120)
    green = q >> 8 & 255
    green[copied] = 256 + size
    green[in_cache] = 280 + slot[at[in_cache]]
    c, lit = q[plain], own[plain]
    red, blue, alpha = c >> 16 & 255, c & 255, c >> 24 & 255

    def counted(row, symbol, width):
        return np.bincount(row * width + symbol, minlength=many * width).reshape(many, width)

    greens = counted(own, green, 280 + (1 << CACHE_BITS))
    words, wide = np.zeros(greens.shape, dtype=np.int64), np.zeros(greens.shape, dtype=np.int64)
    for some, width in ((cache, greens.shape[1]), (~cache, 280)):
        if some.any():
            words[some, :width], wide[some, :width] = prefixes(fields, [keys[some] + 1], greens[some, :width])
    value = (words << 4 | wide).reshape(-1)[own * greens.shape[1] + green]
    bits = value & 15
    value >>= 4
    words, wide = prefixes(fields, [keys + 3, keys + 5], counted(lit, red, 256) + counted(lit, blue, 256))
    both = (words << 4 | wide).reshape(-1)
    v, m = value[plain], bits[plain]
    for symbol in (red, blue):
        code = both[lit * 256 + symbol]
        v |= code >> 4 << m
        m += code & 15
    words, wide = prefixes(fields, [keys + 7], counted(lit, alpha, 256))
    if wide.any():
        v |= words[lit, alpha] << m
        m += wide[lit, alpha]
    value[plain], bits[plain] = v, m
    whose = own[copied]
    words, wide = prefixes(fields, [keys + 9], counted(whose, far, 40))
    v, m = value[copied], bits[copied]
    for x, more in ((size_more, size_bits), (words[whose, far], wide[whose, far]), (far_more, far_bits)):
        v, m = v | x << m, m + more
    value[copied], bits[copied] = v, m
    fields.put(keys[own] + 11, value, bits)


def all_costs(of: np.ndarray, planes: np.ndarray, tiles: int) -> np.ndarray:
    """Entropy in bits of the samples (rows, width, planes) of each tile, of which ``of`` has the number for each row."""
    n = planes.shape[2]
    at = (of[:, None, None] * n + np.arange(n)) * 256 + planes
    counts = np.bincount(at.reshape(-1), minlength=tiles * n * 256).reshape(tiles, n, 256)
    return (weighed(counts.sum(axis=2)) - weighed(counts).sum(axis=2)).sum(axis=1)


def all_predicted(c: np.ndarray, of: np.ndarray, tiles: int, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``webp.predicted`` of images, one under the other, of which ``head`` marks the first rows."""
    black = np.array([0, 0, 0, 255], dtype=np.uint8)
    up = np.concatenate([c[:1], c[:-1]])
    up[head] = c[head]
    rests = [c - black, c - np.concatenate([c[:, :1], c[:, :-1]], axis=1), c - up]
    best = np.argmin(np.stack([all_costs(of, x[:, :, :3], tiles) for x in rests]), axis=0)
    mode = best[of]
    rest = np.where((mode == 0)[:, None, None], rests[0], np.where((mode == 1)[:, None, None], rests[1], rests[2]))
    rest[:, 0] = rests[2][:, 0]
    rest[head, 1:] = rests[1][head, 1:]
    rest[head, 0] = c[head, 0] - black
    return rest, best.astype(np.uint32)


def all_crossed(c: np.ndarray, of: np.ndarray, tiles: int) -> tuple[np.ndarray, np.ndarray]:
    """``webp.crossed`` of images, one under the other."""
    green = c[:, :, 1].view(np.int8).astype(np.int64)
    power = np.bincount(of, weights=(green * green).sum(axis=1), minlength=tiles)
    out, elements = c.copy(), np.zeros(tiles, dtype=np.uint32)
    for channel, shift in ((2, 0), (0, 8)):  # blue, green, red, alpha in memory
        own = c[:, :, channel].view(np.int8).astype(np.int64)
        slope = np.bincount(of, weights=(green * own).sum(axis=1), minlength=tiles) / np.maximum(power, 1)
        by = np.clip(np.rint(32 * slope), -128, 127).astype(np.int64)
        tried = (own - (by[of][:, None] * green >> 5)).astype(np.uint8)
        better = all_costs(of, tried[:, :, None], tiles) < all_costs(of, c[:, :, channel : channel + 1], tiles)
        out[:, :, channel] = np.where(better[of][:, None], tried, c[:, :, channel])
        elements |= np.where(better, by & 255, 0).astype(np.uint32) << np.uint32(shift)
    return out, elements


#: Files and samples that are written at once at most, unless one file has more.
WRITTEN, SAMPLES = 1 << 9, 1 << 21


def encode_rgb(samples: list[np.ndarray]) -> list[bytes]:
    """Lossless WebP files of 8-bit samples (height, width, 3), all of one width: those of ``webp.encode_rgb``."""
    return [x for part in parts(samples, lambda a: a.size, WRITTEN, SAMPLES) for x in _encode_rgb(part)]


def _encode_rgb(samples: list[np.ndarray]) -> list[bytes]:
    width = samples[0].shape[1]
    if any(not 0 < len(x) <= MOST or x.shape[1] != width for x in samples) or not 0 < width <= MOST:
        raise ValueError("images have 1 to 16384 pixels on a side and one width")
    fields, images, keys, main, large = Fields(), [], [], [], []
    everything = np.concatenate(samples).astype(np.uint32)
    argb = np.uint32(0xFF000000) | everything[:, :, 0] << np.uint32(16) | everything[:, :, 1] << np.uint32(8) | everything[:, :, 2]
    del everything
    heights = np.array(list(map(len, samples)))
    first = np.cumsum(heights) - heights
    tile = max(TILE, (width - 1).bit_length())
    for k, (a, height) in enumerate(zip(first.tolist(), heights.tolist(), strict=True)):
        own = argb[a : a + height]
        base, sides = k * SECTIONS, (width - 1) | (height - 1) << 14 | 1 << 32
        colours = np.sort(own, axis=None)
        colours = colours[np.append(True, colours[1:] != colours[:-1])]
        if len(colours) > 256:
            large.append(k)
            fields.put([base], sides | PREDICTOR << 33 | (tile - 2) << 35, 38)
            continue
        fields.put([base, base + 32], [sides | PALETTE << 33 | (len(colours) - 1) << 35, 0], [43, 1])
        steps = np.diff(colours.astype("<u4").view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), dtype=np.uint8))
        index = bundled(np.searchsorted(colours, own).astype(np.uint8), len(colours))
        images += [np.ascontiguousarray(steps).view("<u4").reshape(-1), np.uint32(0xFF000000) | index.astype(np.uint32).reshape(-1) << np.uint32(8)]
        keys += [base + 1, base + 33]
        main += [False, True]
    if large:
        rows = np.concatenate([np.arange(first[k], first[k] + heights[k]) for k in large])
        high = heights[large]
        across = (high + (1 << tile) - 1) >> tile  # tiles of each image: they take whole rows
        within = np.arange(len(rows)) - np.repeat(np.cumsum(high) - high, high)
        of = (within >> tile) + np.repeat(np.cumsum(across) - across, high)
        tiles = int(across.sum())
        c = argb[rows].astype("<u4").view(np.uint8).reshape(len(rows), width, 4)
        rest, modes = all_predicted(c, of, tiles, within == 0)
        rest, elements = all_crossed(rest, of, tiles)
        rest = np.ascontiguousarray(rest).view("<u4").reshape(len(rows), width)
        row = np.append(np.cumsum(high) - high, len(rows)).tolist()
        t = np.append(np.cumsum(across) - across, tiles).tolist()
        for n, k in enumerate(large):
            base = k * SECTIONS
            fields.put([base + 16, base + 32], [1 | CROSS_COLOUR << 1 | (tile - 2) << 3, 0], [6, 1])
            images += [np.uint32(0xFF000000) | modes[t[n] : t[n + 1]] << np.uint32(8), np.uint32(0xFF000000) | elements[t[n] : t[n + 1]], rest[row[n] : row[n + 1]].reshape(-1)]
            keys += [base + 1, base + 17, base + 33]
            main += [False, False, True]
    write_images(fields, images, np.array(keys), np.array(main))
    out = []
    for x in fields.streams(len(samples)):
        size = len(x) + 1
        chunk = b"VP8L" + struct.pack("<I", size) + b"\x2f" + x + b"\0" * (size & 1)
        out.append(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk)
    return out


#: Files and pixels that are read at once at most, unless one file has more.
MANY, PIXELS = 1 << 11, 1 << 21
#: Files that are read side by side at least; fewer are faster one by one.
FEW = 48


#: Of each symbol of a code of code lengths: its length, the least number of times and the number of further bits.
KINDS = np.array([(k, 1, 0) for k in range(16)] + [(0, 3, 2), (0, 3, 3), (0, 11, 7)]).T


def tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tables of ``webp.Code`` for the lengths in each row, one after another; where each begins, the masks of their bits, and whether each code is complete."""
    count = (lengths > 0).sum(axis=1)
    wide = np.where(count > 1, lengths.max(axis=1), 0)
    good = (count < 2) | ((1 << np.maximum(wide[:, None] - lengths, 0)).sum(axis=1, where=lengths > 0) == 1 << wide)
    wide = np.where(good, wide, 0)
    row, symbol = np.nonzero(np.where(good[:, None], lengths, 0))
    n = np.where(count[row] > 1, lengths[row, symbol], 0)
    order = np.argsort((row * 16 + n).astype(np.uint16) if len(lengths) <= 1 << 12 else row * 16 + n, kind="stable")
    row, n, entry = row[order], n[order], (symbol << 4 | n)[order]
    sizes = 1 << wide
    begin = np.cumsum(sizes) - sizes
    times = 1 << (wide[row] - n)
    of = np.repeat(row, times)
    total = np.bincount(of, minlength=len(lengths))
    place = np.arange(len(of)) - (np.cumsum(total) - total)[of]
    out = np.zeros(int(sizes.sum()), dtype=np.int32)
    out[begin[of] + (reversed_bits(15)[place] >> (15 - wide[of]))] = np.repeat(entry, times)
    return out, begin, sizes - 1, good


def read_lengths(words: np.ndarray, at: np.ndarray, size: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The lengths of the prefix code that stands at each place, which go on behind it.  Rows that ``webp.read_code`` has to read are marked in ``good``."""
    out = np.zeros((len(at), int(size.max())), dtype=np.int64)
    x = words[at >> 3] >> (at & 7)
    simple = (x & 1).astype(bool)
    eight, two = x >> 2 & 1, x >> 1 & 1
    one = x >> 3 & np.where(eight, 255, 1)
    other = x >> (4 + 7 * eight) & 255
    good &= ~simple | (np.maximum(one, other * two) < size)
    for rows, symbol in ((simple & good, one), (simple & good & (two > 0), other)):
        out[rows, symbol[rows]] = 1
    at += np.where(simple, 4 + 7 * eight + 8 * two, 0)
    f = np.flatnonzero(~simple & good)
    if not len(f):
        return out
    p, n = at[f] + 5, (x[f] >> 1 & 15) + 4
    own = np.zeros((len(f), 19), dtype=np.int64)
    x = words[p >> 3] >> (p & 7)
    for k, symbol in enumerate(LENGTH_ORDER):
        own[:, symbol] = np.where(k < n, x >> 3 * k & 7 if k < 18 else words[(p + 54) >> 3] >> (p + 54 & 7) & 7, 0)
    p += 3 * n
    table, begin, mask, complete = tables(own)
    complete &= ((words[p >> 3] >> (p & 7) & 1) == 0) & (n <= 19)
    good[f[~complete]] = False
    keep = np.flatnonzero(complete)
    f, p, begin, mask = f[keep], p[keep] + 1, begin[keep], mask[keep]
    symbol, last, most = np.zeros(len(f), dtype=np.int64), np.full(len(f), 8), size[f]
    found = []
    while len(f):
        x = words[p >> 3] >> (p & 7)
        e = table[begin + (x & mask)]
        kind, used = e >> 4, e & 15
        value, times, extra = KINDS[:, kind]
        times = times + (x >> used & ((1 << extra) - 1))
        value = np.where(kind == 16, last, value)
        last = np.where(value > 0, value, last)
        found.append((f, symbol, times, value))
        p = p + used + extra
        symbol = symbol + times
        rest = symbol < most
        if not rest.all():
            at[f[~rest]] = p[~rest]
            good[f[symbol > most]] = False
            f, p, begin, mask, symbol, last, most = (y[rest] for y in (f, p, begin, mask, symbol, last, most))
    f, symbol, times, value = (np.concatenate(y) for y in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 4
    keep = np.flatnonzero((value > 0) & good[f])
    f, symbol, times, value = f[keep], symbol[keep], times[keep], value[keep]
    place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    out[np.repeat(f, times), np.repeat(symbol, times) + place] = np.repeat(value, times)
    return out


def _values(prefix: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``webp.read_value`` of prefix symbols and the bits behind them; and how many of these were used."""
    extra = np.maximum(prefix - 2, 0) >> 1
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + (x & ((1 << extra) - 1))) + 1, extra


NEAR = np.array(webp.NEAR)


def side_by_side(images: list[tuple[webp.Bits, int, int, bool]]) -> list[np.ndarray | None]:
    """Pixels of images (bits, width, height, whether it is a main one), as ``webp.read_pixels`` reads them; None for one with several groups of
    codes or anything unusual in its codes.

    In each step every image gets one pixel.  A copy goes on over as many steps as it has pixels."""
    result: list[np.ndarray | None] = [None] * len(images)
    order = sorted(range(len(images)), key=lambda k: -images[k][1] * images[k][2])
    images = [images[k] for k in order]
    words = np.concatenate([*[x[0].numbers for x in images], np.zeros(2048, dtype=U)])
    words = (words & U((1 << 63) - 1)).view(np.int64)
    room = np.array([len(x[0].numbers) for x in images]) * 8
    origin = np.cumsum(room) - room
    at = origin + np.array([x[0].at for x in images])
    x = words[at >> 3] >> (at & 7)
    cache_bits, main = np.where(x & 1, x >> 1 & 15, 0), np.array([x[3] for x in images])
    used = np.where(x & 1, 5, 1)
    good = ((x & 1 == 0) | (cache_bits > 0)) & (cache_bits < 12) & ~(main & (x >> used & 1 > 0))
    at += used + main
    codes = []
    for size in (np.where(cache_bits > 0, 280 + (1 << cache_bits), 280), 256, 256, 256, 40):
        codes.append(read_lengths(words, at, np.broadcast_to(np.asarray(size), at.shape), good))
    made = [tables(c) for c in codes]
    for m in made:
        good &= m[3]
    good &= (at <= origin + room - 64) & (sum(np.frexp(m[2].astype(np.float64))[1] for m in made[:4]) <= 56)
    keep = np.flatnonzero(good)
    if not len(keep):
        return result
    order, images = [order[k] for k in keep.tolist()], [images[k] for k in keep.tolist()]
    at, origin, cache_bits = at[keep], origin[keep], cache_bits[keep]
    many, totals = len(images), np.array([x[1] * x[2] for x in images])
    table = np.concatenate([m[0] for m in made]).astype(np.int64)
    before = np.cumsum([0, *[len(m[0]) for m in made[:-1]]]).tolist()
    green, red, blue, alpha, distance = (m[1][keep] + k for m, k in zip(made, before, strict=True))
    green_mask, red_mask, blue_mask, alpha_mask, distance_mask = (m[2][keep] for m in made)
    opaque = not alpha_mask.any()
    base = table[alpha] >> 4 << 24
    slots = 1 << cache_bits
    cache, held = np.zeros(int(slots.sum()), dtype=np.int64), np.cumsum(slots) - slots
    shift, width = 32 - cache_bits, np.array([x[1] for x in images])
    offset = np.cumsum(totals) - totals
    out = np.zeros(int(totals.sum()), dtype=np.int64)
    left, far = np.zeros(many, dtype=np.int64), np.zeros(many, dtype=np.int64)
    active = np.searchsorted(-totals, -np.arange(int(totals[0])), side="left").tolist()  # images with more pixels than that
    a, done = None, 0
    try:
        for done, n in enumerate(active):
            if n < FEW:
                break
            if n != a:
                a = n
                g, r, b, gm, rm, bm = (x[:n] for x in (green, red, blue, green_mask, red_mask, blue_mask))
                p, fixed, h, sh, off, rest = (x[:n] for x in (at, base, held, shift, offset, left))
            x = words[p >> 3] >> (p & 7)
            e = table[g + (x & gm)]
            used, s = e & 15, e >> 4
            x >>= used
            e = table[r + (x & rm)]
            first = e & 15
            argb = s << 8 | e >> 4 << 16
            e = table[b + (x >> first & bm)]
            argb |= e >> 4
            more = first + (e & 15)
            if opaque:
                argb |= fixed
            else:
                e = table[alpha[:n] + (x >> more & alpha_mask[:n])]
                argb |= e >> 4 << 24
                more += e & 15
            odd = np.flatnonzero((s > 255) | (rest > 0))
            if len(odd):
                more[odd] = 0
                going = rest[odd] > 0
                copied = odd[going]
                used[copied] = 0
                fresh = odd[~going]
                c = s[fresh]
                hits = fresh[c >= 280]
                argb[hits] = cache[h[hits] + s[hits] - 280]
                new = fresh[c < 280]
                if len(new):
                    length, extra = _values(s[new] - 256, x[new])
                    q = p[new] + used[new] + extra
                    y = words[q >> 3] >> (q & 7)
                    e = table[distance[new] + (y & distance_mask[new])]
                    d, extra = _values(e >> 4, y >> (e & 15))
                    used[new] = q + (e & 15) + extra - p[new]
                    close = NEAR[np.minimum(d, 120) - 1]
                    d = np.where(d <= 120, np.maximum(1, close[:, 0] + close[:, 1] * width[new]), d - 120)
                    if (d > done).any() or (done + length > totals[new]).any():
                        raise ValueError("a back-reference leaves the image")
                    rest[new], far[new] = length, d
                    copied = np.concatenate([copied, new])
                argb[copied] = out[off[copied] + done - far[copied]]
                rest[copied] -= 1
            p += used
            p += more
            cache[h + ((argb * 0x1E35A7BD & 0xFFFFFFFF) >> sh)] = argb
            out[off + done] = argb
        else:
            done += 1
    except IndexError:
        raise ValueError("the stream ends too soon") from None
    for k, (bits, w, _, _) in enumerate(images):
        total = int(totals[k])
        pixels = out[offset[k] : offset[k] + total]
        bits.at = int(at[k] - origin[k])
        bits.read(0)
        if total > done:
            slot, at_least = cache[held[k] : held[k] + slots[k]].tolist(), done + int(left[k])
            for m in range(done, at_least):  # a copy that is under way
                pixels[m] = argb = int(pixels[m - far[k]])
                slot[(0x1E35A7BD * argb & 0xFFFFFFFF) >> int(shift[k])] = argb
            own = [webp.Code({s: n for s, n in enumerate(c[keep[k]].tolist()) if n}) for c in codes]
            try:
                pixels = webp._decoded(bits, [own], None, 0, int(cache_bits[k]), w, total, pixels[:at_least].tolist(), slot)
            except IndexError:
                raise ValueError("the stream ends too soon") from None
        result[order[k]] = np.asarray(pixels).astype(np.uint32)
    return result


def pixels_of(data: bytes) -> int:
    """How many pixels a file has."""
    sides = int.from_bytes(data[21:25], "little")
    return ((sides & 0x3FFF) + 1) * ((sides >> 14 & 0x3FFF) + 1)


def _pixels(images: dict[int, tuple[webp.Bits, int, int, bool]]) -> dict[int, np.ndarray]:
    """``webp.read_pixels`` of each image (bits, width, height, whether it is a main one)."""
    starts = {k: x[0].at for k, x in images.items()}
    out = dict(zip(images, side_by_side(list(images.values())) if len(images) >= FEW else [None] * len(images), strict=True))
    for k, (bits, width, height, main) in images.items():
        if out[k] is None:
            bits.at = starts[k]
            out[k] = webp.read_pixels(bits, width, height, main)
    return out


def decode(files: list[bytes]) -> list[np.ndarray]:
    """``webp.decode`` of each file."""
    return [x for part in parts(files, pixels_of, MANY, PIXELS) for x in _decode(part)]


def _decode(files: list[bytes]) -> list[np.ndarray]:
    """All files at once: palettes are read side by side, and then main images."""
    heads = [webp.Opened(x) for x in files]
    waiting = {k for k, head in enumerate(heads) if head.advance()}
    while waiting:
        for k, x in _pixels({k: (heads[k].bits, heads[k].colours, 1, False) for k in sorted(waiting)}).items():
            heads[k].add_palette(x)
        waiting = {k for k in waiting if heads[k].advance()}
    argb = _pixels({k: (head.bits, head.stored, head.height, True) for k, head in enumerate(heads)})
    return [head.undone(argb[k]) for k, head in enumerate(heads)]
