"""The WebP reader on streams written here by the format's rules, with every transform and kind of code."""

import heapq
import struct

import numpy as np
import pytest

from siftmill.llm import webp

RNG = np.random.default_rng(3)


class Stream(webp.Writer):
    def code(self, lengths):
        """A prefix code by its lengths, these written with 16 symbols of four bits; returns the codes."""
        self.put(0, 1)
        self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.msb(n, 4)
        codes, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - last
            codes[s] = (code, n)
            code, last = code + 1, n
        return codes

    def msb(self, value, n):
        for k in range(n - 1, -1, -1):
            self.put(value >> k & 1, 1)

    def constant(self, argb):
        """An image of one colour without its own codes' bits."""
        self.put(0, 1)
        for shift in (8, 16, 0, 24):
            self.single(argb >> shift & 255)
        self.single(0)

    def literals(self, argb):
        """The main image with codes of eight bits for each channel."""
        self.put(0, 2)
        for n in (280, 256, 256, 256):
            self.code([8] * 256 + [0] * (n - 256))
        self.single(0)
        for x in argb.tolist():
            for shift in (8, 16, 0, 24):
                self.msb(x >> shift & 255, 8)

    def file(self):
        payload = b"\x2f" + np.packbits(self.bits(), bitorder="little").tobytes()
        chunk = b"VP8L" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
        return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def start(width, height):
    s = Stream()
    s.put(width - 1, 14)
    s.put(height - 1, 14)
    s.put(1, 1)
    s.put(0, 3)
    return s


def pixels(height, width):
    return RNG.integers(0, 256, (height, width, 4))


def packed(a):
    return (a[..., 3].astype(np.int64) << 24 | a[..., 0] << 16 | a[..., 1] << 8 | a[..., 2]).reshape(-1)


def predicted(a, y, x, mode):
    """Prediction of a pixel, channel by channel, as the format defines it."""
    height, width, _ = a.shape
    if y == 0 and x == 0:
        return [0, 0, 0, 255]
    if y == 0:
        return a[0, x - 1].tolist()
    if x == 0:
        return a[y - 1, 0].tolist()
    left, top, corner = a[y, x - 1].tolist(), a[y - 1, x].tolist(), a[y - 1, x - 1].tolist()
    right = (a[y - 1, x + 1] if x + 1 < width else a[y, 0]).tolist()
    mean = lambda p, q: [(i + j) // 2 for i, j in zip(p, q, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        a_ = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        b_ = sum(abs(p - c) for p, c in zip(left, corner, strict=True))
        return left if a_ < b_ else top
    if mode == 12:
        return [clamp(p + t - c) for p, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    return {0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    a = pixels(6, 7)
    rest = np.array([[[(v - p) % 256 for v, p in zip(a[y, x].tolist(), predicted(a, y, x, mode), strict=True)] for x in range(7)] for y in range(6)])
    s = start(7, 6)
    s.put(1, 1)
    s.put(webp.PREDICTOR, 2)
    s.put(0, 3)
    s.constant(mode << 8)
    s.put(0, 1)
    s.literals(packed(rest))
    assert (webp.decode(s.file()) == a).all()


def test_cross_colour_and_subtract_green():
    a = pixels(5, 9)
    signed = lambda v: v - 256 if v > 127 else v
    red_by, green_by, red_from_green = 200, 90, 30  # red to blue, green to blue, green to red
    step = a.copy()
    step[..., 0], step[..., 2] = (a[..., 0] - a[..., 1]) % 256, (a[..., 2] - a[..., 1]) % 256  # subtract green
    coded = step.copy()
    for p in coded.reshape(-1, 4):
        r, g, b, _ = p.tolist()
        p[0] = (r - (signed(red_from_green) * signed(g) >> 5)) % 256
        p[2] = (b - (signed(green_by) * signed(g) >> 5) - (signed(red_by) * signed(r) >> 5)) % 256
    s = start(9, 5)
    s.put(1, 1)
    s.put(webp.SUBTRACT_GREEN, 2)
    s.put(1, 1)
    s.put(webp.CROSS_COLOUR, 2)
    s.put(1, 3)
    s.constant(red_by << 16 | green_by << 8 | red_from_green)
    s.put(0, 1)
    s.literals(packed(coded))
    assert (webp.decode(s.file()) == a).all()


def test_back_references_cache_and_groups():
    """Two groups of codes by tiles, a colour cache of two entries, copies by distance and from above."""
    width, height, cache_bits = 8, 8, 1
    s = start(width, height)
    s.put(0, 1)
    s.put(1, 1)
    s.put(cache_bits, 4)
    s.put(1, 1)
    s.put(0, 3)  # tiles of four pixels
    s.put(0, 1)  # group image: four tiles with groups 0, 1, 1, 0 in green
    s.pair(0, 1)
    for _ in range(4):
        s.single(0)
    for g in (0, 1, 1, 0):
        s.put(g, 1)
    lengths = [9] * 256 + [5] * 8 + [0] * 16 + [3, 3]
    groups = []
    for _ in range(2):
        green = s.code(lengths)
        channels = [s.code([8] * 256) for _ in range(3)]
        groups.append((green, channels, s.code([5] * 32 + [0] * 8)))
    out, cache, at = [], [0, 0], 0

    def group():
        return groups[[0, 1, 1, 0][(at // width >> 2) * 2 + (at % width >> 2)]]

    def keep(x):
        cache[(0x1E35A7BD * x & 0xFFFFFFFF) >> 31] = x

    def literal(x):
        nonlocal at
        green, channels, _ = group()
        s.msb(*green[x >> 8 & 255])
        for c, shift in zip(channels, (16, 0, 24), strict=True):
            s.msb(*c[x >> shift & 255])
        out.append(x)
        keep(x)
        at += 1

    def copy(length, code, distance):
        nonlocal at
        green, _, far = group()
        s.msb(*green[256 + length - 1])  # lengths of 1 to 4 have no further bits
        s.msb(*far[code[0]])
        s.put(code[1], code[2])
        for _ in range(length):
            out.append(out[at - distance])
            keep(out[at])
            at += 1

    def cached(k):
        nonlocal at
        green = group()[0]
        s.msb(*green[280 + k])
        out.append(cache[k])
        keep(cache[k])
        at += 1

    for x in RNG.integers(0, 1 << 32, 9).tolist():
        literal(x)
    copy(4, (0, 0, 0), width)  # code 1: the pixel above
    copy(3, (1, 0, 0), 1)  # code 2: the pixel to the left
    cached(0)
    cached(1)
    copy(2, (13, 25, 5), 2)  # code 122: two pixels back
    while at < width * height:
        literal(int(RNG.integers(0, 1 << 32)))
    got = webp.decode(s.file())
    want = np.array(out, dtype=np.uint32).astype("<u4").view(np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]
    assert (got == want).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 128, 129, 256])
def test_palette_round_trip(colours):
    values = np.sort(RNG.permutation(256)[:colours]).astype(np.uint8)
    for shape in ((1, 1), (3, 192), (5, 7)):
        a = RNG.choice(values, size=shape)
        got = webp.decode(webp.encode_grey(a))
        assert (got[:, :, 1] == a).all() and (got[:, :, 3] == 255).all() and not got[:, :, [0, 2]].any()


def text_like(n):
    words = ["".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(600)]
    raw = " ".join(RNG.choice(words, n)).encode()
    return np.frombuffer(raw[: len(raw) // 192 * 192], dtype=np.uint8).reshape(-1, 64, 3)


@pytest.mark.parametrize("samples", [
    text_like(4000), RNG.integers(0, 256, (70, 64, 3)).astype(np.uint8), np.zeros((3, 64, 3), dtype=np.uint8), np.tile(RNG.integers(0, 256, (1, 64, 3)), (150, 1, 1)).astype(np.uint8), RNG.integers(0, 256, (1, 1, 3)).astype(np.uint8),
    (np.arange(90)[:, None, None] * 3 + np.arange(70)[None, :, None] * 2 + RNG.integers(0, 3, (90, 70, 3))).astype(np.uint8), RNG.integers(0, 256, (300, 1, 3)).astype(np.uint8),
])
def test_rgb_round_trip(samples):
    got = webp.decode(webp.encode_rgb(samples))
    assert (got[:, :, :3] == samples).all() and (got[:, :, 3] == 255).all()


def test_the_writer_uses_what_the_reader_undoes(monkeypatch):
    """Predictors, cross-colour elements, copies and the colour cache occur in what is written for texts."""
    seen = set()
    for name in ("undo_predictor", "undo_cross_colour", "undo_palette"):
        own = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, own=own, name=name: (seen.add(name), own(*a))[1])
    own = webp._decoded

    def decoded(bits, codes, groups, tile, cache_bits, width, total):
        seen.update({"cache"} if cache_bits else ())
        greens = {x >> 4 for x in codes[0][0].table}
        seen.update({"copy"} if any(256 <= s < 280 for s in greens) else (), {"codes"} if codes[0][0].wide > 2 else ())
        return own(bits, codes, groups, tile, cache_bits, width, total)

    monkeypatch.setattr(webp, "_decoded", decoded)
    for x in (text_like(4000), text_like(60)):
        assert (webp.decode(webp.encode_rgb(x))[:, :, :3] == x).all()
    assert seen == {"undo_predictor", "undo_cross_colour", "undo_palette", "cache", "copy", "codes"}


def test_code_lengths():
    for counts in ([1], [5, 1], [1] * 256, [2**k for k in range(40)], [0, 3, 0, 0, 9, 1]):
        for most in (7, 15) if len(counts) < 100 else (15,):
            n = webp.code_lengths(np.array(counts), most)
            used = n[n > 0]
            assert (n > 0).tolist() == [c > 0 for c in counts] and used.max() <= most and (len(used) == 1 or (2.0 ** -used).sum() == 1)


def test_broken_streams():
    good = webp.encode_grey(RNG.integers(0, 256, (4, 192)).astype(np.uint8))
    for bad in (b"", good[:30], good[:-40], good[:12] + b"VP8 " + good[16:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_code_lengths_are_those_of_a_heap():
    """Two queues join the same two symbols as a heap of (weight, number) does, ties included."""
    for n in [2, 3, 7, 40, 256]:
        for most in (1, 3, 50, 10_000):
            counts = RNG.integers(1, most + 1, n)
            heap, parent = [(w, k) for k, w in enumerate(counts.tolist())], {}
            heapq.heapify(heap)
            while len(heap) > 1:
                (v, a), (w, b) = heapq.heappop(heap), heapq.heappop(heap)
                parent[a] = parent[b] = n + len(parent) // 2
                heapq.heappush(heap, (v + w, parent[a]))

            def depth(k, parent=parent):
                return 1 + depth(parent[k]) if k in parent else 0

            assert webp.code_lengths(counts, 99).tolist() == [depth(k) for k in range(n)]


def test_costs_of_tiles():
    planes = RNG.integers(0, 9, (150, 64, 3)).astype(np.uint8)
    want = [sum(-np.log2(np.bincount(p[:, :, k].reshape(-1))[p[:, :, k]] / p[:, :, k].size).sum() for k in range(3)) for p in (planes[:64], planes[64:128], planes[128:])]
    assert np.allclose(webp.tile_costs(planes, 6), want)
    assert np.allclose(webp.tile_costs(np.zeros((300, 64, 1), dtype=np.uint8), 14), 0)  # counts beyond the table
