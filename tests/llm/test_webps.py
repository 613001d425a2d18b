"""Many WebP files at once: as one by one."""

import numpy as np
import pytest

from siftmill.llm import media, webp, webps
from test_webp import RNG, start, text_like


def some(n):
    """Texts of many sizes, with repeats, few bytes, long runs and all bytes."""
    out = [text_like(int(k))[: int(m)] for k, m in zip(RNG.integers(60, 1500, n), RNG.integers(1, 90, n), strict=True)]
    out += [np.zeros((3, 64, 3), dtype=np.uint8), RNG.integers(0, 256, (70, 64, 3)).astype(np.uint8), np.tile(RNG.integers(0, 256, (1, 64, 3)), (150, 1, 1)).astype(np.uint8)]
    out += [RNG.integers(97, 97 + k, (5, 64, 3)).astype(np.uint8) for k in (1, 2, 3, 9)]
    return [x if len(x) else np.full((1, 64, 3), 32, dtype=np.uint8) for x in out]


@pytest.mark.parametrize("written, few", [(512, 48), (7, 2), (2, 10_000)])
def test_same_bytes_and_pixels_as_one_by_one(monkeypatch, written, few):
    monkeypatch.setattr(webps, "WRITTEN", written)
    monkeypatch.setattr(webps, "FEW", few)
    samples = some(130)
    files = webps.encode_rgb(samples)
    assert files == [webp.encode_rgb(x) for x in samples]
    for x, a, b in zip(samples, webps.decode(files), map(webp.decode, files), strict=True):
        assert (a == b).all() and (a[:, :, :3] == x).all()
    assert webps.encode_rgb([]) == [] and webps.decode([]) == []


def test_code_lengths_of_many_rows():
    counts = np.zeros((300, 90), dtype=np.int64)
    for row in counts:
        n = int(RNG.integers(1, 91))
        row[RNG.permutation(90)[:n]] = RNG.integers(1, RNG.choice([2, 4, 1000]), n)
    counts[0] = 0
    counts[0, :40] = 2 ** np.arange(40)
    for most in (7, 15):
        got = webps.all_code_lengths(counts, most)
        assert (got == np.array([webp.code_lengths(x, most) for x in counts])).all()
    rows = [np.repeat(RNG.integers(0, 6, 40), RNG.integers(1, 160, 40))[:280] for _ in range(60)]
    rows = np.array([np.pad(x, (0, 280 - len(x))) for x in rows])
    want = [(k, *r) for k, x in enumerate(rows) for r in webp.run_lengths(x)]
    assert list(zip(*(x.tolist() for x in webps.all_run_lengths(rows)), strict=True)) == want


def unusual():
    """Files that this writer does not make: literals of one length in each channel with alpha, several groups of codes, a green step and a limit of code lengths."""
    a = RNG.integers(0, 256, (5, 9, 4))
    argb = (a[..., 3].astype(np.int64) << 24 | a[..., 0] << 16 | a[..., 1] << 8 | a[..., 2]).reshape(-1)
    s = start(9, 5)
    s.put(0, 1)
    s.literals(argb)
    t = start(9, 5)
    t.put(1, 1)
    t.put(webp.SUBTRACT_GREEN, 2)
    t.put(0, 1)
    t.literals(argb)
    g = start(4, 4)
    for value, n in ((0, 1), (0, 1), (1, 1), (0, 3), (0, 1)):
        g.put(value, n)
    for symbol in (0, 0, 0, 0, 0):
        g.single(symbol)
    for symbol in (7, 8, 9, 255, 0):
        g.single(symbol)
    return [s.file(), t.file(), g.file(), webp.encode_grey(RNG.integers(0, 256, (4, 192)).astype(np.uint8))]


def test_unusual_files_beside_others(monkeypatch):
    monkeypatch.setattr(webps, "FEW", 1)
    files = [x for k in range(30) for x in (unusual()[k % 4], webp.encode_rgb(text_like(300)))]
    for x, y in zip(webps.decode(files), map(webp.decode, files), strict=True):
        assert (x == y).all()


def test_broken_files_beside_others(monkeypatch):
    monkeypatch.setattr(webps, "FEW", 1)
    good = webp.encode_rgb(text_like(600))
    for bad in (good[:200], good[: len(good) // 2], good[:-40], good[:12] + b"VP8 " + good[16:]):
        for files in ([bad, good], [good, bad], [bad]):
            with pytest.raises(ValueError):
                webps.decode(files)


def test_parts_are_bounded():
    sizes = [3, 9, 1, 1, 1, 1, 4, 4, 20, 2]
    got = list(webps.parts(sizes, lambda x: x, 3, 10))
    assert [x for part in got for x in part] == sizes and all(len(x) <= 3 and (sum(x) <= 10 or len(x) == 1) for x in got)


def test_media_of_many_payloads():
    payloads = [bytes(192), b"ab" * 960, bytes(RNG.integers(0, 256, 192 * 20).astype("u1")), b" " * (192 * (webp.MOST + 3))]
    stored = media.all_to_images(payloads)
    assert stored == [media.to_images(x) for x in payloads] and [x.tobytes() for x in media.all_from_images(stored)] == payloads
