"""Suffix sorting by the difference cover of 3, and what adjacent suffixes have in common.

Triples at the places that are 1 or 2 modulo 3 are sorted and named, the sorted suffixes of the string of names give those
of the sample, and the remaining suffixes are sorted by their first symbol and the rank behind it and merged in.
"""

from __future__ import annotations

import numpy as np

#: Symbols that one string may have: packed keys of three ranks then fit into 63 bits.
MOST = 1 << 21


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a string of positive integers, in ascending order; each integer is at most MOST."""
    n = len(t)
    if n > MOST:
        raise ValueError("the string is too long")
    if n < 4:
        return np.asarray(sorted(range(n), key=lambda i: t[i:].tolist()), dtype=np.int64)
    t = np.concatenate([t.astype(np.int64), np.zeros(3, dtype=np.int64)])
    wide = np.int64(max(int(t.max()), n) + 2)
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a place behind the end, so that the two halves of the sample stay apart
    sample = np.concatenate([one, np.arange(2, n, 3)])
    triples = (t[sample] * wide + t[sample + 1]) * wide + t[sample + 2]
    names, inverse = np.unique(triples, return_inverse=True)
    distinct = len(names) == len(sample)
    del triples, names  # a level below needs as much again
    inverse += 1
    order = np.argsort(inverse, kind="stable") if distinct else suffix_array(inverse)
    del inverse
    sample = sample[order]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    key = t[rest] * wide + rank[rest + 1]
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[first] * wide + rank[first + 1], key)
    before += np.searchsorted((t[second] * wide + t[second + 1]) * wide + rank[second + 2], (t[rest] * wide + t[rest + 1]) * wide + rank[rest + 2])
    out = np.empty(n, dtype=np.int64)
    places = np.arange(len(rest)) + before
    free = np.ones(n, dtype=bool)
    free[places] = False
    out[places], out[free] = rest, sample
    return out


def repeated(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string the starts of its substrings of ``window`` bytes that also start anywhere else in the strings."""
    sizes = np.asarray([len(s) + 1 for s in strings])
    raw = np.frombuffer(b"\0".join(strings) + b"\0" * (window + 8), dtype=np.uint8)
    ends = np.cumsum(sizes) - 1
    total = int(ends[-1])
    t = raw[:total].astype(np.int64) + 2
    t[ends[:-1]] = 1  # between strings
    order = suffix_array(t)
    room = np.repeat(ends, sizes)[:total] - np.arange(total)  # bytes up to the end of the string
    fits = room >= window
    order = order[fits[order]]
    a, b = order[:-1], order[1:]
    eight = np.lib.stride_tricks.as_strided(raw, shape=(len(raw) - 7, 8), strides=(1, 1))
    words = np.ascontiguousarray(eight).view("<u8").reshape(-1)
    for at in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:  # adjacent prefixes
        same = words[a + at] == words[b + at]
        if not same.all():
            a, b = a[same], b[same]
    hit = np.zeros(total, dtype=bool)
    hit[a] = True
    hit[b] = True
    starts = ends - sizes + 1
    return [np.flatnonzero(hit[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
