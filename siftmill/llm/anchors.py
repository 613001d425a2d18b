"""Places of a byte string that depend only on what stands around them.

For every window of ``window`` bytes one place within it is chosen, the one whose eight bytes have the smallest hash: equal
windows, wherever they stand, choose equal places.  Windows that choose the same place are neighbours.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes from a chosen place on that give its name; they lie within every window that chooses it.
NAME = 40


def chosen(raw: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen places, and the first and last start of the windows that choose each."""
    n = len(raw) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    span = window - NAME + 1  # places that a window may choose
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(raw, dtype=np.uint8), shape=(n + span - 1, 8), strides=(1, 1))
    key = np.ascontiguousarray(eight).view("<u8").reshape(-1) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(key), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: n], key[span - width : span - width + n])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, np.concatenate([first[1:], [n]]) - 1


def named(raw: bytes, window: int) -> tuple[list[int], list[bytes], list[int], list[int]]:
    """Of each chosen place: the hash of its NAME bytes (signed 64 bits), that of all bytes of its windows (128 bits, so that different ones do not meet), where these begin, and how many there are."""
    place, first, last = (x.tolist() for x in chosen(raw, window))
    digest, whole = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
    fix = lambda x: x - (1 << 64) if x >> 63 else x
    names = [fix(digest(raw[p : p + NAME])) for p in place]
    return names, [whole(raw[a : b + window]) for a, b in zip(first, last, strict=True)], first, [b - a + window for a, b in zip(first, last, strict=True)]
