"""Vectorised hashes of words and word sequences."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * B)


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, base, inverse = 1 << bits, int(A), pow(int(A), -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    return _powers(max(16, int(n).bit_length()))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each white-space separated word, index of its text) of texts that end at ends in data; A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    cut = ends[ends < len(data)]
    begin[cut] = word[cut]  # a text's first byte starts a word, whatever was before
    start = np.flatnonzero(begin)
    stop = word.copy()
    stop[:-1] &= ~word[1:] | begin[1:]
    end = np.flatnonzero(stop) + 1
    power, inverse = powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLE[data] * power[: len(data)])))
    h = (sums[end] - sums[start]) * inverse[start]
    return mixed(h ^ (end - start).astype(np.uint64) * C), np.searchsorted(ends, start, "right")


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct hashes, sorted, of each text's sequences of size words; of fewer words, the whole sequence is one."""
    if not texts:
        return []
    ends = np.cumsum([len(t) for t in texts])
    h, row = words(np.frombuffer(b"".join(texts), np.uint8), ends)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    if len(h) >= size:
        g = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            g = mixed(g * A + h[j : j + len(g)] + np.uint64(j + 1))
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for v in h[a:b]:
                x = mixed(np.array([x], np.uint64) * B + v)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
