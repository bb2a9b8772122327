"""Word shingles and MinHash in vectorised numpy, used inside tasks."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WORDS = 5
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_powers = [np.ones(1, np.uint64)] * 2


def _power(n: int) -> list[np.ndarray]:
    """The powers of MIX[0] and of its inverse, ``n`` at least."""
    if len(_powers[0]) < n:
        for i, r in enumerate((int(MIX[0]), pow(int(MIX[0]), -1, 1 << 64))):
            all_of = np.full(1 << max(16, (n - 1).bit_length()), r, np.uint64)
            all_of[0] = 1
            _powers[i] = np.cumprod(all_of)
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of ``text`` (runs of characters other than ASCII white space), from sums of powers."""
    data = np.frombuffer(b" %b " % text.encode(), np.uint8)
    blank = SPACE.take(data)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = edges[::2] + 1, edges[1::2] + 1
    power, inverse = _power(len(data) + 1)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[: len(data)]
    sums = np.cumsum(terms)
    x = (sums.take(end - 1) - sums.take(begin - 1)) * inverse.take(begin)
    x ^= x >> np.uint64(32)
    x *= MIX[1]
    x ^= x >> np.uint64(29)
    return x


def shingle_set(text: str, k: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct runs of ``k`` words; of a shorter text, one of all its words; of none, none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(k, len(h))
    x = h[: len(h) - n + 1] + np.uint64(n)
    for j in range(1, n):
        x *= MIX[2]
        x += h[j : len(h) - n + 1 + j]
    x ^= x >> np.uint64(31)
    x *= MIX[1]
    x ^= x >> np.uint64(30)
    x.sort()
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


class MinHash:
    """``size`` universal hash functions a x + b mod 2^32 of 32-bit values, a odd; a signature holds each one's least value."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.size = size
        self.a = rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """uint32 of ``size``; all ones for the empty set."""
        if not len(shingles):
            return np.full(self.size, 0xFFFFFFFF, np.uint32)
        x, out = (shingles >> np.uint64(32)).astype(np.uint32), None
        for i in range(0, len(x), 2048):
            hashed = self.a[:, None] * x[None, i : i + 2048]
            hashed += self.b[:, None]
            low = hashed.min(1)
            out = low if out is None else np.minimum(out, low)
        return out
