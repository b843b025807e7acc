"""Sets of word shingles as 64-bit numbers, in numpy, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

WIDTH = 5
CACHE = 1 << 20      # words whose hash a worker keeps; it starts anew beyond that


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _WordHash()
_ODD = np.random.default_rng(0x5EED).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def words(text: str | None) -> list[bytes]:
    """Words between white space, with A-Z (only) in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(ws: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The distinct shingles, sorted. Fewer words than ``width`` are one shingle
    as they stand; no words give the empty set."""
    n = len(ws)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, ws), np.uint64, n)
    k = min(n, width)
    sums = h[: n - k + 1] * _ODD[0]
    for j in range(1, k):
        sums += h[j : n - k + 1 + j] * _ODD[j]
    if n < width:
        sums = sums + np.uint64(n)       # a short text is no shingle of a long one
    return np.unique(_mixed(sums))


def packed(sets: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All sets end to end, and where each begins."""
    sets = list(sets)
    starts = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), starts


class MinMax:
    """Signatures that keep both the minimum and the maximum of each permutation.

    Under one permutation the maximum is the minimum under the reversed order,
    so it agrees between two sets with the same probability, their Jaccard
    similarity: each hash evaluation serves two places of the signature.
    """

    def __init__(self, permutations: int, both: bool = True, seed: int = 7):
        r = np.random.default_rng(seed)
        self.a = r.integers(1, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, permutations, dtype=np.uint64)
        self.both = both
        self.places = permutations * (2 if both else 1)

    def signatures(self, elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row a set; every set has elements."""
        out = np.empty((len(starts), self.places), np.uint64)
        k = 0
        for a, b in zip(self.a, self.b, strict=True):
            x = elements * a
            x += b
            out[:, k] = np.minimum.reduceat(x, starts)
            k += 1
            if self.both:
                out[:, k] = np.maximum.reduceat(x, starts)
                k += 1
        return out

    def keys(self, signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """One 64-bit key a band; a band takes ``rows`` places, the number of the
        band is mixed in so that one table can hold the keys of all bands."""
        assert bands * rows <= self.places
        s = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
        keys = np.broadcast_to(_mixed(np.arange(1, bands + 1, dtype=np.uint64)), s.shape[:2]).copy()
        for j in range(rows):
            keys = _mixed(keys * _ODD[j] + _mixed(s[:, :, j]))
        return keys
