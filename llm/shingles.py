"""Word shingle sets as sorted 64-bit hashes, and min-max signatures of them."""

from __future__ import annotations

import numpy as np

from .common import WordHashes

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (the splitmix64 steps) on uint64 arrays."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_set(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles; with fewer words
    the whole sequence is one shingle, without words there is none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    k = min(size, len(words))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i])
    return sorted_distinct(out)


def permutations(n: int, seed: int = 6) -> np.ndarray:
    """``n`` odd multipliers: x -> a * x mod 2^64 permutes the hashes."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


def min_max(shingles: np.ndarray, factors: np.ndarray, block: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest image of the set under each permutation:
    two signature values for one evaluation."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(len(factors), dtype=np.uint64)
    for i in range(0, len(shingles), block):
        images = shingles[i:i + block, None] * factors[None, :]
        np.minimum(low, images.min(axis=0), out=low)
        np.maximum(high, images.max(axis=0), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band; a band takes ``rows`` values, half of them
    minima and half maxima, of permutations of its own."""
    values = np.concatenate([low.reshape(-1, rows // 2), high.reshape(-1, rows // 2)], axis=1)
    key = np.arange(1, len(values) + 1, dtype=np.uint64)
    for i in range(rows):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + values[:, i])
    return key
