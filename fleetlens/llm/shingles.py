"""Hashed word shingles and min-max sketches of text batches, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from fleetlens.llm.worker_memory import kept

WIDTH = 5
REMEMBERED = 200_000

_FIVE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    """64-bit hashes of words; starts anew when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash a word, A to Z lower-cased; words lie between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    words = text.encode().lower().split() if text else []
    return np.fromiter(map(kept("words", _Words).__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray) -> np.ndarray:
    """The hash of every five-word window; of all words together where there are fewer than five."""
    if len(h) >= WIDTH:
        n = len(h) - WIDTH + 1
        return mixed(sum(h[k:k + n] * _FIVE[k] for k in range(WIDTH)))
    if len(h):
        return mixed((h * _FIVE[:len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    return h


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    return np.unique(windows(word_hashes(text)))


class MinMax:
    """Banded min-max signatures.

    Each permutation gives two values of a set, its minimum and its maximum, and each of the two agrees for two sets
    with the probability of their Jaccard similarity. `bands * rows` values so take half as many permutations. A band
    holds minima only or maxima only, so its values come from different permutations.
    """

    def __init__(self, bands: int, rows: int):
        assert bands % 2 == 0
        self.bands, self.rows = bands, rows
        dice = np.random.RandomState(20240229)
        n = bands * rows // 2
        self.a = dice.randint(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = dice.randint(0, 2**31, n).astype(np.uint32)
        self.weights = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def keys(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The band keys (one row a set) of non-empty sets that lie one after the other in `shingles`."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        n = len(self.a)
        values = np.empty((2, n, len(starts)), np.uint32)
        for p in range(n):
            y = x * self.a[p] + self.b[p]
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x85EBCA6B)
            y ^= y >> np.uint32(13)
            np.minimum.reduceat(y, starts, out=values[0, p])
            np.maximum.reduceat(y, starts, out=values[1, p])
        v = values.reshape(self.bands, self.rows, len(starts)).astype(np.uint64)
        v = (mixed(v + np.uint64(1)) * self.weights[None, :, None]).sum(axis=1, dtype=np.uint64)
        return mixed(v + np.arange(self.bands, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)).T
