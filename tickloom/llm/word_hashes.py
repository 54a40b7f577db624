"""Hashes of words and of runs of words over the concatenated words of many texts."""

from __future__ import annotations

import numpy as np
import xxhash

from tickloom.llm.texts import Parts

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Constant-time hashes of word runs: prefix sums of word hash times step^place,
    taken back to place zero, so equal runs have equal hashes wherever they lie."""

    def __init__(self, words: Parts):
        self.words, self.edges = words, words.edges
        n = int(self.edges[-1])
        each = np.fromiter(map(_word_hash, words.distinct), np.uint64, len(words.distinct))
        self.hashes = hashes = each[words.codes]
        powers = np.full(n + 1, _STEP, np.uint64)
        self.back = np.full(n + 1, _BACK, np.uint64)
        powers[0] = self.back[0] = 1
        powers, self.back = np.cumprod(powers), np.cumprod(self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words [start, end) of the concatenation."""
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the leftmost of equals) of each window."""
    best, span = np.arange(len(values)), 1
    while span < width and len(best):
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        span += step
    return best
