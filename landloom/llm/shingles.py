"""Hashed words and word shingles of texts, inside tasks."""

from __future__ import annotations

import re
import zlib

import numpy as np

SHINGLE_WORDS = 5
_WORD = re.compile(r"\w+")
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of a text's words (runs of letters, digits and underscores, in lower case); keeps those it has met."""

    def __init__(self) -> None:
        self.met: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if len(self.met) > 400_000:
            self.met.clear()
        data = word.encode("utf-8", "surrogatepass")
        h = self.met[word] = (zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)) or 1
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        met = self.met
        return np.array([met.get(w) or self._hash(w) for w in _WORD.findall((text or "").lower())], np.uint64)


def shingles(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of k words in a row; of all words where they are fewer; none for no words."""
    k = min(k, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h + words[i : i + n])
    return h


def occurrence_labelled(kmers: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, number of its earlier occurrences): no two of a text are alike."""
    if len(kmers) < 2:
        return kmers
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if first.all():
        return kmers
    at = np.arange(len(ranked))
    nth = np.empty(len(kmers), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.where(nth > 0, mix(kmers + nth * _A), kmers)
