"""Hashed word shingles of a text, inside Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from labelwright.llm.words import byte_words

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class Shingler:
    """Distinct hashed shingles of ``width`` words; the hashes of frequent words are remembered."""

    def __init__(self, width: int, keep: int = 300_000):
        self.width, self.keep, self.known = width, keep, {}

    def word_hashes(self, text: str | None) -> np.ndarray:
        words, known = byte_words(text), self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        out = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(known) > self.keep:
            known.clear()
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; a text of fewer words gives one for its whole sequence."""
        h = self.word_hashes(text)
        if not len(h):
            return h
        n = min(self.width, len(h))
        with np.errstate(over="ignore"):
            s = np.full(len(h) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                s += h[k : len(h) - n + 1 + k] * _MIX[k]
            s ^= s >> np.uint64(33)
            s *= np.uint64(0xFF51AFD7ED558CCD)
            s ^= s >> np.uint64(33)
        return np.unique(s)
