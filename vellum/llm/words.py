"""Words and hashed word runs."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Runs of letters or digits.
WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words; emptied when a million are held."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str) -> list[str]:
    """Lower-case runs of letters or digits."""
    return WORD.findall(text.lower())


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    h = h ^ (h >> np.uint64(29))
    h = h * _M1
    return h ^ (h >> np.uint64(32))


def shingles(ws: list[str], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text gives none."""
    if len(ws) < size:
        return np.empty(0, "u8")
    a = np.fromiter(map(hashes.__getitem__, ws), "u8", len(ws))
    n = len(a) - size + 1
    h = a[:n]
    for i in range(1, size):
        h = h * _M2 + a[i : n + i]
    return np.unique(mix(h))
