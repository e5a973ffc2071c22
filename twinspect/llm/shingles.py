"""Word shingles as sorted sets of 64-bit hashes, for the operators that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


class WordHashes(dict):
    """Hash of a word; emptied when it holds `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased. bytes.split() splits at exactly 0x20 and 0x09-0x0D."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle; without words the set is empty."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text)
    n = min(len(w), width)
    if n == 0:
        return w
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ w[i : len(w) - n + 1 + i]) * _MULT
            h ^= h >> np.uint64(29)
        return np.unique(mixed(h))
