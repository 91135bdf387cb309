"""Words and word shingles of texts as 64-bit hashes, for kernels inside tasks.

Words are what stands between [\\x20\\x09-\\x0D] after A-Z are lower-cased, so a text needs no
decoding: both steps act on ASCII bytes only.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

from tabsight.llm.common import mix64

SHINGLE = 5
_FOLD = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling combination
_CACHE_WORDS = 400_000


class WordHashes:
    """Hashes of words, remembered between texts of a task up to a fixed number of words."""

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(known) > _CACHE_WORDS:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(word_hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash per run of ``size`` words, in order; fewer words make one shingle, none make none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    width = min(size, n)
    out = word_hashes[: n - width + 1].copy()
    for i in range(1, width):
        out = out * _FOLD + word_hashes[i : n - width + 1 + i]
    return mix64(out + np.uint64(width))


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(hashes.of(words_of(text)), size))


def word_shingles(texts: Iterable[str | None], size: int = SHINGLE) -> list[set[bytes]]:
    """Shingles as text, for tests and small comparisons."""
    out = []
    for t in texts:
        w = words_of(t)
        k = min(size, len(w))
        out.append({b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out
