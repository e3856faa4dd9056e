"""Words and their hashes for batches of texts, as numpy arrays."""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np

FIND_WORDS = re.compile(r"\w+").findall


class WordHashes(dict):
    """word -> 32-bit hash; forgets all when it has grown to ``kept`` words."""

    kept = 250_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.kept:
            self.clear()
        self[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return found


def hashed_words(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all lower-case words in order as uint64, number of words of each text)."""
    words = [FIND_WORDS(t.lower()) if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum())), n


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
