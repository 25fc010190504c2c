"""Words of texts as UTF-8 bytes, and 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII lower-casing, and everything but [0-9A-Za-z] and non-ASCII as a space.
ALNUM = bytes((i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32) for i in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def space_words(text: bytes | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.split() parts at just these six."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is lower-cased."""
    return text.translate(ALNUM).split() if text else []


def length(text: bytes) -> int:
    """Code points of UTF-8."""
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


class WordHash(dict):
    """word -> 64-bit hash; forgets all once it holds `most` words, so its memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads near ones."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of fewer words, of the whole sequence; of none, none."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(n, k)
    acc = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        acc = mixed(acc * ODD + hashes[j : n - size + 1 + j])
    return np.unique(acc)


def signed(x: int) -> int:
    """The 64 bits of x as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x
