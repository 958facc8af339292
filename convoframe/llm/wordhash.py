"""Vectorised word hashing over UTF-8 buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  A word's hash is a
polynomial over the 64-bit ring, read off one prefix sum per piece, so the cost
is a handful of numpy passes over the bytes and no Python object per word.
Texts are handled in pieces cut at separators, which keeps the working memory
near ``PIECE`` bytes (times a small constant) however long a text is.
"""

from __future__ import annotations

import numpy as np

#: Bytes handled by one numpy pass.
PIECE = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SEPARATORS = np.array([9, 10, 11, 12, 13, 32])


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class WordHasher:
    """Hashes the words of byte buffers; ``lower`` folds A-Z first."""

    def __init__(self, lower: bool = True):
        table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        if lower:
            table[65:91] = table[97:123]
        self._table = table
        self._is_word = np.ones(256, dtype=bool)
        self._is_word[_SEPARATORS] = False
        self._size = 0
        self._grow(PIECE)

    def _grow(self, n: int) -> None:
        if n > self._size:
            self._size = n
            self._pow = _powers(n + 1, _BASE)
            self._inv = _powers(n + 1, pow(_BASE, -1, 1 << 64))

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of every word of one piece of bytes."""
        n = len(data)
        if n == 0:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(0, dtype=np.uint64)
        self._grow(n)
        inside = np.zeros(n + 2, dtype=np.int8)
        inside[1:-1] = self._is_word[data]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self._table[data] * self._pow[:n], out=sums[1:])
        return starts, ends, mix64((sums[ends] - sums[starts]) * self._inv[starts] ^ (ends - starts).astype(np.uint64))

    def pieces(self, data: np.ndarray, limit: int = PIECE):
        """Cuts one text at separators into pieces of about ``limit`` bytes."""
        at = 0
        while len(data) - at > limit:
            cut = at + limit
            while cut < len(data):  # a word longer than a piece stays whole
                found = np.flatnonzero(~self._is_word[data[cut : cut + 4096]])
                if len(found):
                    cut += int(found[0])
                    break
                cut = min(len(data), cut + 4096)
            yield data[at:cut]
            at = cut
        yield data[at:]

    def text(self, data: np.ndarray) -> np.ndarray:
        """Hashes of all words of one text, in order."""
        if len(data) <= PIECE:
            return self.words(data)[2]
        return np.concatenate([self.words(piece)[2] for piece in self.pieces(data)])


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; shorter texts give their whole sequence as one."""
    n = len(hashes)
    if n == 0:
        return hashes
    span = min(width, n)
    total = np.full(n - span + 1, np.uint64(span), dtype=np.uint64)
    for i in range(span):
        total = mix64(total * np.uint64(0x9FB21C651E98DF25) + hashes[i : n - span + 1 + i])
    return np.unique(total)
