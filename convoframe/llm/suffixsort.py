"""Suffix sorting by hash comparison.

Prefix polynomial hashes give the hash of any stretch of a byte buffer; a binary
search over lengths finds the common extension of two places, so two suffixes
compare in logarithmic time.  A bottom-up mergesort sorts all groups of suffixes
at once, every comparison of a level being one vectorised step; adjacent
extensions are verified byte by byte, and a group in which a hash collision shows
is sorted again by its bytes.
"""

from __future__ import annotations

import numpy as np

from convoframe.llm.wordhash import _BASE, _powers, mix64

_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


class Prefix:
    """Prefix hashes of a byte buffer; ``of(start, length)`` is independent of the place.

    Where stretches never leave short pieces of the buffer, ``phase`` (each byte's
    place in its piece) keeps the powers to as many as a piece has bytes.
    """

    _pow = _powers(1 << 12, _BASE)
    _inv = _powers(1 << 12, pow(_BASE, -1, 1 << 64))

    def __init__(self, data: np.ndarray, phase: np.ndarray | None = None):
        n = len(data)
        most = n if phase is None else int(phase.max(initial=0)) + 1
        if len(Prefix._pow) <= most:
            size = 1 << (most + 1).bit_length()
            Prefix._pow, Prefix._inv = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
        self.data, self.phase = data, phase
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        terms = _TABLE[data]
        terms *= Prefix._pow[:n] if phase is None else Prefix._pow[phase]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start, length):
        at = start if self.phase is None else self.phase[np.minimum(start, len(self.phase) - 1)]
        return (self.sums[start + length] - self.sums[start]) * Prefix._inv[at]

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all stretches of length ``k`` (of a buffer without phases)."""
        n = len(self.data)
        return mix64((self.sums[k:] - self.sums[: n - k + 1]) * Prefix._inv[: n - k + 1]) if n >= k else np.zeros(0, np.uint64)


def common_extension(p: Prefix, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at ``a`` and ``b``, at most ``most``: binary search over hashes."""
    lo, hi = np.zeros(len(a), dtype=np.int64), most.astype(np.int64).copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = p.of(a, mid) == p.of(b, mid)
        lo = np.where(same, mid, lo)
        hi = np.where(same, hi, mid - 1)
    return lo


def _before(p: Prefix, a, la, b, lb, or_equal: np.ndarray) -> np.ndarray:
    """Whether suffix (a, la) comes before (b, lb), or is equal where ``or_equal``."""
    most = np.minimum(la, lb)
    ext = common_extension(p, a, b, most)
    ended = ext == most
    size = len(p.data)
    x, y = p.data[np.minimum(a + ext, size - 1)], p.data[np.minimum(b + ext, size - 1)]
    return np.where(ended, (la < lb) | ((la == lb) & or_equal), x < y)


def sort_suffixes(p: Prefix, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, extension) of suffixes given as stretches, inside groups.

    ``group`` is non-decreasing.  ``order`` lists the stretches sorted by bytes
    within their group; ``extension[i]`` is the verified common prefix of
    ``order[i - 1]`` and ``order[i]``, and -1 at the first of a group.
    """
    n = len(start)
    order = np.arange(n)
    if n == 0:
        return order, np.zeros(0, dtype=np.int64)
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[heads, n])
    head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    place = np.arange(n) - head
    width = 1
    while width < sizes.max():
        at = np.flatnonzero(size > width)  # groups that are one run already stay
        inside, h, m = place[at], head[at], size[at]
        run = inside // width
        left = run % 2 == 0
        pair = (run // 2) * 2 * width
        s0 = np.where(left, pair + width, pair)
        s1 = np.minimum(s0 + width, m)
        lo, hi = np.minimum(s0, m), s1.copy()
        hi = np.maximum(lo, hi)
        first = lo.copy()
        me = order[at]
        while True:
            active = np.flatnonzero(lo < hi)
            if not len(active):
                break
            mid = (lo[active] + hi[active]) >> 1
            other = order[h[active] + mid]
            mine = me[active]
            less = _before(p, start[other], length[other], start[mine], length[mine], ~left[active])
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
        rank = lo - first
        new = order.copy()
        new[h + pair + (inside - run * width) + rank] = me
        order = new
        width *= 2
    extension = np.full(n, -1, dtype=np.int64)
    later = np.flatnonzero(place > 0)
    if len(later):
        a, b = order[later - 1], order[later]
        extension[later] = common_extension(p, start[a], start[b], np.minimum(length[a], length[b]))
        bad = _unverified(p, start, length, a, b, extension[later])
        for g in np.unique(head[later[bad]]):  # a hash collision: this group again, by bytes
            m = int(size[g])
            text = p.data.tobytes()
            mine = sorted(order[g : g + m].tolist(), key=lambda i: (text[start[i] : start[i] + length[i]], i))
            order[g : g + m] = mine
            for i in range(1, m):
                x, y = (text[start[j] : start[j] + length[j]] for j in (mine[i - 1], mine[i]))
                extension[g + i] = next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
    return order, extension


def differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the stretches at ``a`` and ``b``, ``size`` bytes long, are not equal byte by byte."""
    bad = np.zeros(len(a), dtype=bool)
    for lo in range(0, len(a), 2048):
        i, e = slice(lo, lo + 2048), size[lo : lo + 2048]
        step = np.arange(int(e.sum())) - np.repeat(np.r_[0, np.cumsum(e)[:-1]], e)
        x, y = data[np.repeat(a[i], e) + step], data[np.repeat(b[i], e) + step]
        bad[lo + np.repeat(np.arange(len(e)), e)[x != y]] = True
    return bad


def _unverified(p: Prefix, start, length, a, b, ext) -> np.ndarray:
    """Which neighbours differ inside their extension, agree beyond it, or stand in the wrong order."""
    bad = differ(p.data, start[a], start[b], ext)
    most = np.minimum(length[a], length[b])
    inner = ext < most
    size = len(p.data)
    u, v = p.data[np.minimum(start[a] + ext, size - 1)], p.data[np.minimum(start[b] + ext, size - 1)]
    return bad | (inner & (u >= v)) | (~inner & (length[a] > length[b]))
