"""Exact removal of repeated byte strings by suffix sorting.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier.  Only
suffixes that can repeat are sorted:

1. Every ``LENGTH``-byte string holds an anchor, the ``GRAM``-byte gram with the
   least hash in it, chosen by content alone; so equal strings meet at equal
   anchors, and a text has one anchor for some 40 bytes.
2. Anchors are dealt by hash; an anchor met once is dropped, of the others the
   contexts (all strings around them) are fetched.
3. Contexts that share an anchor are suffix-sorted forwards and backwards by hash
   comparison (see ``suffixsort``).  Equal contexts are one entry of the sort: the
   earliest stands for all that agree with it byte by byte.  Two contexts share a
   string at an offset if their common extensions to both sides reach far enough;
   classes of equal extensions give the earliest start of each string.

Hashes only bring contexts together.  Every byte that goes was compared: with an
equal context's, or in the sort's verified extensions.  A task that reads texts
already lets one context stand for those equal to it among what it holds, so a
passage that occurs everywhere does not send all its contexts to one place.

Runs of removed strings go back to their documents by id.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe.llm.common import HEAVY, arrow_batches, arrow_texts, count_at_most, lean, write_table
from convoframe.sources.scratch import input_bytes

LENGTH = 100
GRAM = 24
#: Offsets an anchor can have in a string.
OFFSETS = LENGTH - GRAM + 1
#: Bytes of text handled by one numpy pass, and anchors gathered before a task sends them.
PIECE = 1 << 17
FLUSH = 400_000
#: Bytes of contexts sorted at a time.
SLICE = 1 << 19
#: An anchor met more often is dealt on: equal contexts by themselves, and if many are left, by single strings.
HOT_CONTEXTS = 20_000
#: Stored bytes of texts behind one bucket.
BUCKET_BYTES = 8 << 20
#: Up to so many ids (16 bytes each) are sent to the scan of the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Where ids must be numbered first: ids a range is meant to hold, and the most ranges made.
RANGE_ROWS = 50_000
MAX_RANGES = 4_096

#: What is known of an anchor, in the lowest bits of its code: place << 18 | salt << 2 | state.
SETTLED, OPEN, HOT, COPY = 0, 1, 2, 3


def _code(place, state, salt=0):
    return place << 18 | salt << 2 | state


def _least(h: np.ndarray, width: int, op) -> np.ndarray:
    """Sliding ``op`` (minimum or maximum) over ``width`` values, by doubling."""
    size, out = 1, h
    while size * 2 <= width:
        out = op(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def _context_marks(prefix, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    from convoframe.llm.wordhash import mix64

    whole = prefix.of(at - left, left + GRAM + right)
    return mix64(whole ^ mix64((left * (LENGTH + 1) + right + 1).astype(np.uint64)))


def anchors(data: np.ndarray):
    """(place, gram hash, context hash) of a text's anchors; texts under ``LENGTH`` bytes have none."""
    from convoframe.llm.suffixsort import Prefix

    n, out = len(data), []
    for s0 in range(0, n - LENGTH + 1, PIECE):
        s1 = min(n - LENGTH + 1, s0 + PIECE)  # strings that start in [s0, s1)
        lo, hi = max(0, s0 - LENGTH), min(n, s1 + 2 * LENGTH)
        prefix = Prefix(data[lo:hi])
        grams = prefix.grams(GRAM)
        mine = grams[s0 - lo : s1 - lo + OFFSETS - 1]
        rank = (mine >> np.uint64(32)).astype(np.uint32)
        least = _least(rank, OFFSETS, np.minimum)
        padded = np.concatenate([np.zeros(OFFSETS - 1, np.uint32), least, np.zeros(OFFSETS - 1, np.uint32)])
        at = np.flatnonzero(_least(padded, OFFSETS, np.maximum) == rank) + s0 - lo
        left, right = np.minimum(OFFSETS - 1, at + lo), np.minimum(OFFSETS - 1, n - lo - at - GRAM)
        out.append((at + lo, grams[at], _context_marks(prefix, at, left, right)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place, gram, mark = (np.concatenate([x[k] for x in out]) for k in range(3))
    if len(out) > 1:
        place, first = np.unique(place, return_index=True)
        gram, mark = gram[first], mark[first]
    return place, gram, mark


def hashes_at(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash, context hash) of the anchors at sorted places ``at``, piece by piece."""
    from convoframe.llm.suffixsort import Prefix

    n, out = len(data), []
    for part in np.split(at, np.flatnonzero(np.diff(at // PIECE)) + 1):
        lo, hi = max(0, int(part[0]) - OFFSETS), min(n, int(part[-1]) + LENGTH)
        prefix = Prefix(data[lo:hi])
        left, right = np.minimum(OFFSETS - 1, part), np.minimum(OFFSETS - 1, n - part - GRAM)
        out.append((prefix.grams(GRAM)[part - lo], _context_marks(prefix, part - lo, left, right)))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _shift(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits as six bytes a value; buckets are made from the lower ones."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 2:]


def _unshift(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), 8), dtype=np.uint8)
    out[:, 2:] = b
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _deltas(x: np.ndarray) -> bytes:
    """Differences, byte planes apart: what compresses of a sorted column."""
    return np.diff(x, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _undeltas(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).reshape(-1).view("<i8"))


def _planes(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unplanes(b: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(b) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8).reshape(size, -1).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def _frame(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes() + b"".join(parts)


def _unframe(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): rows sorted by ``keys`` (the first the slowest, ties by row), and marks of each key's first row."""
    order = np.lexsort(keys[::-1])
    first = np.ones(len(order), dtype=bool)
    if len(order):
        same = np.ones(len(order) - 1, dtype=bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        first[1:] = ~same
    return order, first


def _gather(batches, buckets: int):
    """Step 1: each text's anchors, by bucket of the anchor.

    Of the contexts a task holds at a time, the earliest stands for those equal to
    it byte by byte; these are settled and go by bucket of the document, from
    ``buckets`` on.
    """
    import pyarrow as pa
    import zstandard

    from convoframe.llm.suffixsort import differ

    pressed = zstandard.ZstdCompressor(level=1)

    def flush(docs, places, grams, marks, sizes, texts):
        d, p, g, m, n = (np.concatenate(x) for x in (docs, places, grams, marks, sizes))
        base = np.repeat(np.r_[0, np.cumsum([len(x) for x in texts])[:-1]], [len(x) for x in places])
        by_place = np.lexsort((p, d))
        d, p, g, m, n, base = (x[by_place] for x in (d, p, g, m, n, base))
        order, first = _first_of(g, m)
        leader = np.empty(len(d), dtype=np.int64)
        leader[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))]
        left, right = np.minimum(OFFSETS - 1, p), np.minimum(OFFSETS - 1, n - p - GRAM)
        lead = (leader == np.arange(len(d))) | (left != left[leader]) | (right != right[leader])
        rest = np.flatnonzero(~lead)
        begin = base + p - left
        lead[rest[differ(np.concatenate(texts), begin[rest], begin[leader[rest]], (left + GRAM + right)[rest])]] = True
        bucket = np.where(lead, (g & np.uint64(0xFFFFFF)).astype(np.int64) % buckets, buckets + d % buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.r_[True, np.diff(bucket[by_bucket]) != 0, True])
        rows = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            i = by_bucket[a:b]
            at = int(bucket[i[0]])
            hashes = [_shift(g[i]).tobytes(), m[i].tobytes()] if at < buckets else [b"", b""]
            rows.append((at, pressed.compress(_frame([*hashes, _deltas(d[i]), _planes(p[i], 4)]))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    held, total, size = ([], [], [], [], [], []), 0, 0
    for batch in batches:
        offsets, data = arrow_texts(batch.column(1))
        for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a < LENGTH:
                continue
            place, gram, mark = anchors(data[a:b])
            for x, y in zip(held, (np.full(len(place), doc, np.int64), place, gram, mark, np.full(len(place), b - a, np.int64), data[a:b].copy()), strict=True):
                x.append(y)
            total, size = total + len(place), size + b - a
            if total >= FLUSH or size >= 64 * FLUSH:
                yield flush(*held)
                held, total, size = ([], [], [], [], [], []), 0, 0
    if total:
        yield flush(*held)


def _by_bucket(batches, buckets: int):
    """Blobs of a bucket together, from a stream sorted by bucket; those from ``buckets`` on one by one."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (bucket != now or bucket >= buckets) and held:
                yield now, held
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield now, held


def _meet(batches, buckets: int, hot: int):
    """Step 2: the places of anchors met more than once, and what is to be done with each; as lists by document."""
    import pyarrow as pa
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for bucket, blobs in _by_bucket(batches, buckets):
        parts = [_unframe(plain.decompress(x)) for x in blobs]
        d, p = np.concatenate([_undeltas(x[2]) for x in parts]), np.concatenate([_unplanes(x[3], 4) for x in parts])
        if bucket >= buckets:
            yield from _by_document(pa, d, _code(p, SETTLED), "codes")
            continue
        g = np.concatenate([_unshift(np.frombuffer(x[0], np.uint8).reshape(-1, 6)) for x in parts])
        m = np.concatenate([np.frombuffer(x[1], np.uint64) for x in parts])
        by_place = np.lexsort((p, d))
        g, m, d, p = g[by_place], m[by_place], d[by_place], p[by_place]
        order, first = _first_of(g, m)
        g, d, p = g[order], d[order], p[order]
        group = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
        met, contexts = np.bincount(group)[group], np.bincount(group, weights=first).astype(np.int64)[group]
        # Where an anchor is hot, copies of a context meet its first occurrence apart from the other contexts.
        apart = met > hot
        head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        salt = (np.arange(len(first)) - head - 1) // hot
        copy = apart & ~first
        state = np.where(copy, COPY, np.where(apart & (contexts > hot), HOT, OPEN))
        keep = (met > 1) & (copy | (contexts > 1) | ~apart)
        dd, code = [d[keep]], [_code(p, state, np.where(copy, salt, 0))[keep]]
        salted = np.flatnonzero(copy & ((salt != np.r_[-1, salt[:-1]]) | np.r_[True, ~copy[:-1]]))  # the first copy of each salt: its leader goes there too
        dd.append(d[head[salted]])
        code.append(_code(p[head[salted]], COPY, salt[salted]))
        yield from _by_document(pa, np.concatenate(dd), np.concatenate(code), "codes")


def _by_document(pa, docs: np.ndarray, codes: np.ndarray, name: str):
    if not len(docs):
        return
    order = np.lexsort((codes, docs))
    docs, codes = docs[order], codes[order].astype("<i8")
    cuts = np.r_[np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]), len(docs)]
    values = pa.array(codes, pa.int64())
    for at in range(0, len(cuts) - 1, 20_000):
        part = cuts[at : at + 20_001]
        lists = pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), values.slice(part[0], part[-1] - part[0]))
        yield pa.RecordBatch.from_arrays([pa.array(docs[part[:-1]], pa.int64()), lists], names=["_d", name])


def _contexts(batches, buckets: int):
    """Step 3: the bytes around open anchors, by bucket; around hot ones, each string by itself."""
    import pyarrow as pa
    import zstandard

    from convoframe.llm.wordhash import mix64

    plain, pressed = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)

    def flush(held):
        key, doc, place, left, size, seen = ([x[k] for x in held] for k in range(6))
        key, doc, place, left, size = (np.concatenate(x) for x in (key, doc, place, left, size))
        data = b"".join(seen)
        start = np.r_[0, np.cumsum(size)[:-1]]
        bucket = (key & np.uint64(0xFFFFFF)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        view = np.frombuffer(data, np.uint8)
        rows = []
        for b in np.flatnonzero(np.diff(ends)):
            i = order[ends[b] : ends[b + 1]]
            take = np.repeat(start[i] - np.r_[0, np.cumsum(size[i])[:-1]], size[i]) + np.arange(int(size[i].sum()))
            rows.append((int(b), pressed.compress(_frame([key[i].astype("<u8").tobytes(), doc[i].astype("<i8").tobytes(), _planes(place[i], 4), left[i].astype(np.uint8).tobytes(), size[i].astype(np.uint8).tobytes(), view[take].tobytes()]))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    held, total = [], 0
    for batch in batches:
        for doc, z, lists in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            codes = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists])
            codes = np.sort(codes[codes % 4 != SETTLED])
            if not len(codes):
                continue
            data = np.frombuffer(plain.decompress(z), np.uint8)
            n = len(data)
            at, hot, copy = codes >> 18, codes % 4 == HOT, codes % 4 == COPY
            left, right = np.minimum(OFFSETS - 1, at), np.minimum(OFFSETS - 1, n - at - GRAM)
            grams, marks = hashes_at(data, at)
            salt = (codes >> 2 & 0xFFFF).astype(np.uint64) + np.uint64(1)
            grams = np.where(copy, mix64(grams ^ mix64(marks + salt)), grams)
            for mark in (False, True):
                i = np.flatnonzero(hot == mark)
                if not len(i):
                    continue
                key, place, lo, hi = grams[i], at[i], left[i], right[i]
                if mark:  # one row a string: it starts ``back`` bytes before the anchor
                    back = np.concatenate([np.arange(max(0, OFFSETS - 1 - r), x + 1) for x, r in zip(lo.tolist(), hi.tolist(), strict=True)])
                    times = np.maximum(0, lo + 1 - np.maximum(0, OFFSETS - 1 - hi))
                    place, key = np.repeat(place, times), np.repeat(key, times)
                    whole = np.array([int.from_bytes(hashlib.blake2b(data[a - b : a - b + LENGTH].tobytes(), digest_size=8).digest(), "little") for a, b in zip(place.tolist(), back.tolist(), strict=True)], dtype=np.uint64)
                    key, lo, hi = mix64(key + whole + back.astype(np.uint64)), back, OFFSETS - 1 - back
                size = lo + GRAM + hi
                begin = place - lo
                take = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
                held.append((key, np.full(len(place), doc, np.int64), place, lo, size, data[take].tobytes()))
                total += int(size.sum())
            if total >= 32 * PIECE:
                yield flush(held)
                held, total = [], 0
    if held:
        yield flush(held)


def repeated_strings(data: np.ndarray, group: np.ndarray, start: np.ndarray, left: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(context, offset) of every string that an earlier context of its group has at the same offset.

    Contexts are adjoining stretches of ``data`` around an anchor, ``left`` bytes
    before it, listed by group and then by precedence.
    """
    from convoframe.llm.suffixsort import Prefix, sort_suffixes

    n = len(group)
    if len(np.unique(group)) == n:
        return []
    right = size - left - GRAM
    # Forwards: what follows from the anchor on.  Backwards: what precedes it, read leftwards.
    phase = (np.arange(len(data)) - np.repeat(start, size)).astype(np.uint8)
    f_order, f_ext = sort_suffixes(Prefix(data, phase), start + left, GRAM + right, group)
    phase = (np.repeat(size, size) - 1 - phase)[::-1].astype(np.uint8)
    b_order, b_ext = sort_suffixes(Prefix(data[::-1].copy(), phase), len(data) - start - left, left, group)
    out = []
    for back in range(OFFSETS):
        ahead = LENGTH - back  # bytes needed from the anchor on
        fits = (left >= back) & (GRAM + right >= ahead)
        if not fits.any():
            continue
        f_class, b_class = np.empty(n, np.int64), np.empty(n, np.int64)
        f_class[f_order] = np.cumsum(f_ext < ahead)
        b_class[b_order] = np.cumsum(b_ext < back)
        i = np.flatnonzero(fits)
        key = f_class[i] * np.int64(n + 2) + b_class[i]
        order = np.argsort(key, kind="stable")  # ties in precedence
        again = np.r_[False, key[order][1:] == key[order][:-1]]
        hit = i[order[again]]
        if len(hit):
            out.append((hit.astype(np.int32), np.full(len(hit), back, np.uint8)))
    return out


def copies_of_earlier(data: np.ndarray, group: np.ndarray, start: np.ndarray, left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Marks contexts that equal an earlier one of their group, byte by byte (as in ``repeated_strings``)."""
    from convoframe.llm.suffixsort import Prefix, differ
    from convoframe.llm.wordhash import mix64

    phase = (np.arange(len(data)) - np.repeat(start, size)).astype(np.uint8)
    whole = mix64(Prefix(data, phase).of(start, size) ^ (left * 256 + size).astype(np.uint64))
    order, first = _first_of(group, whole)
    leader = np.empty(len(group), dtype=np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    same = (leader != np.arange(len(group))) & (left == left[leader]) & (size == size[leader])
    i = np.flatnonzero(same)
    same[i[differ(data, start[i], start[leader[i]], size[i])]] = False
    return same


def _sort_contexts(batches):
    """Step 3, in a bucket: suffix-sorts its contexts and returns the runs of repeated strings by document."""
    import pyarrow as pa
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for _, blobs in _by_bucket(batches, 1 << 31):
        parts = [_unframe(plain.decompress(x)) for x in blobs]
        key = np.concatenate([np.frombuffer(x[0], "<u8") for x in parts])
        doc = np.concatenate([np.frombuffer(x[1], "<i8") for x in parts])
        place = np.concatenate([_unplanes(x[2], 4) for x in parts])
        left = np.concatenate([np.frombuffer(x[3], np.uint8) for x in parts]).astype(np.int64)
        size = np.concatenate([np.frombuffer(x[4], np.uint8) for x in parts]).astype(np.int64)
        data = np.frombuffer(b"".join(x[5] for x in parts), np.uint8)
        start = np.r_[0, np.cumsum(size)[:-1]]
        order = np.lexsort((place, doc, key))
        key, doc, place, left, size, start = (x[order] for x in (key, doc, place, left, size, start))
        # Whole groups at a time, up to about ``SLICE`` bytes, bound the sort's memory.
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        before = np.r_[0, np.cumsum(size)]
        part = before[heads] // SLICE
        cuts = np.r_[heads[np.r_[True, part[1:] != part[:-1]]], len(key)]
        rows, begins, lengths = [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i = np.arange(a, b)
            group = np.cumsum(np.r_[True, key[a + 1 : b] != key[a : b - 1]])
            stretch = lambda i: data[np.repeat(start[i] - np.r_[0, np.cumsum(size[i])[:-1]], size[i]) + np.arange(int(size[i].sum()))]  # noqa: E731, B023
            same = copies_of_earlier(stretch(i), group, before[a:b] - before[a], left[a:b], size[a:b])
            known = i[same & (size[a:b] >= LENGTH)]
            rows.append(known)
            begins.append(place[known] - left[known])
            lengths.append(size[known])
            i, group = i[~same], group[~same]
            # A context left alone in its group has nothing to be compared with.
            alone = np.r_[True, group[1:] != group[:-1]] & np.r_[group[1:] != group[:-1], True]
            i, group = i[~alone], group[~alone]
            if not len(i):
                continue
            for hit, back in repeated_strings(stretch(i), group, np.r_[0, np.cumsum(size[i])[:-1]], left[i], size[i]):
                rows.append(i[hit])
                begins.append(place[i[hit]] - back.astype(np.int64))
                lengths.append(np.full(len(hit), LENGTH, np.int64))
        row, s, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, begins, lengths))
        if not len(row):
            continue
        d = doc[row]
        order = np.lexsort((s, d))
        d, s, n = d[order], s[order], n[order]
        # Runs of neighbouring strings, as (start, length) in one number.
        number = np.cumsum(np.r_[False, d[1:] != d[:-1]]) << 33
        end = np.maximum.accumulate(number + s + n)
        head = np.r_[True, (number + s)[1:] > end[:-1]]
        first = np.flatnonzero(head)
        last = np.r_[first[1:], len(s)] - 1
        yield from _by_document(pa, d[first], s[first] << 32 | (end[last] - number[last] - s[first]), "runs")


def removed_runs(n: int, codes: list, runs: list) -> np.ndarray:
    """Maximal removed runs (start, end) of a text of ``n`` bytes."""
    at = np.concatenate([np.asarray(x, np.int64) for x in codes]) if codes else np.zeros(0, np.int64)
    at = at[at % 4 == SETTLED] >> 18
    lo, hi = np.maximum(0, at - OFFSETS + 1), np.minimum(n, at + LENGTH)
    whole = hi - lo >= LENGTH
    lo, hi = lo[whole], hi[whole]
    if runs:
        more = np.concatenate([np.asarray(x, np.int64) for x in runs])
        lo, hi = np.r_[lo, more >> 32], np.r_[hi, (more >> 32) + (more & 0xFFFFFFFF)]
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    head = np.r_[True, lo[1:] > hi[:-1]]
    first = np.flatnonzero(head)
    return np.stack([lo[first], hi[np.r_[first[1:], len(lo)] - 1]], axis=1)


def _numbered(records: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(``_d``, ``_text``) with one 64-bit number a document, and how numbers map back where ids are not already such numbers.

    Ids that repeat, are null or no integers are numbered in the order of (id,
    text hash), nulls first; equal rows are one document.
    """
    typed = records.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    counts = typed.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.max(F.col("_id").isNull().cast("int"))).first()
    if records.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") and counts[0] <= 1 and not counts[1]:
        return typed.select(F.col("_id").cast("long").alias("_d"), "_text"), None
    hashed = typed.withColumn("_h", F.xxhash64("_text", F.lit(0)))
    distinct = write_table(hashed.groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("_n")), "distinct")
    # Ranges of ids at the quantiles of a hash sample; a number is the rows of the ranges before, and the place inside.
    k = max(1, min(MAX_RANGES, distinct.count() // RANGE_ROWS))
    drawn = sorted(r["_id"] for r in distinct.filter("_id is not null").orderBy(F.xxhash64("_id", "_h")).limit(8 * k).collect())
    bounds = sorted({drawn[i * len(drawn) // k] for i in range(1, k)}) if drawn else []
    ranged = distinct.withColumn("_range", F.coalesce(count_at_most(F.col("_id"), bounds), F.lit(-1)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("c")).select("_range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_range").orderBy(F.asc_nulls_first("_id"), "_h")
    numbered = ranged.withColumn("_rn", F.row_number().over(inside)).join(F.broadcast(starts), "_range")  # at most MAX_RANGES + 1 rows
    numbers = write_table(numbered.select("_id", "_h", "_n", (F.col("_first") + F.col("_rn")).cast("long").alias("_d")), "numbers")
    texts = hashed.dropDuplicates(["_id", "_h"]).alias("t").join(numbers.alias("m"), F.col("t._id").eqNullSafe(F.col("m._id")) & (F.col("t._h") == F.col("m._h")))
    return texts.select("_d", "_text"), numbers


def remove_repeats(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Removes each byte covered by a ``LENGTH``-byte string that also starts earlier.

    Earlier: in a document with a smaller id, or before in the same document;
    strings never cross documents and are judged on the input.  Returns ``id_col,
    n_bytes, n_removed, n_spans, kept_sha256``, and ``kept`` (the bytes left)
    ``with_text``.

    Texts of any length are handled in pieces.  Null texts are empty.  Rows that share an id are ordered by a hash of their
    texts; equal rows are one document, and each gets its result.  An empty table
    gives an empty result; further columns are ignored.
    """
    spark = records.sparkSession
    arrow_batches(spark)
    id_type = records.schema[id_col].dataType.simpleString()
    docs, numbers = _numbered(records, id_col, text_col)
    if numbers is not None:
        docs = write_table(docs, "numbered-texts", files_per_core=HEAVY)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // BUCKET_BYTES)

    blobs = docs.mapInArrow(lean(lambda x: _gather(x, buckets)), "bucket int, blob binary")
    settled = blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(lambda x: _meet(x, buckets, hot_contexts)), "_d long, codes array<long>")
    settled = write_table(settled, "settled", files_per_core=HEAVY)
    ids = write_table(settled.select("_d").distinct(), "touched")
    few = ids.count() <= BROADCAST_IDS
    touched = F.broadcast(ids) if few else ids

    def shrink(batches):
        import pyarrow as pa
        import zstandard

        pressed = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            offsets, data = arrow_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pressed.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["_d", "_z"])

    texts = docs.join(touched, "_d", "left_semi").mapInArrow(lean(shrink), "_d long, _z binary")
    lists = settled.groupBy("_d").agg(F.collect_list("codes").alias("lists"))
    found = write_table(texts.join(lists, "_d"), "touched-texts", files_per_core=HEAVY)
    some_open = F.exists("lists", lambda x: F.exists(x, lambda c: c % 4 != SETTLED))
    contexts = found.filter(some_open).select("_d", "_z", "lists").mapInArrow(lean(lambda x: _contexts(x, buckets)), "bucket int, blob binary")
    runs = contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_sort_contexts), "_d long, runs array<long>")
    runs = write_table(runs, "runs", files_per_core=HEAVY).groupBy("_d").agg(F.collect_list("runs").alias("runs"))

    def finish(batches):
        import pyarrow as pa
        import zstandard

        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, codes, more in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                data = plain.decompress(z)
                gone = removed_runs(len(data), codes, more or [])
                edges = [0, *gone.reshape(-1).tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=["_d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = found.join(runs, "_d", "left").select("_d", "_z", "lists", "runs").mapInArrow(lean(finish), "_d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    bytes_of = F.col("_text").cast("binary")
    same = docs.join(touched, "_d", "left_anti").select("_d", F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(bytes_of, 256).alias("kept_sha256"), (bytes_of if with_text else F.lit(None).cast("binary")).alias("kept"))
    out = changed.unionByName(same)
    if numbers is not None:
        out = out.join(numbers, "_d").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        key = F.col("_id").alias(id_col)
    else:
        key = F.col("_d").cast(id_type).alias(id_col)
    return out.select(key, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
