"""Secret scan by a trigram inverted index.

Every rule is a regular expression.  From its syntax tree a Boolean trigram query
is derived that any match must satisfy.  Each batch of texts is a segment with an
inverted index of the trigrams the queries use; intersecting postings gives a
rule's candidate documents, and only those are searched.  Rules without a
mandatory trigram search every text.  Segments are independent: the scan is one
pass without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import arrow_batches, arrow_texts, lean

#: Most alternative strings kept while a query is derived.
MAX_STRINGS = 64
#: The ASCII letters that Python's expressions, ignoring case, also find in letters outside ASCII.
WIDE_LETTERS = frozenset("iks")
REPLACEMENT = "[SECRET]"
#: Bytes of text indexed at a time.
SEGMENT = 1 << 21


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    min_length: int = 0  # of ``group``; shorter matches are dropped after matching
    group: int = 0


#: Base rules, then further ones; the order ranks kinds that start at one place.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", re.A, 16),
    Rule("hex", r"[0-9a-f]+", re.A, 32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", re.A),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", re.A),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", re.A),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", re.A),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", re.A),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}", re.A),
)
RULES = BASE_RULES + MORE_RULES


# --- Boolean trigram queries: True (no condition), ("tri", s), ("and", [...]) or ("or", [...])


def _join(op: str, parts: list):
    if op == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: set[str]):
    """The condition that one of ``strings`` occurs."""
    return _join("or", [_join("and", [("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _node(op, arg, flags: int):
    """(finite set of lower-case strings the node can match, or None; query beside it)."""
    # Without regard to case, and beyond ASCII, these letters also match letters outside ASCII.
    wide = WIDE_LETTERS if flags & re.I and not flags & re.A else frozenset()
    if op is sre.LITERAL:
        return {chr(arg).lower()} if arg < 128 and chr(arg).lower() not in wide else None, True
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL and value < 128:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] < 128 and value[1] - value[0] < MAX_STRINGS:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars if len(chars) <= 8 and not chars & wide else None), True
    if op is sre.SUBPATTERN:
        _, added, removed, body = arg
        return _sequence(body, (flags | added) & ~removed)
    if op is sre.BRANCH:
        found = [_sequence(x, flags) for x in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= MAX_STRINGS:
            return set().union(*(e for e, _ in found)), True
        return None, _join("or", [q if e is None else _of_strings(e) for e, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = arg
        exact, query = _sequence(body, flags)
        if exact is not None and most == 1 and least == 0:
            return exact | {""}, True
        if exact is not None and least == most and len(exact) ** least <= MAX_STRINGS and least <= 16:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in exact}
            return out, True
        if least:
            return None, query if exact is None else _of_strings(exact)
        return None, True
    if op in (sre.AT, sre.ASSERT_NOT):
        return {""}, True
    return None, True


def _sequence(nodes, flags: int):
    current, query, exact = {""}, [], True
    for op, arg in nodes:
        strings, beside = _node(op, arg, flags)
        if strings is not None and len(current) * len(strings) <= MAX_STRINGS:
            current = {a + b for a in current for b in strings}
            continue
        query += [_of_strings(current), beside]
        current, exact = (strings if strings is not None else {""}), False
    if exact:
        return current, True
    return None, _join("and", [*query, _of_strings(current)])


def trigram_query(pattern: str, flags: int = 0):
    """A Boolean query over lower-case trigrams that holds for every text with a match; True if there is none."""
    parsed = parser.parse(pattern, flags)
    exact, query = _sequence(parsed, parsed.state.flags)
    return query if exact is None else _of_strings(exact)


def query_trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(query_trigrams(q) for q in query[1]))


class Scanner:
    """Compiled rules with their queries; finds spans in batches of texts."""

    def __init__(self, rules=RULES):
        import numpy as np

        self.rules = rules
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.ids = {t: i + 1 for i, t in enumerate(sorted(set().union(*(query_trigrams(q) for q in self.queries))))}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.ids.items():
            b = t.encode()
            self.table[b[0] << 16 | b[1] << 8 | b[2]] = i
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def postings(self, offsets, data) -> dict[int, object]:
        """Trigram id -> sorted documents (their numbers in the batch), segment by segment."""
        import numpy as np

        pairs = []
        lo, hi = int(offsets[0]), int(offsets[-1])
        for at in range(lo, max(lo, hi - 2), SEGMENT):
            piece = self.lower[data[at : min(hi, at + SEGMENT + 2)]].astype(np.int32)
            hits = self.table[piece[:-2] << 16 | piece[1:-1] << 8 | piece[2:]]
            found = np.flatnonzero(hits)
            if len(found):
                docs = np.searchsorted(offsets, at + found, side="right") - 1
                pairs.append(np.unique(hits[found].astype(np.int64) << 40 | docs))
        if not pairs:
            return {}
        every = np.unique(np.concatenate(pairs))
        tri, docs = every >> 40, every & ((1 << 40) - 1)
        cuts = np.flatnonzero(np.diff(tri)) + 1
        return {int(t[0]): d for t, d in zip(np.split(tri, cuts), np.split(docs, cuts), strict=True)}

    def candidates(self, query, postings, n: int):
        import numpy as np

        if query is True:
            return np.arange(n)
        if query[0] == "tri":
            return postings.get(self.ids[query[1]], np.zeros(0, np.int64))
        found = None
        for q in query[1]:
            docs = self.candidates(q, postings, n)
            if found is None:
                found = docs
            else:
                found = np.intersect1d(found, docs) if query[0] == "and" else np.union1d(found, docs)
            if query[0] == "and" and not len(found):
                break
        return found

    def spans(self, column) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
        """Texts (null: empty) and their spans as (start, rank of kind, end), sorted."""
        offsets, data = arrow_texts(column)
        texts = [x or "" for x in column.to_pylist()]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        index = self.postings(offsets, data)
        for rank, (rule, regex, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            for i in self.candidates(query, index, len(texts)):
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.min_length:
                        out[i].append((m.start(), rank, m.end()))
        return texts, [sorted(x) for x in out]


def scan_secrets(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``id_col`` and ``spans``: all spans of every record's whole text, by start and then rule order.

    Places are code points, ends exclusive.  Null and empty texts have no spans, null
    ids are passed through, very long texts are scanned whole (their index is made
    ``SEGMENT`` by segment); repeated rows are scanned alike; an empty table gives an
    empty result; further columns, of any name, are ignored.
    """
    arrow_batches(records.sparkSession)
    id_type = records.schema[id_col].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            _, spans = scanner.spans(batch.column(1))
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=kind)], names=[id_col, "spans"])

    return records.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        lean(scan), f"`{id_col}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(records: DataFrame, text_col: str = "text", rules=RULES, replacement: str = REPLACEMENT) -> DataFrame:
    """``records`` with every span (overlapping ones as one) of ``text_col`` replaced.

    Null texts stay null, empty ones empty; very long ones are redacted whole;
    repeated rows fare alike; other columns, of any name, stay; an empty table stays empty.
    """
    arrow_batches(records.sparkSession)

    def clean(batches):
        import pyarrow as pa

        scanner = Scanner(rules)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, spans = scanner.spans(batch.column(at))
            valid = batch.column(at).is_valid().to_pylist()
            out = []
            for text, found, there in zip(texts, spans, valid, strict=True):
                parts, end = [], 0
                for a, _, b in found:
                    if a >= end:
                        parts += [text[end:a], replacement]
                    end = max(end, b)
                out.append("".join([*parts, text[end:]]) if there else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string()) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return records.mapInArrow(lean(clean), records.schema)
