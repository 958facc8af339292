"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Texts are tokenized and cut into pieces of at most one sequence.  The histogram
of piece lengths (one count a length, however many pieces) is packed on the
driver: lengths are placed longest first, each into the shortest open packing
pattern, and patterns carry counts; a pattern opened for a length takes as many
of its pieces as fit, so a hot length fills sequences too.  A pattern and a
length then own a range of ranks; pieces, ranked within their length, find their
sequence and offset in those ranges.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe.llm.common import HEAVY, arrow_batches, cut_into, lean, write_table

SEQUENCE = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: The settings of a vocabulary that drops white space before it splits.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Distinct white-space-free strings whose ids a worker remembers, in each of two generations, and the most bytes of one.
CACHE = 300_000
CACHED_BYTES = 64
#: Pieces of a length that one bucket ranks; with more than ``MAX_BUCKETS`` times as many pieces, buckets grow.
PIECE_ROWS = 500
MAX_BUCKETS = 1_000_000


class _Ids:
    """Ids of texts as little-endian 32-bit bytes, through a bounded cache by word."""

    def __init__(self, vocabulary: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            declared = json.load(f)
        self.by_words = declared["normalizer"] == WORD_NORMALIZER and declared["pre_tokenizer"] == WORD_SPLITS and declared["model"]["type"] == "BPE"
        self.byte_names = {i: c for i, c in enumerate(_byte_names())}
        self.tails: dict[str, bytes] = {"": b""}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a string without white space.

        Latin letters with closing punctuation split in these two, so the merges
        apply to each as it is; all else takes the tokenizer's whole path.
        """
        core = word.rstrip(".,;:!?")
        low = core.lower()
        if not low.isalpha() or max(low) >= "\u0130":
            return self._whole(word)
        named = low if low.isascii() else low.encode("utf-8").decode("latin-1").translate(self.byte_names)
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(named)], dtype="<u4").tobytes()
        tail = word[len(core) :]
        found = self.tails.get(tail)
        if found is None:
            found = self._whole(tail)
            if len(tail) <= 4:
                self.tails[tail] = found
        return ids + found

    def text(self, text: str) -> bytes:
        if not self.by_words:
            return self._whole(text)
        # Such a vocabulary drops white space before it splits, so no token spans ASCII white space
        # and a text's ids are those of its words, joined.
        words = text.encode("utf-8").split()
        new = set(words).difference(self.young)
        if new:
            if len(self.young) + len(new) > CACHE:  # what was not met since the last turn is forgotten
                self.old, self.young = self.young, {}
                new = set(words)
            unknown = []
            for w in new:
                ids = self.old.get(w)
                if ids is None:
                    unknown.append(w)
                else:
                    self.young[w] = ids
            once: dict[bytes, bytes] = {}
            for w in unknown:
                (self.young if len(w) <= CACHED_BYTES else once)[w] = self._word(w.decode("utf-8"))
            if once:  # long strings are not remembered
                return b"".join([once[w] if len(w) > CACHED_BYTES else self.young[w] for w in words])
        return b"".join(map(self.young.__getitem__, words))


def _byte_names() -> list[str]:
    """The characters by which byte-level vocabularies name bytes: printable Latin-1 by itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


_WORKER: dict[str, _Ids] = {}


def worker_ids(vocabulary: str) -> _Ids:
    """The tokenizer of this worker process; its cache serves all tasks the process runs."""
    if vocabulary not in _WORKER:
        _WORKER.clear()
        _WORKER[vocabulary] = _Ids(vocabulary)
    return _WORKER[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def tokenize_pieces(
    records: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, sequence: int = SEQUENCE, with_ids: bool = True
) -> DataFrame:
    """Pieces of every text: ``id_col, start, length, ids_crc32, doc_tokens`` and, ``with_ids``, the ids themselves.

    A text's ids end with ``END_ID``; a null or empty text has that id only.  Very
    long texts are tokenized whole; null ids are passed through; repeated rows are cut
    each; an empty table has no pieces; further columns, of any name, are ignored.
    """
    arrow_batches(records.sparkSession)
    id_type = records.schema[id_col].dataType.simpleString()
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        import pyarrow as pa

        ids = worker_ids(vocabulary)
        for batch in batches:
            rows, out, kept = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = (ids.text(text) if text else b"") + end
                total = len(data) // 4
                for start in range(0, total, sequence):
                    part = data[4 * start : 4 * (start + sequence)]
                    rows.append(i)
                    out.append((start, len(part) // 4, zlib.crc32(part), total))
                    if with_ids:
                        kept.append(np.frombuffer(part, dtype="<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array([r[k] for r in out], pa.int64()) for k in range(4)]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return records.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(cut), schema)


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and their counts: lengths longest first, each into the open pattern with the most room (the shortest pack).

    Pieces that no open pattern has room for open new ones, each stacked with as many of them as fit.
    """
    open_by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if room:
            open_by_room.setdefault(room, []).append((n, pattern))
        else:
            done.append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max((r for r in open_by_room if r >= length), default=None)
            if room is None:
                fit = size // length
                full, rest = divmod(left, fit)
                if full:
                    put((length,) * fit, full, size - fit * length)
                if rest:
                    put((length,) * rest, 1, size - rest * length)
                break
            n, pattern = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
            used = min(n, left)
            if n > used:
                put(pattern, n - used, room)
            left -= used
            put((*pattern, length), used, room - length)
    for room in sorted(open_by_room):
        done += [(pattern, n) for n, pattern in open_by_room[room]]
    return done


def pattern_ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank past the last, first sequence, offset): who fills which slot of which sequences."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            r0 = taken.get(length, 0)
            rows.append((length, r0, r0 + n, base, offset))
            taken[length] = r0 + n
            offset += length
        base += n
    return rows


def place_pieces(pieces: DataFrame, sequence: int = SEQUENCE, key_cols: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (a ``length`` column, 1 to ``sequence``).

    Pieces of one length are interchangeable; their ranks follow a hash of
    ``key_cols``.  A length with many pieces is ranked in several buckets, whose
    counts are summed up before them, so no task ranks all pieces of a length.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``sequence`` rows
    ranges = pattern_ranges(pack_histogram(counts, sequence))
    schema = "length long, _r0 long, _r1 long, _base long, offset long"
    table = spark.createDataFrame(ranges, schema)  # by lengths and patterns, not by pieces
    most = max(PIECE_ROWS, sum(counts.values()) // MAX_BUCKETS)
    per_length = [max(1, -(-counts.get(length, 0) // most)) for length in range(1, sequence + 1)]
    buckets = F.element_at(F.array(*map(F.lit, per_length)), F.col("length").cast("int")) if max(per_length) > 1 else F.lit(1)
    keyed = pieces.withColumn("_key", F.xxhash64(*key_cols))
    keyed = keyed.withColumn("_bucket", cut_into(F.col("_key"), 1 << 20).cast("long") * buckets / F.lit(1 << 20)).withColumn("_bucket", F.col("_bucket").cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over bucket counts
    starts = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_bucket").orderBy("_key", *key_cols)
    ranked = keyed.withColumn("_rn", F.row_number().over(inside) - 1).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_rn"))
    at = (ranked["length"] == table["length"]) & (ranked["_rank"] >= table["_r0"]) & (ranked["_rank"] < table["_r1"])
    placed = ranked.join(F.broadcast(table), at)
    return placed.select(*[ranked[c] for c in pieces.columns], (F.col("_base") + F.col("_rank") - F.col("_r0")).alias("sequence_id"), table["offset"])


def pack(
    records: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, sequence: int = SEQUENCE, with_ids: bool = True
) -> DataFrame:
    """Packs all texts into sequences of at most ``sequence`` ids.

    One row a piece: ``id_col, start, length, ids_crc32, doc_tokens[, ids],
    sequence_id, offset``.  Pieces of one sequence tile it from 0 without gaps;
    every id of every text lies in one piece.  Null texts count as empty (their
    end id only); repeated rows are packed each; an empty table packs to nothing;
    further columns are ignored.
    """
    pieces = write_table(tokenize_pieces(records, id_col, text_col, vocabulary, sequence, with_ids), "pack-pieces", files_per_core=HEAVY)
    return place_pieces(pieces, sequence, (id_col, "start"))


def padding(packed: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """One row: sequences, ids, and the share of padding if every sequence is padded to ``sequence``."""
    return packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("ids")).withColumn("padding", 1 - F.col("ids") / (F.col("sequences") * sequence))

