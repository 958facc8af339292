"""I-Match document fingerprints.

Terms within a band of inverse document frequency form the lexicon.  Random
sub-lexicons are drawn from it, overlapping, each term entering each of them by a
hash: ``DRAWS`` of every share 1/2, 1/4, ... down to 1/2^``RESOLUTIONS``.  A
document's distinct terms in a sub-lexicon, sorted, are hashed to one signature,
and the fingerprint lists them all.  An edit spares the sub-lexicons that have none
of the changed terms, so likeness falls gradually, where one hash over the whole
lexicon would break.

Document frequencies are counted over all documents by 64-bit term hash.  Both ends
of the band are shares of the documents, so the lexicon's size does not grow with
the corpus: a document has ``d`` distinct terms on average, frequencies add up to
``d`` times the documents, and at most ``d / MIN_SHARE`` terms can be that frequent.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoframe.llm.common import arrow_batches, arrow_ints, arrow_texts, count_at_most, lean, write_table

#: The idf band, as document frequencies: at least so many documents and this share of all, at most that share of all.
MIN_DOCUMENTS = 2
MIN_SHARE = 1e-4
MAX_SHARE = 0.10
#: The most terms of a lexicon (8 bytes each); with more in the band (documents of over 1,600 distinct terms on average) its lower end rises.
MAX_TERMS = 1 << 24
#: Sub-lexicons of each share, and how many shares there are.
DRAWS, RESOLUTIONS = 16, 10
_SIGNATURES = DRAWS * RESOLUTIONS
#: A share counts if the two fingerprints fill so many of its signatures.
MIN_FILLED = 8
#: Terms drawn at a time.
_DRAWN = 1 << 14
#: Term hashes of whole documents that a task gathers before it counts them.
_GATHERED = 1 << 21
#: Ids are cut into ranges of about so many rows; beyond the most ranges made, ranges grow.
RANGE_ROWS = 50_000
MAX_RANGES = 4_096


def _terms(hasher, data: np.ndarray) -> np.ndarray:
    """Sorted distinct term hashes of one text."""
    return np.unique(hasher.text(data))


def document_frequencies(records: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, n``: how many documents have each term (its 64-bit hash), over every text, whole.

    Tasks count many documents at a time before terms are shuffled.
    """
    arrow_batches(records.sparkSession)

    def count(batches):
        import pyarrow as pa

        from convoframe.llm.wordhash import WordHasher

        def counted():
            terms, n = np.unique(np.concatenate(gathered), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

        hasher, gathered, size = WordHasher(), [], 0
        for batch in batches:
            offsets, data = arrow_texts(batch.column(0))
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                if b > a:
                    gathered.append(_terms(hasher, data[a:b]))
                    size += len(gathered[-1])
                if size >= _GATHERED:
                    yield counted()
                    gathered, size = [], 0
        if size:
            yield counted()

    counts = records.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(count), "term long, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(records: DataFrame, text_col: str = "text", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, min_share: float = MIN_SHARE, max_terms: int = MAX_TERMS) -> np.ndarray:
    """The sorted hashes of all terms inside the idf band; at most ``max_terms``."""
    documents = records.count()
    least, most = max(min_documents, min_share * documents), max(min_documents, max_share * documents)
    inside = write_table(document_frequencies(records, text_col).filter((F.col("n") >= F.lit(least)) & (F.col("n") <= F.lit(most))), "lexicon")
    if inside.count() > max_terms:
        # Few terms are frequent: the frequencies that at most ``max_terms`` reach are few rows.
        above = inside.groupBy("n").count().orderBy(F.desc("n")).limit(max_terms).toLocalIterator()
        total, least = 0, most + 1
        for r in above:
            total += r["count"]
            if total > max_terms:
                break
            least = r["n"]
        inside = inside.filter(F.col("n") >= F.lit(least))

    def pack(batches):
        import pyarrow as pa

        terms = [arrow_ints(batch.column(0)) for batch in batches]
        if terms:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(terms).tobytes()], pa.binary())], names=["terms"])

    packed = inside.select("term").mapInArrow(lean(pack), "terms binary").collect()  # 8 bytes a term
    return np.sort(np.frombuffer(b"".join(r["terms"] for r in packed), dtype=np.uint64))


class Fingerprinter:
    def __init__(self, marks: np.ndarray):
        from convoframe.llm.wordhash import WordHasher, mix64

        self.hasher, self.mix = WordHasher(), mix64
        self.marks = marks

    def of(self, data: np.ndarray) -> bytes:
        """The fingerprint: 16 bits a signature (0: no terms), share by share; one signature of all terms where none is in the band."""
        every = _terms(self.hasher, data)
        at = np.searchsorted(self.marks, every)
        at[at == len(self.marks)] = 0
        terms = every[self.marks[at] == every] if len(self.marks) else every[:0]
        out = np.zeros(_SIGNATURES, dtype=np.uint64)
        for lo in range(0, len(terms), _DRAWN):
            part = terms[lo : lo + _DRAWN]
            # A bit for each draw; of share 1/2^k where k such words agree.
            words = np.stack([self.mix(part ^ np.uint64((r + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1)) for r in range(-(-RESOLUTIONS // 4))], axis=1)
            words = np.bitwise_and.accumulate(words.view("<u2")[:, :RESOLUTIONS], axis=1)
            term, signature = np.nonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1))
            # Terms are distinct, so a sub-lexicon's running hash depends on its set alone.
            np.add.at(out, signature, self.mix(part ^ np.uint64(0xA24BAED4963EE407))[term])
        if not len(terms):  # nothing in the band: all its terms stand for it
            out[0] = self.mix(every).sum() | np.uint64(1)  # a sum of no terms is 0
        filled = out != 0
        values = (self.mix(out) >> np.uint64(48)).astype("<u2")
        return np.where(filled, np.maximum(values, 1), 0).astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Agreement of filled signatures, 0 to 1: at the least share that fills half of them and the next larger one, or over all.

    The fingerprints' fill alone chooses the shares, not how well they agree.
    Texts with no term in the band fill the first signature only.
    """
    x, y = np.frombuffer(a, "<u2").reshape(RESOLUTIONS, DRAWS), np.frombuffer(b, "<u2").reshape(RESOLUTIONS, DRAWS)
    filled, same = (x != 0) | (y != 0), (x == y) & (x != 0)
    if not filled.any():
        return 1.0
    enough = np.flatnonzero(filled.sum(axis=1) >= MIN_FILLED)
    if len(enough):
        used = slice(max(0, enough[-1] - 1), enough[-1] + 1)
        filled, same = filled[used], same[used]
    return int(same.sum()) / int(filled.sum())


def fingerprint(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: np.ndarray | None = None) -> DataFrame:
    """``id_col, fingerprint`` (hexadecimal) of every whole text; null texts count as empty.

    Equal texts have equal fingerprints.  Without ``marks`` the lexicon is made
    from ``records`` themselves.  Repeated rows each stand, null ids are passed through,
    long texts are read whole, an empty table gives an empty result, and further columns,
    of any name, are ignored.
    """
    marks = lexicon(records, text_col) if marks is None else marks
    arrow_batches(records.sparkSession)
    id_type = records.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        f = Fingerprinter(marks)
        for batch in batches:
            offsets, data = arrow_texts(batch.column(1))
            prints = [f.of(data[a:b]).hex() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=[id_col, "fingerprint"])

    return records.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(run), f"`{id_col}` {id_type}, fingerprint string")


def _quantiles(ids: DataFrame, k: int) -> list:
    """Ids that cut a table into about ``k`` even ranges; those of other types than numbers come from a sample of 20 a range by hash."""
    if isinstance(ids.schema["_id"].dataType, T.NumericType):
        return ids.agg(F.percentile_approx("_id", [i / k for i in range(1, k)], 10 * k)).first()[0]
    some = sorted(r["_id"] for r in ids.filter("_id is not null").distinct().orderBy(F.xxhash64("_id")).limit(20 * k).collect())
    return [some[len(some) * i // k] for i in range(1, k)] if some else []


def compare_with_edits(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text has its last ``floor(n / 3)`` code points replaced by as many
    from the start of the next document in descending id (or all it has; after
    the last: the first).  Texts move once, compressed: ids are cut into ranges at
    approximate quantiles, each range is read in ascending order, and a range also
    gets a copy of the one document below it.  So a document's next is always the
    one read before it.

    Ids may be of any type that Spark orders.  Rows that share an id each stand; the document next to them is the next lower
    id's row with the least text hash.  Null texts are empty, null ids come last;
    long texts are read whole.
    An empty table gives an empty result; further columns are ignored.
    """
    spark = records.sparkSession
    arrow_batches(spark)
    marks = lexicon(records, text_col)
    id_type = records.schema[id_col].dataType.simpleString()
    typed = records.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    ids = typed.select("_id")
    n = ids.count()
    k = max(1, min(MAX_RANGES, max(n // RANGE_ROWS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    bounds = _quantiles(ids, k) if k > 1 and n else []
    at = F.coalesce(count_at_most(F.col("_id"), sorted(set(bounds or []))), F.lit(-1))
    heads = sorted(((r["_range"], r["_head"]) for r in ids.groupBy(at.alias("_range")).agg(F.max("_id").alias("_head")).collect()), key=lambda x: x[0])  # at most MAX_RANGES + 1 rows
    below = spark.createDataFrame([(heads[i][0], heads[i - 1][1]) for i in range(len(heads))], f"_range int, _head {id_type}")  # the lowest range: the first document
    hashed = typed.withColumn("_h", F.xxhash64("_text"))
    guests = hashed.join(F.broadcast(below), F.col("_id").eqNullSafe(F.col("_head"))).groupBy("_range").agg(F.min_by(F.struct("_id", "_text", "_h"), "_h").alias("g"))
    rows = guests.select("_range", F.lit(0).alias("_own"), "g.*").select("_range", "_own", "_id", "_h", "_text").union(hashed.select(at.alias("_range"), F.lit(1), "_id", "_h", "_text"))

    def shrink(batches):
        import pyarrow as pa
        import zstandard

        f, pressed = Fingerprinter(marks), zstandard.ZstdCompressor(level=level)
        for batch in batches:
            offsets, data = arrow_texts(batch.column(4))
            texts = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([pressed.compress(x.tobytes()) for x in texts], pa.binary()), pa.array([f.of(x) for x in texts], pa.binary())], names=["_range", "_own", "_id", "_h", "_z", "_f"])

    small = rows.mapInArrow(lean(shrink), f"_range int, _own int, _id {id_type}, _h long, _z binary, _f binary")
    dealt = small.repartition("_range").sortWithinPartitions("_range", "_own", F.asc_nulls_first("_id"), "_h")

    def finish(batches):
        import pyarrow as pa
        import zstandard

        f, plain = Fingerprinter(marks), zstandard.ZstdDecompressor()
        here, now, first, before = None, None, None, None  # the range, the id, its first row, the first row of the id before
        for batch in batches:
            kept, rows = [], []
            for i, (place, own, key, z, mine) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True)):
                text = plain.decompress(z).decode("utf-8")
                if place != here or not own:
                    here, now, first = place, None, (text, mine)
                    if not own:
                        continue
                if now is None or key != now[0]:
                    before, now, first = first, (key,), (text, mine)
                n = len(text)
                edited = (text[: n - n // 3] + before[0][: n // 3]).encode("utf-8")
                other = f.of(np.frombuffer(edited, np.uint8))
                kept.append(i)
                rows.append((n, hashlib.sha256(edited).hexdigest(), mine.hex(), other.hex(), likeness(mine, other), likeness(mine, before[1])))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(kept, pa.int64()))] + [pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(lean(finish), f"`{id_col}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
