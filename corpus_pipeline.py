"""The corpus pipeline: from raw documents to packed training sequences.

Five stages, each one of the operators of ``convoframe.llm``: language ID,
near-duplicate removal, secret redaction, mixing to source targets, packing.
Every stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.llm.common import HEAVY, read_table, write_table
from convoframe.llm.langid import keep_identified
from convoframe.llm.langid import train as train_languages
from convoframe.llm.mixing import mix_to_targets
from convoframe.llm.neardup import near_duplicates
from convoframe.llm.packing import pack
from convoframe.llm.secrets import redact_secrets
from convoframe.sources import scratch

#: Up to so many rows (a few numbers each) are sent to the scan of the texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that names a row: ``doc_id``, or a number given once where ids repeat or are null.

    Numbered rows are written, as a number made again may fall on another row.
    """
    most, nulls = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.max(F.col("doc_id").isNull().cast("int"))).first()
    if most <= 1 and not nulls:
        return docs, "doc_id"
    row = _unused(docs, "_row")
    return write_table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows", files_per_core=HEAVY), row


def _sized(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, ``n_chars`` (if there is one) counted again."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is found; learns from labelled rows outside the held-out third.

    Null, empty and letterless texts are rejected.  Rows that repeat fare alike,
    with null ids too; long texts are read whole; extra columns of any name stay;
    an empty table stays empty.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return keep_identified(docs, train_languages(docs.filter(~held_out)))


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least id (the first read where ids repeat).

    Shingles are five words long, similar is 0.8 or more.  Null and empty texts
    are in no group and stay; extra columns of any name stay; an empty table stays
    empty.
    """
    keyed, key = _keyed(docs)
    name = _unused(keyed, "_kept")
    kept = write_table(near_duplicates(keyed, id_col=key, width=5, percent=80).filter("kept").select(F.col(key).alias(name)), "kept")
    return keyed.join(_sized(kept), F.col(key) == F.col(name), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced.

    Null texts stay null; repeated rows are treated alike; long texts are read
    whole; extra columns of any name stay; an empty table stays empty.
    """
    return _as_before(redact_secrets(docs), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; where it takes a part, that copy has its first words, joined by spaces.

    Texts without words are not taken.  Repeated rows, also of null ids, are taken
    each by itself; a null source is one of its own; extra columns of any name are
    copied; an empty table stays empty.
    """
    keyed, key = _keyed(docs)
    name, copies, words, copy = (_unused(keyed, x) for x in ("_taken", "_copies", "_part", "_copy"))
    mixed = mix_to_targets(keyed, weights=(5, 2, 1), share=1.5, cap=2.0, id_col=key)
    part = F.col("taken") - F.col("copies") * F.col("size")
    taken = write_table(mixed.filter("taken > 0").select(F.col(key).alias(name), F.col("copies").cast("int").alias(copies), part.cast("int").alias(words)), "taken")
    rows = keyed.join(_sized(taken), F.col(key) == F.col(name))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies) + F.when(F.col(words) > 0, 1).otherwise(0))))
    first = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.col(words)), " ")
    return _as_before(rows.withColumn("text", F.when(F.col(copy) <= F.col(copies), F.col("text")).otherwise(first)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 ids.

    A null or empty text is its end id; repeated rows are packed each; extra columns
    are left out; an empty table packs to nothing.
    """
    return pack(docs, with_ids=False)


STAGES = [("language", language), ("neardup", neardup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The stages' models and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; what a stage left in the shared folder goes when its result is written."""
    docs, last = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch.noted() as mine:
            docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}", files_per_core=HEAVY)
        scratch.drop(spark, last + mine[:-1])
        last = mine[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
