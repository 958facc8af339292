"""Contact files: ``<data>/<contact>/users.json``, a map from id to record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.functions.text import not_blank
from convoframe.sources.files import listed

RECORD = "map<string, struct<nickname: string, remark: string>>"
SCHEMA = "contact_id string, nickname string, remark string"


def user_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row for each id in each file; files that are no JSON map give none."""
    paths = [f.path for f in listed(spark, f"{data_dir}/*/users.json")]
    if not paths:
        return spark.createDataFrame([], SCHEMA + ", file string")
    files = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", RECORD).alias("m"))
    return files.select("file", F.explode("m").alias("contact_id", "r")).select("contact_id", "r.nickname", "r.remark", "file")


def last_records(rows: DataFrame) -> DataFrame:
    """Whole records, the last file's winning."""
    return rows.groupBy("contact_id").agg(F.max_by(F.struct("nickname", "remark"), "file").alias("r")).select("contact_id", "r.nickname", "r.remark")


def first_names(rows: DataFrame) -> DataFrame:
    """Field by field, the first file's non-blank value."""
    first = lambda c: F.coalesce(F.min_by(not_blank(F.col(c)), F.when(not_blank(F.col(c)).isNotNull(), F.col("file"))), F.lit("")).alias(c)
    return rows.groupBy("contact_id").agg(first("nickname"), first("remark"))
