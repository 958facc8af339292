"""Which input files were processed: paths with fingerprints, as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, fingerprint string"


def unprocessed(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest lacks, or has with another fingerprint."""
    return found.join(manifest, ["path", "fingerprint"], "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def unreadable(error: Exception) -> bool:
    """Whether an error says that a table's files are no Parquet (and not that storage or cluster failed)."""
    return any(sign in str(error) for sign in ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA"))


def set_aside(spark: SparkSession, path: str) -> None:
    """Moves a table out of the way; nothing of it is deleted."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(hadoop(path), hadoop(f"{path}.unreadable-{uuid.uuid4().hex}")):
        raise OSError(f"could not move {path}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; empty if there is none, and if Spark finds no Parquet in it, which is then set aside."""
    if exists(spark, path):
        try:
            return spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001  the classes differ by Spark version
            if not unreadable(e):
                raise
            set_aside(spark, path)
    return spark.createDataFrame([], SCHEMA)


def record(done: DataFrame, path: str) -> None:
    """Appends processed files; a later fingerprint of a path adds a row."""
    done.select("path", "fingerprint").write.mode("append").parquet(path)
