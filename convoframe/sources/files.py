"""Listing files through Spark's own file systems."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileInfo:
    path: str
    folder: str
    modified: int
    size: int


def listed(spark: SparkSession, pattern: str) -> list[FileInfo]:
    """Files that match a glob, sorted by path; hidden folders are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path) or []
    out = [FileInfo(str(s.getPath().toString()), s.getPath().getParent().getName(), s.getModificationTime(), s.getLen()) for s in found if s.isFile()]
    return sorted((f for f in out if not f.folder.startswith(".")), key=lambda f: f.path)
