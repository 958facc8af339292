"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where the tables written by the run at hand are noted, if it asked for that.
_RUN: ContextVar[list[str] | None] = ContextVar("scratch_run", default=None)
#: Input bytes (as stored) behind one file of a scratch table.
TASK_BYTES = 32 << 20
#: What makes a plan more than a scan.
_WORK = re.compile(r"\b(Join|Aggregate|Window|Sort|Generate|Repartition\w*|MapIn\w+)\b")


def checkpoint_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own on a local master (tests), an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="convoframe-"))
    return context._jsc.sc().getCheckpointDir().get()


def input_bytes(df: DataFrame) -> int:
    """Stored bytes of all inputs of a plan, each scan counted; 0 where Spark doesn't know them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def materialised(df: DataFrame, tag: str, files_per_core: int = 1, work: int = 1) -> DataFrame:
    """``df`` written to the shared folder and read back: its plan starts at files, and it is computed once.

    Partitions are merged, without a shuffle, to one for each ``TASK_BYTES`` of input
    (``work`` times as many where rows are multiplied on the way), and at least ``files_per_core`` for each core: a file costs its executor more
    than a few rows do, and tasks must not grow with the data.  Where executors come
    and go, the cores are not known and nothing is merged.  What is not dropped
    before goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{tag}-{uuid.uuid4().hex}"
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true":
        cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        df = df.coalesce(max(files_per_core * cores, -(-input_bytes(df) * work // TASK_BYTES)))
    df.write.parquet(path)
    if _RUN.get() is not None:
        _RUN.get().append(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, tag: str) -> DataFrame:
    """``df`` for several readers: itself where it is a plain scan, else written."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return materialised(df, tag) if _WORK.search(plan) else df


@contextmanager
def noted() -> Iterator[list[str]]:
    """Notes the scratch tables that are written meanwhile, by this thread, to be dropped when they have served."""
    before = _RUN.set([])
    try:
        yield _RUN.get()
    finally:
        _RUN.reset(before)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables; results that still read them must be written before."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(conf).delete(hadoop, True)


def last_only(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` writes last; those it wrote on the way are dropped."""
    with noted() as made:
        out = make()
    drop(spark, made[:-1])
    if _RUN.get() is not None:
        _RUN.get().append(made[-1])
    return out
