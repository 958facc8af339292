"""Shared plumbing: table access, shared-folder scratch tables, small SQL helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.sources.scratch import materialised as write_table  # noqa: F401  the operators' name for it
from convoframe.sources.ship import ship_package

#: The separators of the word definition used by all operators here.
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Files a core for tables that take much work to make; for those that built-in functions make from whole texts.
HEAVY = 2
SCANNED = 8

#: Rows in an Arrow batch; texts can be long, so batches are short.
ARROW_ROWS = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Prepares a session for operators that send whole texts to Python: short batches, and this package on the workers."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def lean(batches_to_batches):
    """Wraps a function over Arrow batches: when a task ends, memory its worker keeps free goes back to the system.

    Workers are reused from task to task, so what one operator needed at its peak
    would otherwise stay with the executor.
    """

    def run(batches):
        yield from batches_to_batches(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once per row and passes it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut_into(key: Column, n: int) -> Column:
    """An even bucket 0..n-1 from a 64-bit hash, in the order of the hash read as unsigned from its top bits."""
    return F.shiftrightunsigned(key, 40) * F.lit(n) / F.lit(1 << 24)


def arrow_texts(column):
    """(offsets, bytes) of an Arrow string column as numpy arrays; null texts are empty."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def arrow_ints(column):
    """Numpy values of an Arrow integer column that has no nulls."""
    import numpy as np

    return np.asarray(column.to_numpy(zero_copy_only=False))


def count_at_most(key, bounds: list):
    """How many of the sorted ``bounds`` are <= key, by two short scans of literal arrays (null key: null)."""
    if not bounds:
        return F.when(key.isNotNull(), F.lit(0))
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    table = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(table, block), lambda b: b <= key))
    return F.when(key.isNotNull(), F.when(block == 0, 0).otherwise((block - 1) * step + inside).cast("int"))
