"""Running values over one long timeline without putting it in one partition.

Rows are cut into time buckets.  A value over all rows before (or after) a row is
its value inside the bucket, completed from a table with one row a bucket.  Only
that table is ordered as a whole; rows move once, by bucket, and every frame is
one that Spark extends row by row.  A pass reads its input twice, so an input
that takes work is written first: passes in a row cost a sum, not a product.

Buckets are stretches of equal length.  Where one of them holds more than ``DENSE`` rows,
buckets of equal numbers of rows take their place: ranges of the whole order (ties in time
are told apart by what follows it), with bounds from a sample.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoframe.functions.text import HOUR
from convoframe.sources.scratch import materialised, settled

#: The most rows of a bucket of equal length.
DENSE = 1 << 20


def _even(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """``rows`` with ``_bucket`` as the number of their range in ``by`` and ``order``, of about ``most`` rows each.

    Written, as ranges drawn again might have other bounds.
    """
    n = -(-rows.count() // most)
    dealt = rows.drop("_bucket").repartitionByRange(n, *by, *order).withColumn("_bucket", F.spark_partition_id().cast("long"))
    return materialised(dealt, "even-buckets")


def running(
    df: DataFrame,
    order: list[str],
    keys: tuple[str, ...] = (),
    width: int = HOUR,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """Adds exclusive running values in the order of ``order`` (its first column is in microseconds), for each of ``keys``.

    ``sums``: of all rows before; ``lasts``: the last non-null before; ``nexts``:
    the first non-null after.  ``order`` must tell all rows of a key apart.  With
    ``keep_bucket`` the buckets stay in a column ``_bucket``, and a further pass over
    the same order finds its rows dealt by it already.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    place = F.struct(*order)
    rows = df if "_bucket" in df.columns else df.withColumn("_bucket", F.floor(F.col(order[0]) / width).cast("long"))
    rows = settled(rows.select("*", *[c.alias(f"_v_{name}") for name, c in {**sums, **lasts, **nexts}.items()]), "running")
    by = [*keys, "_bucket"]
    if "_bucket" not in df.columns:
        fullest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (fullest or 0) > DENSE:
            rows = _even(rows, list(keys), order, DENSE // 2)
    v = lambda name: F.col(f"_v_{name}")
    per_bucket = [F.sum(v(n)).alias(f"_b_{n}") for n in sums]
    per_bucket += [F.max_by(v(n), F.when(v(n).isNotNull(), place)).alias(f"_b_{n}") for n in lasts]
    per_bucket += [F.min_by(v(n), F.when(v(n).isNotNull(), place)).alias(f"_b_{n}") for n in nexts]
    buckets = rows.groupBy(*by).agg(*per_bucket)
    up = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_b_{n}").over(up), F.lit(0)).alias(f"_c_{n}") for n in sums]
    carried += [F.last(f"_b_{n}", ignorenulls=True).over(up).alias(f"_c_{n}") for n in lasts]
    carried += [F.last(f"_b_{n}", ignorenulls=True).over(down).alias(f"_c_{n}") for n in nexts]
    rows = rows.join(buckets.select(*by, *carried), by)
    ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = [F.col(c) for c in df.columns if c != "_bucket"] + [F.col("_bucket")] * keep_bucket
    out += [(F.col(f"_c_{n}") + F.coalesce(F.sum(v(n)).over(ahead), F.lit(0))).alias(n) for n in sums]
    out += [F.coalesce(F.last(v(n), ignorenulls=True).over(ahead), F.col(f"_c_{n}")).alias(n) for n in lasts]
    out += [F.coalesce(F.last(v(n), ignorenulls=True).over(behind), F.col(f"_c_{n}")).alias(n) for n in nexts]
    return rows.select(*out)
