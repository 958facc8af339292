"""Size-balanced sharding by sampled splitters.

Records are ordered by a text key, cut into ranges at size-weighted sample
quantiles, and the ranges' exact sums turn a record's place inside its range
into its place in the whole order.  Only the ranges' sums (a bounded number) are
ever put in one place; every record moves once, as a slim row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe.llm.common import SCANNED, count_at_most, write_table

#: Sampled keys for each range boundary.
OVERSAMPLE = 8
#: Records a range is meant to hold, and the most ranges made; beyond that ranges grow.
RANGE_ROWS = 20_000
MAX_RANGES = 4_096
#: The greatest key.
MOST = (1 << 63) - 1
#: A group of equal texts up to this share of a shard is kept in one shard.
WHOLE_GROUP = 0.01


def _ranged(slim: DataFrame, bounds: list[int], most_rows: int, most_size: int) -> tuple[DataFrame, dict[int, int]]:
    """Adds ``_range``, and tells into how many parts each overfull range has to go."""
    ranged = slim.withColumn("_range", count_at_most(F.col("_key"), bounds))
    found = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("s")).collect()  # a row a range
    return ranged, {r["_range"]: k for r in found if (k := max(-(-r["n"] // most_rows), min(r["n"], -(-r["s"] // most_size)))) > 1}


def shard_by_size(records: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals every record into ``shards`` shards whose sizes are near equal.

    Size is the text's UTF-8 bytes plus one (null text: one).  Equal texts are
    neighbours in the order, and share a shard unless their group is larger than
    ``WHOLE_GROUP`` of one; so a shard misses the mean by half of that share, or
    of one record, at either end.  Returns ``id_col, size, text_crc32, shard, slot``; slots are
    gapless from 0 in each shard.

    Very long texts count by their bytes; null ids sort first; repeated rows are dealt like any others; an empty table
    gives an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = write_table(
        records.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("_size"),
            F.crc32(text).alias("_crc"),
            F.xxhash64(text).alias("_key"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-slim",
        files_per_core=SCANNED,
    )
    total, rows = slim.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    n_ranges = max(4 * shards, min(MAX_RANGES, rows // RANGE_ROWS))
    # Weighted sampling without replacement: the smallest -ln(u)/size win, so a key counts by its bytes.
    uniform = (F.shiftrightunsigned(F.xxhash64("_id", "_row", F.lit("draw")), 11) + F.lit(1)) / F.lit(float(1 << 53))
    drawn = slim.select("_key", (-F.log(uniform) / F.col("_size")).alias("_p")).orderBy("_p", "_key").limit(OVERSAMPLE * n_ranges).collect()
    keys = sorted(r["_key"] for r in drawn)
    bounds = sorted({keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)}) if keys else []
    # Overfull ranges are subdivided: keys that are hot by themselves get ranges of their own, what is left is cut
    # evenly (keys are hashes).  Only the rows of a hot key are dealt on by a hash of the row.
    most_rows, most_size = 2 * max(RANGE_ROWS, rows // n_ranges), max(1, 2 * total // n_ranges)
    ranged, over = _ranged(slim, bounds, most_rows, most_size)
    hot = set()
    if over:
        by_key = ranged.filter(F.col("_range").isin(list(over))).groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("s"))
        hot = {r["_key"] for r in by_key.filter((F.col("n") * 4 > most_rows) | (F.col("s") * 4 > most_size)).collect()}  # at most 4 a range of the mean size
        bounds = sorted({*bounds, *hot, *(k + 1 for k in hot if k < MOST)})
        ranged, over = _ranged(slim, bounds, most_rows, most_size)
    ends = [-MOST - 1, *bounds, MOST]
    cuts = {ends[r] + (ends[r + 1] - ends[r]) * i // k for r, k in over.items() if ends[r] not in hot for i in range(1, k)}
    if cuts:
        bounds = sorted({*bounds, *cuts})
        ranged, over = _ranged(slim, bounds, most_rows, most_size)
        ends = [-MOST - 1, *bounds, MOST]
    split = {r: k for r, k in over.items() if ends[r] in hot}
    if split:
        counts = F.create_map(*[F.lit(x) for kv in sorted(split.items()) for x in kv])
        parts = F.coalesce(F.try_element_at(counts, F.col("_range")), F.lit(1))
        ranged = ranged.withColumn("_part", F.pmod(F.xxhash64("_id", "_row"), parts).cast("int"))
    else:
        ranged = ranged.withColumn("_part", F.lit(0))

    sums = ranged.groupBy("_range", "_part").agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges' sums only
    starts = sums.select("_range", "_part", F.coalesce(F.sum("s").over(order), F.lit(0)).alias("_s0"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_n0"))

    inside = Window.partitionBy("_range", "_part").orderBy("_key", "_id", "_row")
    same = Window.partitionBy("_range", "_part", "_key")
    placed = (
        ranged.withColumn("_in", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size"))
        .withColumn("_rn", F.row_number().over(inside) - 1)
        .withColumn("_gs", F.sum("_size").over(same))
        .withColumn("_g0", F.min("_in").over(same))
        .join(F.broadcast(starts), ["_range", "_part"])  # one row a range: bounded by MAX_RANGES and their parts
    )
    whole = F.col("_gs") * F.lit(shards) <= F.lit(WHOLE_GROUP * total)
    # Twice the middle of the record, or of its group: what straddles a boundary goes where more of it lies.
    middle = 2 * F.col("_s0") + F.when(whole, 2 * F.col("_g0") + F.col("_gs")).otherwise(2 * F.col("_in") + F.col("_size"))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(max(1, 2 * total)))).cast("int")).withColumn("_rank", F.col("_n0") + F.col("_rn"))
    placed = write_table(placed.select("_id", "_size", "_crc", "shard", "_rank"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_rank") - F.col("_first")).cast("long").alias("slot"),
    )
