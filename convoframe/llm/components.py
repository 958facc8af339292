"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import write_table

MAX_STEPS = 40


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()


def components(edges: DataFrame) -> DataFrame:
    """(``v``, ``root``) for every node of ``edges`` (``a``, ``b``, 64-bit numbers): its component's least node.

    Each step's edges are written to the shared folder, so lineage stays short;
    nothing but a count and a checksum reaches the driver.  A hub's edges are
    reduced before they are shuffled and joined by a splittable join.
    """
    current = write_table(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    state = _state(current)
    for _ in range(MAX_STEPS):
        if not state[0]:
            break
        current = write_table(_small_star(_large_star(current)), "edges")
        new = _state(current)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    roots = current.groupBy("b").agg(F.lit(1).alias("n")).select(F.col("b").alias("v"), F.col("b").alias("root"))
    return current.select(F.col("a").alias("v"), F.col("b").alias("root")).union(roots)
