"""Many texts to one by levels of merges, no prompt over a stated size.

An owner's texts have places.  In each round the texts whose places share a block of
``fan`` are merged: packed in order into prompts of at most ``limit`` characters, long
texts cut into pieces first, and replaced by the replies, whose place is the block.
Rounds go on until every owner has one text.  What does not need merging moves up as it
is.

Blocks hang on places and not on sizes, and a prompt's key on its content alone.  So
where a text changes, the prompts from it up to the top are asked again and, unless sizes
in its block now pack otherwise, no other; texts added at the end ask for their own blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAN = 8
LIMIT = 60_000
#: Rounds in which replies may fail to shrink what is left.
STALLED = 3


def pieces(items: DataFrame, limit: int) -> DataFrame:
    """Texts longer than half of ``limit`` in pieces of that; ``piece`` numbers them."""
    half = limit // 2
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / half).cast("int") - 1, F.lit(0)))
    cut = F.transform(starts, lambda i: F.substr(F.col("text"), i * half + 1, F.lit(half)))
    rest = [c for c in items.columns if c != "text"]
    return items.select(*rest, F.posexplode(cut).alias("piece", "text"))


def groups(items: DataFrame, fan: int = FAN, limit: int = LIMIT) -> DataFrame:
    """``owner, block, grp, parts, leaves, weight, chars, texts`` of items ``owner, pos, sub, weight, text``: what is merged together.

    A block whose texts take at most ``limit`` characters is one group, else groups are
    stretches of it of at most that.  ``weight``, and ``leaves``, the number of first texts
    (where items have none, each is one), are counted with a text's first piece.  A block is
    bounded by ``fan`` texts, so it is handled whole.
    """
    items = items if "leaves" in items.columns else items.withColumn("leaves", F.lit(1).cast("long"))
    half = limit // 2
    cut = pieces(items, limit).withColumn("block", F.floor(F.col("pos") / fan)).withColumn("_size", F.length("text"))
    block = Window.partitionBy("owner", "block")
    before = F.coalesce(F.sum("_size").over(block.orderBy("pos", "sub", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("grp", F.when(F.sum("_size").over(block) <= limit, 0).otherwise(F.floor(before / half)).cast("int"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub", "piece", "text"))), lambda x: x["text"])
    first = lambda c: F.sum(F.when(F.col("piece") == 0, F.col(c)).otherwise(0)).alias(c)
    return cut.groupBy("owner", "block", "grp").agg(F.count(F.lit(1)).alias("parts"), first("leaves"), first("weight"), F.sum("_size").alias("chars"), texts.alias("texts"))


def spread(items: DataFrame, key: str, n: int, fan: int = FAN) -> DataFrame:
    """Adds ``pos`` by a hash of ``key``: blocks of about ``fan`` that stay as they are when others come; one block for up to ``fan``."""
    width = fan ** max(1, math.ceil(math.log(max(n, 1), fan) - 1e-9))
    return items.withColumn("pos", F.lit(0).cast("long") if n <= fan else F.pmod(F.xxhash64(key), F.lit(width)))


def reduce_tree(items: DataFrame, ask: Callable[[DataFrame, int], DataFrame], keep: Callable[[DataFrame, str], DataFrame], fan: int = FAN, limit: int = LIMIT) -> DataFrame:
    """One row an owner, ``owner, leaves, weight, text``, from items ``owner, pos, sub, weight, text``.

    ``ask(groups, round)`` gives groups their ``text``; a group it gives none is lost, and
    its texts with it.  ``keep(rows, name)`` writes a table and reads it.  In the first round
    all groups are asked, later ones only where there are several texts to merge.  An error
    is raised where replies don't shrink what is left.
    """
    items = keep(items.select("owner", F.col("pos").cast("long").alias("pos"), F.col("sub").cast("long").alias("sub"), F.col("weight").cast("long").alias("weight"), F.lit(1).cast("long").alias("leaves"), "text"), "merge_0")
    n, stalled, number = items.count(), 0, 0
    while True:
        number += 1
        found = keep(groups(items, fan, limit), f"merge_{number}_groups")
        single = (F.col("parts") == 1) if number > 1 else F.lit(False)
        asked = ask(found.filter(~single), number).select("owner", "block", "grp", "leaves", "weight", "text")
        passed = found.filter(single).select("owner", "block", "grp", "leaves", "weight", F.col("texts")[0].alias("text"))
        items = asked.unionByName(passed).select("owner", F.col("block").cast("long").alias("pos"), F.col("grp").cast("long").alias("sub"), F.col("weight").cast("long").alias("weight"), F.col("leaves").cast("long").alias("leaves"), "text")
        items = keep(items, f"merge_{number}")
        left, owners, top = items.agg(F.count(F.lit(1)), F.countDistinct("owner"), F.max("pos")).first()
        if left <= owners and not top:
            return items.select("owner", "leaves", "weight", "text")
        # At the top nothing but shorter replies brings the texts together.
        stalled = stalled + 1 if left >= n and not top else 0
        if stalled >= STALLED:
            raise ValueError(f"replies do not shrink what is left: {left} texts of {owners} owners")
        n = left
