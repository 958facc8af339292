"""What was said before a round: the 72-hour context, its summary and its rendering.

Relevant to a round are, from ``hours`` before the reply up to (not including) it,
the other's messages and all of mine, whoever they went to.  Neither form lists a
round's whole context: the summary reads running counts at both ends of the
interval, and the history fetches the last lines by ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.functions.text import HOUR, clock, day
from convoframe.operators.timeline import running
from convoframe.sources.scratch import materialised

HOURS = 72
LINES = 30
#: The least messages of a block of the history.
BLOCK = 32


#: Whose messages a running count is of.
MINE, THEIRS = 0, 1


def _sided(rows: DataFrame) -> DataFrame:
    """Probes as two rows, one among my messages and one among those of their talker."""
    sides = F.array(F.struct(F.lit(MINE).alias("side"), F.lit("").alias("talker")), F.struct(F.lit(THEIRS).alias("side"), F.col("talker")))
    return rows.withColumn("_side", F.explode(sides)).drop("talker").select("*", "_side.*").drop("_side")


def _merged(messages: DataFrame, probes: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Messages (``side, talker, t, ix``) and probes (also ``_pid, _end``) in one order for each side and talker.

    Of both: how many messages come ``before``, for a message its ordinal; the last
    before and the first not before.  ``_kind`` is 1 for messages.  ``carried`` columns
    of the messages are null for probes.
    """
    both = messages.select("side", "talker", "t", F.lit(1).alias("_kind"), "ix", F.lit(None).cast("long").alias("_pid"), F.lit(None).cast("string").alias("_end"), *carried).unionByName(
        probes.select("side", "talker", "t", F.lit(0).alias("_kind"), F.col("_pid").alias("ix"), "_pid", "_end"), allowMissingColumns=True
    )
    is_message = F.col("_kind") == 1
    at = F.when(is_message, F.col("t"))
    return running(both, ["t", "_kind", "ix"], keys=("side", "talker"), sums={"before": F.when(is_message, 1).otherwise(0).cast("long")}, lasts={"last_t": at}, nexts={"next_t": at})


def _both_sides(timeline: DataFrame) -> DataFrame:
    """Messages by side: mine under no talker, theirs under theirs."""
    own = F.col("is_sender") == 1
    return timeline.filter(F.col("is_sender").isin(0, 1)).withColumn("side", F.when(own, MINE).otherwise(THEIRS)).withColumn("talker", F.when(own, "").otherwise(F.col("talker")))


def _ends(rounds: DataFrame, hours: int) -> DataFrame:
    low = rounds.select("round_id", "talker", (F.col("reply_t") - hours * HOUR).alias("t"), F.lit("low").alias("_end"))
    return low.unionByName(rounds.select("round_id", "talker", F.col("reply_t").alias("t"), F.lit("high").alias("_end"))).withColumn("_pid", F.col("round_id"))


def context_summary(rounds: DataFrame, timeline: DataFrame, hours: int = HOURS) -> DataFrame:
    """Counts of mine and theirs in each round's context, its span in hours, earliest and latest time (microseconds)."""
    found = _merged(_both_sides(timeline), _sided(_ends(rounds, hours))).filter("_kind = 0")
    pick = lambda side, end, c: F.max(F.when((F.col("side") == side) & (F.col("_end") == end), F.col(c)))
    parts = []
    for side, name in ((MINE, "mine"), (THEIRS, "theirs")):
        parts += [(pick(side, "high", "before") - pick(side, "low", "before")).alias(name), pick(side, "low", "next_t").alias(f"{name}_first"), pick(side, "high", "last_t").alias(f"{name}_last")]
    both = found.groupBy("_pid").agg(*parts)
    there = lambda name, c: F.when(F.col(name) > 0, F.col(c))
    first = F.least(there("mine", "mine_first"), there("theirs", "theirs_first"))
    last = F.greatest(there("mine", "mine_last"), there("theirs", "theirs_last"))
    return both.select(
        F.col("_pid").alias("round_id"), (F.col("mine") + F.col("theirs")).alias("context_n"), F.col("mine").alias("context_mine"), F.col("theirs").alias("context_theirs"),
        F.coalesce(F.bround((last - first) / HOUR, 2), F.lit(0.0)).alias("span_hours"), first.alias("first_t"), last.alias("last_t"),
    )


def context_rows(rounds: DataFrame, timeline: DataFrame, hours: int = HOURS) -> DataFrame:
    """All (round, message) pairs of the contexts: an interval join on time buckets as wide as the interval.

    The plain form of the join; its output has a row a pair.
    """
    width = hours * HOUR
    probes = rounds.select("round_id", "talker", "reply_t").withColumn("bucket", F.explode(F.array(F.floor(F.col("reply_t") / width), F.floor(F.col("reply_t") / width) - 1)))
    bucketed = timeline.select("ix", "t", "is_sender", F.col("talker").alias("m_talker")).withColumn("bucket", F.floor(F.col("t") / width))
    inside = (F.col("t") < F.col("reply_t")) & (F.col("t") >= F.col("reply_t") - width)
    theirs = probes.join(bucketed.filter("is_sender = 0").withColumnRenamed("m_talker", "talker"), ["bucket", "talker"]).filter(inside).select("round_id", "ix")
    mine = probes.join(bucketed.filter("is_sender = 1"), "bucket").filter(inside).select("round_id", "ix")
    return theirs.unionByName(mine)


def _blocks(placed: DataFrame, size: int) -> DataFrame:
    """``side, talker, block, start, said``: messages of a side and talker in blocks of ``size`` by ordinal, each row with the block before.

    So a window of up to ``size`` messages lies in the row of the block that it ends in; ``start`` is the row's first ordinal.
    """
    block = F.floor(F.col("before") / size)
    said = F.struct("t", F.lit(0).alias("rank"), "ix", (F.col("side") == MINE).alias("mine"), "day", "text").alias("m")
    twice = placed.filter("_kind = 1").select("side", "talker", "before", said, F.explode(F.array(block, block + 1)).alias("block"))
    return twice.groupBy("side", "talker", "block").agg(F.min("before").alias("start"), F.sort_array(F.collect_list("m")).alias("said"))


def _window(before: Column, lines: int) -> Column:
    """The last ``lines`` messages before an ordinal, of the row of ``_blocks`` that holds them; none where there is no row."""
    low = F.greatest(before - lines, F.col("start"))
    return F.when(F.col("said").isNotNull(), F.slice("said", (low - F.col("start") + 1).cast("int"), (before - low).cast("int"))).otherwise(F.array())


def with_history(rounds: DataFrame, runs: DataFrame, me: Column, hours: int = HOURS, lines: int = LINES, onto: DataFrame | None = None) -> DataFrame:
    """``rounds`` with ``history``: the last lines of context and block with headers where the day changes.

    Only the last ``lines`` messages can show: of mine, of the talker's, and of the
    block.  They are fetched as windows of blocks by ordinal, the talker's only from where
    ``lines`` of mine don't follow.  So a round is one row throughout, and its text is made
    where it has met the last of them.  A block message that the context has too shows
    twice.  ``me`` names the user; the other is named by the rounds' column ``other_name``.
    ``onto`` are the same rounds with further columns, to be read once only.
    """
    onto, size = rounds if onto is None else onto, max(BLOCK, lines)
    shown = lambda df: df.withColumn("day", F.to_date("create_time")).withColumn("text", F.concat(clock(F.col("create_time")), F.coalesce("content", F.lit(""))))
    ends = rounds.select("round_id", "talker", F.col("reply_t").alias("t"), F.lit("high").alias("_end")).withColumn("_pid", F.col("round_id"))
    messages = shown(_both_sides(runs.select("ix", "t", "is_sender", "talker", "create_time", "content")))
    placed = materialised(_merged(messages, _sided(ends), ("day", "text")).select("side", "talker", "_kind", "t", "ix", "_pid", "before", "day", "text"), "history-places")
    count = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("before"))), F.lit(0))
    counts = placed.filter("_kind = 0").groupBy(F.col("_pid").alias("round_id")).agg(count(MINE).alias("_mine"), count(THEIRS).alias("_theirs"))
    nth = placed.filter((F.col("_kind") == 1) & (F.col("side") == MINE)).select((F.col("before") + lines).alias("_mine"), F.col("t").alias("_nth"))
    heads = rounds.select("round_id", "talker", "reply_t").join(counts, "round_id").join(nth, "_mine", "left")
    heads = heads.select("round_id", "talker", "_mine", "_theirs", F.greatest(F.col("reply_t") - hours * HOUR, "_nth").alias("_since"), F.floor((F.col("_theirs") - 1) / size).alias("block"))
    blocks = _blocks(placed, size)
    recent = lambda c: F.filter(c, lambda m: m["t"] >= F.col("_since"))
    met = heads.join(blocks.filter(F.col("side") == THEIRS).drop("side"), ["talker", "block"], "left").select("round_id", "_mine", "_since", recent(_window(F.col("_theirs"), lines)).alias("_said"))
    last = rounds.select(F.col("other_first_ix").alias("run"), "other_last_ix").join(runs.select("run", "t", "ix", "create_time", "content"), "run").filter(F.col("ix") > F.col("other_last_ix") - lines)
    line = F.struct("t", F.lit(1).alias("rank"), "ix", F.lit(False).alias("mine"), "day", "text")
    last = shown(last).groupBy(F.col("run").alias("other_first_ix")).agg(F.collect_list(line).alias("_last"))
    full = onto.join(last, "other_first_ix").join(met, "round_id").withColumn("block", F.floor((F.col("_mine") - 1) / size))
    full = full.join(blocks.filter(F.col("side") == MINE).select("block", "start", "said"), "block", "left")
    rows = F.sort_array(F.concat("_said", "_last", recent(_window(F.col("_mine"), lines))))
    tail = lambda c: F.slice(c, F.greatest(F.size(c) - F.lit(lines - 1), F.lit(1)), F.lit(lines))
    full = full.select(*onto.columns, rows.alias("_rows")).withColumn("_rows", tail(F.col("_rows")))
    speaker = lambda m: F.when(m["mine"], me).otherwise(F.col("other_name"))
    said = lambda m: F.concat(F.lit("["), F.substr(m["text"], F.lit(1), F.lit(8)), F.lit("] "), speaker(m), F.lit(": "), F.substr(m["text"], F.lit(9)))
    header = lambda m, i: F.when(~m["day"].eqNullSafe(F.get(F.col("_rows"), i - 1)["day"]), F.concat(F.lit("————— "), day(m["day"]), F.lit(" —————")))
    full = full.withColumn("_lines", F.flatten(F.transform("_rows", lambda m, i: F.array_compact(F.array(header(m, i), said(m))))))
    return full.select(*onto.columns, F.array_join(tail(F.col("_lines")), "\n").alias("history"))


def history_lines(rounds: DataFrame, runs: DataFrame, me: Column, hours: int = HOURS, lines: int = LINES) -> DataFrame:
    """(``round_id``, ``history``) of ``with_history``."""
    return with_history(rounds, runs, me, hours, lines).select("round_id", "history")


def same_context(t_a: Column, t_b: Column, talker_a: Column, talker_b: Column, mine_a: Column, mine_b: Column, max_gap_hours: int = 24) -> Column:
    """Whether two messages belong to one conversation: near in time, and of one talker or one of them mine."""
    return (F.abs(t_a - t_b) <= max_gap_hours * HOUR) & ((talker_a == talker_b) | mine_a | mine_b)
