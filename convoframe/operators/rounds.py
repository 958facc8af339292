"""Question/reply rounds of a message timeline.

A run is a maximal stretch of messages of one side (of one talker, if not mine)
with small gaps.  A run of another's is answered by the first message of mine
after its end, if that is near in position and time.  Of the runs answered by one
message of mine the earliest makes the round; what lies between is consumed.  That
equals a greedy scan, as every message of mine restarts it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.functions.text import SECOND, micros
from convoframe.operators.messages import mine
from convoframe.operators.timeline import running


@dataclass(frozen=True)
class RoundRules:
    max_gap: int = 90  # seconds between messages of a run
    max_delay: int = 300  # seconds from the other's last message to the reply
    look_ahead: int = 10  # positions after the other's last message


def numbered(messages: DataFrame, order: tuple[str, ...] = ("source_file", "file_row"), keep_bucket: bool = False, before: bool = False) -> DataFrame:
    """Adds ``t`` (microseconds), ``mine`` and ``ix``, the position in the whole timeline; with ``before``, also ``_prev``, the message before, for ``with_runs``."""
    rows = messages.withColumn("t", micros(F.col("create_time"))).withColumn("mine", mine(F.col("is_sender")))
    lasts = {"_prev": F.struct("t", "mine", "talker")} if before else None
    return running(rows, ["t", *order], sums={"ix": F.lit(1).cast("long")}, lasts=lasts, keep_bucket=keep_bucket)


def with_runs(timeline: DataFrame, rules: RoundRules = RoundRules()) -> DataFrame:
    """Adds ``run``, the position where a message's run starts, and ``reply``, place and time of the next message of mine."""
    seen = timeline if "_prev" in timeline.columns else running(timeline, ["t", "ix"], lasts={"_prev": F.struct("t", "mine", "talker")}, keep_bucket=True)
    prev = F.col("_prev")
    starts = prev.isNull() | (prev["mine"] != F.col("mine")) | (~F.col("mine") & ~prev["talker"].eqNullSafe(F.col("talker"))) | (F.col("t") - prev["t"] > rules.max_gap * SECOND)
    seen = seen.withColumn("_start", starts).drop("_prev")
    seen = running(seen, ["t", "ix"], lasts={"_run": F.when(F.col("_start"), F.col("ix"))}, nexts={"reply": F.when(F.col("mine"), F.struct("ix", "t"))})
    return seen.withColumn("run", F.when(F.col("_start"), F.col("ix")).otherwise(F.col("_run"))).drop("_start", "_run")


def extract_rounds(runs: DataFrame, rules: RoundRules = RoundRules()) -> DataFrame:
    """One row a round from messages with runs; ``round_id`` is the position of the reply's first message."""
    slim = runs.select("ix", "t", "mine", "talker", "run", *["reply"] * ("reply" in runs.columns))
    if "reply" not in slim.columns:
        slim = running(slim, ["t", "ix"], nexts={"reply": F.when(F.col("mine"), F.struct("ix", "t"))})
    blocks = slim.groupBy("run").agg(
        F.first("mine").alias("mine"), F.first("talker").alias("talker"), F.max("ix").alias("last_ix"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"), F.max_by("reply", "ix").alias("reply")
    )
    asked = blocks.filter(~F.col("mine") & (F.col("reply.ix") - F.col("last_ix") <= rules.look_ahead) & (F.col("reply.t") - F.col("last_t") <= rules.max_delay * SECOND))
    won = asked.groupBy(F.col("reply.ix").alias("round_id")).agg(F.min(F.struct(F.col("run").alias("other_first_ix"), "talker", F.col("last_ix").alias("other_last_ix"), F.col("last_t").alias("other_last_t"), F.col("n").alias("other_n"), F.col("reply.t").alias("reply_t"))).alias("r"))
    replies = blocks.filter("mine").select(F.col("run").alias("round_id"), F.col("last_ix").alias("my_last_ix"), F.col("n").alias("my_n"))
    return won.join(replies, "round_id").select(
        "round_id", "r.talker", "r.other_first_ix", "r.other_last_ix", F.col("round_id").alias("my_first_ix"), "my_last_ix", "r.other_last_t", "r.reply_t", "r.other_n", "my_n"
    )


def block_text(content: Column, ix: Column) -> Column:
    """Contents of a block in order, joined by ``<return>`` (an aggregate)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ix.alias("ix"), F.coalesce(content, F.lit("")).alias("c")))), lambda x: x["c"]), "<return>")


def round_texts(rounds: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``other_text`` and ``my_text``; a run's messages meet their round by the run's start."""
    ends = F.array(F.struct(F.lit(True).alias("theirs"), F.col("other_first_ix").alias("run")), F.struct(F.lit(False).alias("theirs"), F.col("my_first_ix").alias("run")))
    sides = rounds.select("round_id", F.explode(ends).alias("_end")).select("round_id", "_end.*")
    lines = sides.join(runs.select("run", "ix", "content"), "run").groupBy("round_id", "theirs").agg(block_text(F.col("content"), F.col("ix")).alias("_text"))
    both = lines.groupBy("round_id").agg(F.max(F.when(F.col("theirs"), F.col("_text"))).alias("other_text"), F.max(F.when(~F.col("theirs"), F.col("_text"))).alias("my_text"))
    return rounds.join(both, "round_id")


def islands(timeline: DataFrame, barrier: int) -> DataFrame:
    """Adds ``island``, the position where a stretch without a gap over ``barrier`` seconds starts."""
    seen = running(timeline, ["t", "ix"], lasts={"_prev": F.col("t")}, keep_bucket=True)
    starts = F.col("_prev").isNull() | (F.col("t") - F.col("_prev") > barrier * SECOND)
    seen = seen.withColumn("_start", starts).drop("_prev")
    seen = running(seen, ["t", "ix"], lasts={"_island": F.when(F.col("_start"), F.col("ix"))})
    return seen.withColumn("island", F.when(F.col("_start"), F.col("ix")).otherwise(F.col("_island"))).drop("_start", "_island")
