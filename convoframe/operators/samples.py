"""Training samples: instruction, input and output of every round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.functions.text import day, day_minute, not_blank
from convoframe.operators.contacts import display_name, with_contact
from convoframe.operators.context import with_history
from convoframe.operators.rounds import round_texts

#: Fixed value: how every instruction ends.
CLOSING = "根据聊天记录和对方的最新消息，用你的风格回复。"


def instruction(me: Column, other: Column, relationship: Column, detail: Column, since: Column, now: Column, closing: str = CLOSING) -> Column:
    """The instruction's sentences joined by spaces; those with nothing to say are left out."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("你是"), me, F.lit("，正在和"), other, F.lit("聊天。")),
        F.when(relationship != "", F.concat(F.lit("对方是你的"), relationship, F.lit("。"))),
        F.concat(not_blank(detail), F.lit("。")),
        F.concat(F.lit("你们从"), day(since), F.lit("开始联系。")),
        F.concat(F.lit("现在是"), day_minute(now), F.lit("。")),
        F.lit(closing),
    )


def training_samples(rounds: DataFrame, runs: DataFrame, contacts: DataFrame, me: str = "我") -> DataFrame:
    """``round_id, talker, reply_t, instruction, input, output`` of every round."""
    named = with_contact(rounds, contacts, "talker").withColumn("other_name", display_name(F.col("remark"), F.col("nickname"), F.col("talker")))
    texts = round_texts(named, runs)
    now = F.timestamp_micros("reply_t").cast("timestamp_ntz")
    asked = F.concat(F.lit("历史记录:\n"), F.coalesce("history", F.lit("")), F.lit("\n\n对方最新消息:\n"), F.col("other_text"))
    return with_history(rounds, runs, F.lit(me), onto=texts).select(
        "round_id", "talker", "reply_t",
        instruction(F.lit(me), F.col("other_name"), F.col("relationship"), F.col("relationship_detail"), F.col("first_contact_date"), now).alias("instruction"),
        asked.alias("input"),
        F.col("my_text").alias("output"),
    )
