"""Words, placeholders and message profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: short words that count although they are no plain words.
WHITELIST = ("哈哈", "草", "寄", "nb", "捏", "okok", "没事", "笑死", "牛逼")
EMOJI = r"\[([^\]]+)\]"
#: Words as runs of letters; everything else separates.
SPLIT = r"[\s!-@\[-`{-~]+"


def regex_words(text: Column) -> Column:
    """Words of scripts with spaces: text split at white space and ASCII marks and digits (``segment`` cuts the others)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def segmented(df: DataFrame, text_col: str, words_col: str, segment: Callable[[str], list[str]]) -> DataFrame:
    """Adds words by a user's segmenter (text to list), in Arrow batches."""
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.fillna("").map(segment)

    return df.withColumn(words_col, run(F.col(text_col)))


def _counted(found: DataFrame, value: str, top: int | None) -> DataFrame:
    """Counts of a value with its first place; the most frequent first, ties by first place."""
    counts = found.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ix", "pos")).alias("first"))
    if top is None:
        return counts.select(value, "n")
    return counts.orderBy(F.desc("n"), "first").limit(top).select(value, "n")


def word_frequency(df: DataFrame, text_col: str = "content", order_col: str = "ix", top: int | None = 50, words: Column | None = None) -> DataFrame:
    """The most frequent words: trimmed, two letters or more, all letters or in the whitelist."""
    found = df.select(F.col(order_col).alias("ix"), F.posexplode(regex_words(F.col(text_col)) if words is None else words).alias("pos", "word"))
    found = found.withColumn("word", F.trim("word"))
    return _counted(found.filter((F.length("word") >= 2) & (F.col("word").rlike(r"^\p{L}+$") | F.col("word").isin(list(WHITELIST)))), "word", top)


def emoji_frequency(df: DataFrame, text_col: str = "content", order_col: str = "ix", top: int | None = 10) -> DataFrame:
    """The most frequent bracketed marks."""
    found = df.select(F.col(order_col).alias("ix"), F.posexplode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(EMOJI), F.lit(1))).alias("pos", "emoji"))
    return _counted(found, "emoji", top)


def message_profile(df: DataFrame, text_col: str = "content", short: int = 10) -> DataFrame:
    """One row: messages, average length, share of short ones; zeros for none."""
    n = F.length(text_col)
    return df.agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("average_length"),
        F.coalesce(F.avg(F.when(n <= short, 1.0).otherwise(0.0)), F.lit(0.0)).alias("short_share"),
    )
