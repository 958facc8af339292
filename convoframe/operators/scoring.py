"""Scoring of samples: cache, scorer, report, filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.functions.text import parse_score, percent, sample_key

#: Half-open buckets of the histogram; a full 10 is in none.
BUCKETS = (("0-2", 0.0, 2.0), ("2-4", 2.0, 4.0), ("4-6", 4.0, 6.0), ("6-8", 6.0, 8.0), ("8-10", 8.0, 10.0))


def keyed(samples: DataFrame) -> DataFrame:
    return samples.withColumn("key", sample_key(F.col("instruction"), F.col("input"), F.col("output")))


def cache_hits(samples: DataFrame, cache: DataFrame) -> DataFrame:
    """Samples with the cached score of their key."""
    return samples.join(cache.select("key", "score", "response"), "key")


def cache_misses(samples: DataFrame, cache: DataFrame) -> DataFrame:
    """One sample of each key that the cache lacks."""
    return samples.join(cache, "key", "left_anti").dropDuplicates(["key"])


def scored(replies: DataFrame) -> DataFrame:
    """Adds the parsed score; a failed call scores 0."""
    return replies.withColumn("score", F.when(F.col("error").isNull(), parse_score(F.col("response"))).otherwise(F.lit(0.0)))


def judged(scores: DataFrame, min_score: float) -> DataFrame:
    return scores.withColumn("passed", F.col("score") >= min_score)


def report(scores: DataFrame, min_score: float) -> DataFrame:
    """One row: samples, passed, failed, their percent and the mean score."""
    done = judged(scores, min_score).agg(F.count(F.lit(1)).alias("total_samples"), F.count_if("passed").alias("passed_samples"), F.count_if(~F.col("passed")).alias("failed_samples"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"))
    return done.withColumn("passed_percent", percent(F.col("passed_samples"), F.col("total_samples")))


def histogram(scores: DataFrame) -> DataFrame:
    """Scores by bucket; empty buckets are present."""
    counts = scores.agg(*[F.count_if((F.col("score") >= lo) & (F.col("score") < hi)).alias(name) for name, lo, hi in BUCKETS])
    return counts.select(F.explode(F.create_map(*[x for name, _, _ in BUCKETS for x in (F.lit(name), F.col(f"`{name}`"))])).alias("bucket", "samples"))


def passing(scores: DataFrame, min_score: float) -> DataFrame:
    return scores.filter(F.col("score") >= min_score)
