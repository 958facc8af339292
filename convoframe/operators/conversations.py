"""Conversations by contact and their hierarchical analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.functions.text import HOUR
from convoframe.operators.timeline import running

MIN_CONTACT = 5
MIN_CONVERSATION = 20
CHUNK = 1000


def related_messages(theirs: DataFrame, mine: DataFrame, window: int = HOUR) -> DataFrame:
    """(``contact``, ``ix``): my messages within ``window`` of any message of a contact (a range semi-join).

    Time is cut into buckets of the window's width; a bucket keeps, for each
    contact, its times in order only where they can decide: a neighbouring
    bucket's nearest ends, and inside the own bucket any message at all.
    """
    buckets = theirs.select(F.col("talker").alias("contact"), "t", F.floor(F.col("t") / window).alias("b"))
    ends = buckets.groupBy("contact", "b").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    probes = mine.select("ix", "t", F.floor(F.col("t") / window).alias("b"))
    probes = probes.withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    near = probes.join(ends, "b").filter((F.floor(F.col("t") / window) == F.col("b")) | ((F.col("t") < F.col("lo")) & (F.col("lo") - F.col("t") <= window)) | ((F.col("t") > F.col("hi")) & (F.col("t") - F.col("hi") <= window)))
    return near.select("contact", "ix").distinct()


def conversations(timeline: DataFrame, me: str, min_contact: int = MIN_CONTACT, min_conversation: int = MIN_CONVERSATION) -> DataFrame:
    """Messages of each contact's conversation with my related ones, in order (``contact, t, rank, ix, mine, content``).

    ``me`` is my id.  Contacts with few messages and short conversations are left
    out.
    """
    rows = timeline.withColumn("_me", F.lit(me))
    theirs = rows.filter(F.col("talker") != F.col("_me"))
    own = rows.filter(F.col("talker") == F.col("_me"))
    enough = theirs.groupBy("talker").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_contact).select("talker")
    theirs = theirs.join(enough, "talker", "left_semi")
    related = related_messages(theirs.select("talker", "t"), own.select("ix", "t"))
    own = own.select("ix", "t", "content").join(related, "ix").select("contact", "t", F.lit(1).alias("rank"), "ix", F.lit(True).alias("mine"), "content")
    both = theirs.select(F.col("talker").alias("contact"), "t", F.lit(0).alias("rank"), "ix", F.lit(False).alias("mine"), "content").unionByName(own)
    long_enough = both.groupBy("contact").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_conversation).select("contact")
    return both.join(long_enough, "contact", "left_semi")


def chunked(conversation: DataFrame, size: int = CHUNK) -> DataFrame:
    """Adds ``chunk``: blocks of ``size`` messages of a contact in order."""
    placed = running(conversation, ["t", "rank", "ix"], keys=("contact",), sums={"_pos": F.lit(1).cast("long")})
    return placed.withColumn("chunk", F.floor(F.col("_pos") / size)).drop("_pos")


def conversation_json(rows: DataFrame, me: str = "我") -> Column:
    """A chunk's messages as JSON, in order (an aggregate over ``t, rank, ix``)."""
    who = F.when(F.col("mine"), F.lit(me)).otherwise(F.col("contact"))
    when = F.date_format(F.timestamp_micros("t").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    lines = F.array_sort(F.collect_list(F.struct("t", "rank", "ix", F.struct(who.alias("sender"), F.col("content"), when.alias("create_time")).alias("m"))))
    return F.to_json(F.transform(lines, lambda x: x["m"]))


def chunk_key(contact: Column, relationship: Column, body: Column) -> Column:
    """Cache key of a chunk's analysis; times are no part of it."""
    return F.md5(F.to_json(F.struct(contact.alias("contact"), relationship.alias("relationship"), body.alias("messages"))))


def chunk_bodies(chunks: DataFrame, me: str = "我") -> DataFrame:
    """``contact, chunk, message_count, body``: every chunk as JSON (a chunk is bounded by its size)."""
    return chunks.groupBy("contact", "chunk").agg(F.count(F.lit(1)).alias("message_count"), conversation_json(chunks, me).alias("body"))


def merge_by_contact(level1: DataFrame) -> DataFrame:
    """A contact's analyses in order, as a JSON array, with their number and messages."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "analysis")))
    return level1.groupBy("contact").agg(F.count(F.lit(1)).alias("analysis_count"), F.sum("message_count").alias("total_messages"), F.to_json(F.transform(parts, lambda x: x["analysis"])).alias("analyses"))


def merge_all(level2: DataFrame) -> DataFrame:
    """One row: all contacts' merged analyses in the order of the contacts, as JSON, with totals."""
    parts = F.array_sort(F.collect_list(F.struct("contact", "analysis")))
    return level2.agg(F.count(F.lit(1)).alias("total_contacts"), F.coalesce(F.sum("total_messages"), F.lit(0)).alias("total_messages"), F.to_json(parts).alias("contact_analyses"))


def final_summary(level2: DataFrame) -> DataFrame:
    """One row: contacts and messages over all merged analyses."""
    return level2.agg(F.count(F.lit(1)).alias("total_contacts"), F.coalesce(F.sum("total_messages"), F.lit(0)).alias("total_messages"))

