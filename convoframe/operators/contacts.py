"""Contacts: names, statistics, upserts, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.functions.text import not_blank, short_id
from convoframe.operators.messages import mine

DEFAULT_RELATIONSHIP = "朋友"


def display_name(remark: Column, nickname: Column, contact_id: Column) -> Column:
    """Remark, else nickname (blank ones count as missing), else the id's last eight characters."""
    return F.coalesce(not_blank(remark), not_blank(nickname), short_id(contact_id))


def summary_name(remark: Column, nickname: Column, contact_id: Column) -> Column:
    """As ``display_name``, but only empty ones count as missing."""
    return F.coalesce(F.nullif(remark, F.lit("")), F.nullif(nickname, F.lit("")), short_id(contact_id))


def my_name_of(users: DataFrame, my_id: str, default: str = "我") -> str:
    """The user's own display name; ``default`` where the id is unknown."""
    found = users.filter(F.col("contact_id") == my_id).select(display_name(F.col("remark"), F.col("nickname"), F.col("contact_id")).alias("n")).first()
    return found["n"] if found and found["n"] else default


def message_stats(messages: DataFrame) -> DataFrame:
    """Messages, first and last time by talker."""
    return messages.groupBy("talker").agg(F.count(F.lit(1)).alias("message_count"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))


def contact_statistics(timeline: DataFrame, top: int | None = 10) -> DataFrame:
    """Totals of mine and others' messages by talker; the most active first, ties by first appearance."""
    stats = timeline.groupBy("talker").agg(F.count(F.lit(1)).alias("total_messages"), F.count_if(mine(F.col("is_sender"))).alias("my_messages"), F.count_if(~mine(F.col("is_sender"))).alias("other_messages"), F.min("ix").alias("first_ix"))
    return stats.orderBy(F.desc("total_messages"), "first_ix").limit(top) if top else stats


def with_contact(rows: DataFrame, contacts: DataFrame, id_col: str) -> DataFrame:
    """Left lookup of the contact dimension; unknown ids get the default record."""
    dim = contacts.select(F.col("contact_id").alias("_cid"), "nickname", "remark", "relationship", "relationship_detail", "first_contact_date")
    found = rows.join(dim, F.col(id_col) == F.col("_cid"), "left")
    return (
        found.withColumn("nickname", F.coalesce("nickname", F.lit("")))
        .withColumn("remark", F.coalesce("remark", F.lit("")))
        .withColumn("relationship", F.when(F.col("_cid").isNull(), F.lit(DEFAULT_RELATIONSHIP)).otherwise(F.col("relationship")))
        .withColumn("relationship_detail", F.coalesce("relationship_detail", F.lit("")))
        .drop("_cid")
    )


def _filled(old: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(old, F.lit("")), F.nullif(new, F.lit("")), F.lit(""))


def upsert_users(contacts: DataFrame, users: DataFrame) -> DataFrame:
    """Contacts with empty names filled from users, and users that were no contacts yet."""
    u = users.select(F.col("contact_id").alias("_id"), F.col("nickname").alias("_nick"), F.col("remark").alias("_remark"))
    joined = contacts.join(u, F.col("contact_id") == F.col("_id"), "full")
    rest = [c for c in contacts.columns if c not in ("contact_id", "nickname", "remark", "relationship", "relationship_detail", "message_count")]
    return joined.select(
        F.coalesce("contact_id", "_id").alias("contact_id"),
        _filled(F.col("nickname"), F.col("_nick")).alias("nickname"),
        _filled(F.col("remark"), F.col("_remark")).alias("remark"),
        F.when(F.col("contact_id").isNull(), F.lit(DEFAULT_RELATIONSHIP)).otherwise(F.col("relationship")).alias("relationship"),
        F.coalesce("relationship_detail", F.lit("")).alias("relationship_detail"),
        F.coalesce("message_count", F.lit(0)).cast("long").alias("message_count"),
        *rest,
    )


def upsert_stats(contacts: DataFrame, stats: DataFrame, reset: bool = True) -> DataFrame:
    """Contacts with counts replaced and dates widened by message statistics.

    With ``reset`` a contact without messages ends at 0, else it keeps its count.
    """
    s = stats.select(F.col("talker").alias("_id"), F.col("message_count").alias("_n"), F.col("first_time").alias("_first"), F.col("last_time").alias("_last"))
    joined = contacts.join(s, F.col("contact_id") == F.col("_id"), "full")
    kept = F.lit(0) if reset else F.coalesce("message_count", F.lit(0))
    return joined.select(
        F.coalesce("contact_id", "_id").alias("contact_id"),
        F.coalesce("nickname", F.lit("")).alias("nickname"),
        F.coalesce("remark", F.lit("")).alias("remark"),
        F.when(F.col("contact_id").isNull(), F.lit(DEFAULT_RELATIONSHIP)).otherwise(F.col("relationship")).alias("relationship"),
        F.coalesce("relationship_detail", F.lit("")).alias("relationship_detail"),
        F.coalesce("_n", kept).cast("long").alias("message_count"),
        F.least("first_contact_date", "_first").alias("first_contact_date"),
        F.greatest("last_contact_date", "_last").alias("last_contact_date"),
    )


def count_message(contacts: DataFrame, talker: str, when: str) -> DataFrame:
    """One more message of ``talker`` at the ISO time ``when``: count, first date if unset, last date if later."""
    at, hit = F.lit(when).cast("timestamp_ntz"), F.col("contact_id") == talker
    return (
        contacts.withColumn("message_count", F.col("message_count") + F.when(hit, 1).otherwise(0))
        .withColumn("first_contact_date", F.when(hit, F.coalesce("first_contact_date", at)).otherwise(F.col("first_contact_date")))
        .withColumn("last_contact_date", F.when(hit, F.greatest("last_contact_date", at)).otherwise(F.col("last_contact_date")))
    )


def update_relationship(contacts: DataFrame, contact_id: str, relationship: str = "", detail: str = "") -> DataFrame:
    """Point update; empty values keep the old ones."""
    hit = F.col("contact_id") == contact_id
    for name, value in (("relationship", relationship), ("relationship_detail", detail)):
        if value:
            contacts = contacts.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    return contacts


def search(contacts: DataFrame, keyword: str) -> DataFrame:
    """Contacts with the keyword, in any case, in nickname, remark or id."""
    low = keyword.lower()
    return contacts.filter(F.lower("nickname").contains(low) | F.lower("remark").contains(low) | F.lower("contact_id").contains(low))


def summary(contacts: DataFrame) -> DataFrame:
    return contacts.agg(F.count(F.lit(1)).alias("total_contacts"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("total_messages"))


def relationship_distribution(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("relationship").agg(F.count(F.lit(1)).alias("contacts"))


def most_active(contacts: DataFrame, top: int = 5) -> DataFrame:
    """The contacts with most messages; ties by id."""
    named = contacts.select(summary_name(F.col("remark"), F.col("nickname"), F.col("contact_id")).alias("name"), "contact_id", "message_count")
    return named.orderBy(F.desc("message_count"), "contact_id").limit(top)


def infer_me(timeline: DataFrame) -> DataFrame:
    """One row: the talker with most messages, ties by first appearance."""
    counts = timeline.groupBy("talker").agg(F.count(F.lit(1)).alias("messages"), F.min("ix").alias("first_ix"))
    return counts.orderBy(F.desc("messages"), "first_ix").limit(1).select("talker", "messages")
