"""Cleaning and typing of raw messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.functions.text import not_blank

TEXT = "文本"
VOICE = "语音"

#: What stands for a message that is no text.
PLACEHOLDERS = {
    "图片": "[图片]",
    "文件": "[文件]",
    "动画表情": "[动画表情]",
    "(分享)卡片式链接": "[分享链接]",
    "合并转发的聊天记录": "[合并转发的聊天记录]",
    "引用回复": "引用回复",
}


def content_of(type_name: Column, msg: Column, src: Column) -> Column:
    """Content by message type: text itself, a voice message's transcript, else a placeholder."""
    said = not_blank(src)
    table = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    return (
        F.when(type_name == TEXT, F.coalesce(msg, F.lit("")))
        .when(type_name == VOICE, F.when(said.isNotNull(), F.concat(F.lit("[语音转文字: "), said, F.lit("]"))).otherwise(F.lit("[语音消息]")))
        .otherwise(F.coalesce(F.try_element_at(table, type_name), F.concat(F.lit("["), F.coalesce(type_name, F.lit("None")), F.lit("]"))))
    )


def typed_time(c: Column, epoch_unit: str | None = None) -> Column:
    """A zone-less timestamp from text in the usual layouts, or from epoch numbers if ``epoch_unit`` ('s' or 'ms') says so."""
    if epoch_unit:
        seconds = c.try_cast("double") / (1000 if epoch_unit == "ms" else 1)
        return F.timestamp_seconds(seconds).cast("timestamp_ntz")
    text = c.cast("string")
    return F.coalesce(text.try_cast("timestamp_ntz"), F.try_to_timestamp(text, F.lit("yyyy/M/d H:m[:s]")).cast("timestamp_ntz"))


def clean_messages(raw: DataFrame, epoch_unit: str | None = None, pandas_na: bool = False) -> DataFrame:
    """Typed messages from raw text columns; rows that do not type are dropped.

    ``raw`` needs id, CreateTime, is_sender, talker, room_name, type_name, msg;
    ``src``, ``source_file`` and ``file_row`` are optional.  With ``pandas_na`` the
    usual NA spellings in ``msg`` count as missing.
    """
    have = set(raw.columns)
    msg = F.col("msg").cast("string")
    if pandas_na:
        msg = F.when(~msg.isin("", "NA", "N/A", "null", "NULL", "None", "nan", "NaN"), msg)
    src = F.col("src").cast("string") if "src" in have else F.lit(None).cast("string")
    typed = raw.select(
        F.col("id").cast("string").alias("msg_id"),
        typed_time(F.col("CreateTime"), epoch_unit).alias("create_time"),
        F.col("is_sender").try_cast("int").alias("is_sender"),
        F.col("talker").cast("string").alias("talker"),
        F.col("room_name").cast("string").alias("room_name"),
        F.col("type_name").cast("string").alias("type_name"),
        content_of(F.col("type_name"), msg, src).alias("content"),
        F.coalesce(msg, F.lit("")).alias("original_msg"),
        (F.col("source_file") if "source_file" in have else F.lit("")).alias("source_file"),
        (F.col("file_row").cast("long") if "file_row" in have else F.monotonically_increasing_id()).alias("file_row"),
    )
    return typed.filter(F.col("create_time").isNotNull() & F.col("is_sender").isNotNull() & F.col("talker").isNotNull())


def rejected_count(raw: DataFrame, clean: DataFrame) -> int:
    """How many raw rows did not type."""
    return raw.count() - clean.count()


def text_only(df: DataFrame) -> DataFrame:
    """Text messages: by numeric ``type`` if there is one, else by ``type_name``, else all."""
    if "type" in df.columns:
        return df.filter(F.col("type").try_cast("int") == 1)
    if "type_name" in df.columns:
        return df.filter(F.col("type_name") == TEXT)
    return df


def mine(c: Column) -> Column:
    """The flag as rounds read it: 1 is mine, all else is not."""
    return F.coalesce(c == 1, F.lit(False))
