"""Adapters from the fixture tables to the engine's inputs; one SQL text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.operators.messages import clean_messages
from convoframe.operators.rounds import extract_rounds, numbered, with_runs
from convoframe.sources.scratch import materialised

MESSAGES = """
select event_id as id, ts as CreateTime,
  case when event_type in ('purchase', 'signup') then 1 else 0 end as is_sender,
  case when event_type in ('purchase', 'signup') then 'wxid_me' else 'wxid_' || lpad(cast(user_id % 5 as string), 8, '0') end as talker,
  cast(null as string) as room_name,
  case event_type when 'click' then '文本' when 'view' then '图片' when 'error' then '语音' when 'purchase' then '文本' when 'signup' then '动画表情' else event_type end as type_name,
  props as msg,
  case when value > 20 then 'v=' || cast(cast(floor(value) as bigint) as string) end as src
from {events}
"""

SAMPLES = """
select conv_id, turn, coalesce(said, '') as instruction, coalesce(last_user, '') as input, text as output,
  cast(((conv_id * 7 + turn * 3) % 101) / 10.0 as double) as score
from (
  select conv_id, turn, role, text,
    max(case when role = 'system' then text end) over (partition by conv_id) as said,
    lag(case when role = 'user' then text end) over (partition by conv_id order by turn) as last_user
  from {conversations}
) t
where role = 'assistant'
"""

CONTACTS = """
select 'wxid_' || lpad(cast(c_custkey as string), 8, '0') as contact_id, c_name as nickname,
  case c_custkey % 3 when 0 then '' when 1 then ' ' else n_name end as remark,
  c_mktsegment as relationship, '' as relationship_detail,
  cast(null as timestamp_ntz) as first_contact_date, cast(null as timestamp_ntz) as last_contact_date,
  cast(c_custkey % 50 as bigint) as message_count
from {customer} join {nation} on c_nationkey = n_nationkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(MESSAGES, events=table(spark, sf_dir, "events"))
    return clean_messages(raw.withColumn("source_file", F.lit("events")).withColumn("file_row", F.col("id")))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(messages(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with positions and runs, as the stage table that later operators share."""
    return materialised(with_runs(numbered(messages(spark, sf_dir), keep_bucket=True, before=True)), "runs")


def rounds(runs: DataFrame) -> DataFrame:
    """The rounds, as the stage table that later operators share."""
    return materialised(extract_rounds(runs), "rounds")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SAMPLES, conversations=table(spark, sf_dir, "conversations"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONTACTS, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
