import pytest
from pyspark.sql import functions as F

from convoframe.functions import text as T
from convoframe.operators import contacts as C
from convoframe.operators import lexicon as L
from convoframe.operators import scoring as E
from convoframe.operators.messages import clean_messages

SCORES = {"评分：8": 8, "8分": 0, "8.5分": 8, "8/10": 10, "Score: 11": 0, "-3": 3, "a 7\nb 12": 7, "9\n满分10分": 9, "12\n5 of 20": 5, "": 0, None: 0}


def test_scores(spark):
    got = spark.createDataFrame([(k,) for k in SCORES], "r string").select("r", T.parse_score(F.col("r")).alias("s")).collect()
    assert {r.r: r.s for r in got} == SCORES


@pytest.mark.parametrize(("remark", "nickname", "contact", "display", "summary"), [(" ", "n", "wxid_123456789", "n", " "), ("", "", "wxid_123456789", "23456789", "23456789"), (None, None, "short", "short", "short"), ("r ", "n", "x", "r ", "r ")])
def test_names(spark, remark, nickname, contact, display, summary):
    row = spark.createDataFrame([(remark, nickname, contact)], "remark string, nickname string, contact_id string")
    names = (F.col("remark"), F.col("nickname"), F.col("contact_id"))
    assert tuple(row.select(C.display_name(*names), C.summary_name(*names)).first()) == (display, summary)


def test_contents(spark):
    rows = [("语音", "", None, "[语音消息]"), ("语音", "", " x", "[语音转文字:  x]"), ("引用回复", "q", None, "引用回复"), ("X", "q", None, "[X]"), ("文本", None, None, ""), ("图片", "p", None, "[图片]")]
    raw = spark.createDataFrame([(str(i), "2024-01-01 00:00:00", "1", "t", None, k, m, s) for i, (k, m, s, _) in enumerate(rows)], "id string, CreateTime string, is_sender string, talker string, room_name string, type_name string, msg string, src string")
    got = {r.msg_id: r.content for r in clean_messages(raw).collect()}
    assert [got[str(i)] for i in range(len(rows))] == [r[3] for r in rows]
    bad = raw.withColumn("CreateTime", F.lit("soon"))
    assert clean_messages(bad).count() == 0


def test_iso(spark):
    row = spark.sql("select '2024-05-06T07:08:09Z' as a, 'x' as b, timestamp_ntz'2024-05-06 07:08:09' as t")
    got = row.select(T.iso(T.parse_iso(F.col("a"))), T.parse_iso(F.col("b")), T.day_minute(F.col("t"))).first()
    assert tuple(got) == ("2024-05-06T07:08:09", None, "2024年05月06日 07:08")


def test_words_and_marks(spark):
    df = spark.createDataFrame([(1, "go go [smile] nb a b2b"), (2, "no [smile] no go [cry]")], "ix long, content string")
    assert [tuple(r) for r in L.word_frequency(df, top=2).collect()] == [("go", 3), ("smile", 2)]
    assert [tuple(r) for r in L.emoji_frequency(df).collect()] == [("smile", 2), ("cry", 1)]


def test_histogram_edges(spark):
    scores = spark.createDataFrame([(0.0,), (2.0,), (10.0,)], "score double")
    assert {r.bucket: r.samples for r in E.histogram(scores).collect()} == {"0-2": 1, "2-4": 1, "4-6": 0, "6-8": 0, "8-10": 0}
    assert E.report(scores.filter("false"), 6).first()["average_score"] == 0.0
    assert E.report(scores, 6).first()["passed_samples"] == 1


def test_render(spark):
    got = spark.range(1).select(T.render("a {x} b {y} {z}", x=F.lit("{y}"), y=F.lit(2))).first()[0]
    assert got == "a {y} b 2 {z}"
