"""Rounds, context and history against plain loops over the message list."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from convoframe.operators import context as X
from convoframe.operators import rounds as R

T0 = dt.datetime(2024, 3, 1, 12, 0, 0)


def frame(spark, messages):
    """messages: (second, talker, is_sender, content)."""
    rows = [(str(i), T0 + dt.timedelta(seconds=s), f, who, text, "f", i) for i, (s, who, f, text) in enumerate(messages)]
    return spark.createDataFrame(rows, "msg_id string, create_time timestamp_ntz, is_sender int, talker string, content string, source_file string, file_row long")


def pairs(spark, messages, rules=R.RoundRules()):
    runs = R.with_runs(R.numbered(frame(spark, messages)), rules)
    return sorted((r.other_first_ix, r.other_last_ix, r.my_first_ix, r.my_last_ix) for r in R.extract_rounds(runs, rules).collect())


def greedy(messages, gap=90, delay=300, ahead=10):
    """The rounds by a scan: take a block of the other, look for the reply, go on behind it."""
    out, i, n = [], 0, len(messages)
    while i < n:
        t, who, flag, _ = messages[i]
        if flag == 1:
            i += 1
            continue
        end = i
        while end + 1 < n and messages[end + 1][2] != 1 and messages[end + 1][1] == who and messages[end + 1][0] - messages[end][0] <= gap:
            end += 1
        reply = next((j for j in range(end + 1, min(n, end + 1 + ahead)) if messages[j][2] == 1 and messages[j][0] - messages[end][0] <= delay), None)
        if reply is None:
            i = end + 1
            continue
        last = reply
        while last + 1 < n and messages[last + 1][2] == 1 and messages[last + 1][0] - messages[last][0] <= gap:
            last += 1
        out.append((i, end, reply, last))
        i = last + 1
    return out


M = lambda t: (t, "me", 1, "m")
A = lambda t: (t, "a", 0, "a")
B = lambda t: (t, "b", 0, "b")
C = lambda t: (t, "c", 0, "c")


@pytest.mark.parametrize(
    ("messages", "expected"),
    [
        ([A(0), A(90), M(100)], [(0, 1, 2, 2)]),
        ([A(0), A(91), M(100)], [(0, 0, 2, 2)]),
        ([A(0), M(300)], [(0, 0, 1, 1)]),
        ([A(0), A(200), M(301)], [(1, 1, 2, 2)]),
        ([A(0), B(10), M(20)], [(0, 0, 2, 2)]),
        ([A(0), *[(B, C)[i % 2](i + 1) for i in range(9)], M(20)], [(0, 0, 10, 10)]),
        ([A(0), *[(B, C)[i % 2](i + 1) for i in range(10)], M(20)], [(1, 1, 11, 11)]),
        ([A(0), M(10), M(101)], [(0, 0, 1, 1)]),
        ([A(5), M(5)], [(0, 0, 1, 1)]),
        ([(0, "a", 2, "x"), M(3)], [(0, 0, 1, 1)]),
        ([], []),
    ],
)
def test_edges(spark, messages, expected):
    assert greedy(messages) == expected
    assert pairs(spark, messages) == expected


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    messages, t = [], 0
    for _ in range(400):
        t += rng.choice((0, 1, 30, 90, 91, 200, 300, 301, 4000))
        who = rng.choice("mmabc")
        messages.append((t, "me" if who == "m" else who, rng.choice((0, 0, 0, 2)) if who != "m" else 1, who))
    assert pairs(spark, messages) == greedy(messages)


def brute_history(messages, first, last, reply, talker, lines=30):
    when = lambda i: T0 + dt.timedelta(seconds=messages[i][0])
    t1 = messages[reply][0]
    rows = [(m[0], 0, i) for i, m in enumerate(messages) if t1 - 72 * 3600 <= m[0] < t1 and ((m[2] == 0 and m[1] == talker) or m[2] == 1)]
    rows += [(messages[i][0], 1, i) for i in range(first, last + 1)]
    out, day = [], None
    for _, _, i in sorted(rows):
        if when(i).date() != day:
            day = when(i).date()
            out.append(f"————— {when(i):%Y年%m月%d日} —————")
        out.append(f"[{when(i):%H:%M:%S}] {'我' if messages[i][2] == 1 else talker}: {messages[i][3]}")
    return "\n".join(out[-lines:])


@pytest.mark.parametrize("seed", range(2))
def test_history_and_summary(spark, seed):
    rng = random.Random(seed)
    messages, t = [], 0
    for k in range(150):
        t += rng.choice((0, 1, 60, 200, 9000, 40_000))
        who = rng.choice("mmab")
        messages.append((t, "me" if who == "m" else who, rng.choice((0, 0, 2)) if who != "m" else 1, f"{who}{k}"))
    runs = R.with_runs(R.numbered(frame(spark, messages)))
    rounds = R.extract_rounds(runs).withColumn("other_name", F.col("talker"))
    expected = {r: brute_history(messages, a, b, r, messages[a][1]) for a, b, r, _ in greedy(messages)}
    assert {r.round_id: r.history for r in X.history_lines(rounds, runs, F.lit("我")).collect()} == expected
    listed = X.context_rows(rounds, runs).groupBy("round_id").count()
    summed = X.context_summary(rounds, runs).filter("context_n > 0").select("round_id", F.col("context_n").alias("count"))
    assert {tuple(r) for r in listed.collect()} == {tuple(r) for r in summed.collect()}


def test_plans_have_no_nested_loops(spark):
    runs = R.with_runs(R.numbered(frame(spark, [A(0), M(1)])))
    rounds = R.extract_rounds(runs).withColumn("other_name", F.col("talker"))
    for df in (X.context_rows(rounds, runs), X.context_summary(rounds, runs), X.history_lines(rounds, runs, F.lit("我"))):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_dense_hour_is_spread(spark, monkeypatch):
    """Nine tenths of the messages in one hour, most of them at one time: buckets are even, values as before."""
    from convoframe.operators import timeline as L

    rng = random.Random(8)
    messages = [(3600 * 40 + rng.choice([7, 7, 7, rng.randrange(3000)]), *rng.choice([("me", 1), ("a", 0), ("b", 0)]), str(i)) for i in range(900)]
    messages += [(rng.randrange(3600 * 80), *rng.choice([("me", 1), ("a", 0)]), f"x{i}") for i in range(100)]
    df = frame(spark, messages)
    plain = sorted(map(tuple, R.with_runs(R.numbered(df)).select("ix", "t", "talker", "run", "content").collect()))
    monkeypatch.setattr(L, "DENSE", 60)
    dense = R.numbered(df, keep_bucket=True)
    counts = [r["count"] for r in dense.groupBy("_bucket").count().collect()]
    assert max(counts) <= 60 and len(counts) >= 1000 // 60
    assert sorted(map(tuple, R.with_runs(R.numbered(df)).select("ix", "t", "talker", "run", "content").collect())) == plain
    assert sorted(map(tuple, R.with_runs(dense).select("ix", "t", "talker", "run", "content").collect())) == plain
    by_talker = L.running(R.numbered(df).select("ix", "t", "talker"), ["t", "ix"], keys=("talker",), sums={"o": F.lit(1)})
    for talker in ("me", "a", "b"):
        assert [r["o"] for r in by_talker.filter(F.col("talker") == talker).orderBy("ix").collect()] == list(range(sum(m[1] == talker for m in messages)))


def shuffled(spark, run):
    """Rows that the shuffles of ``run()`` write."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda seq: [seq.apply(i) for i in range(seq.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    before = set(stages())
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_history_moves_rounds_and_no_lines(spark):
    """Sixty lines may show in each round; what is shuffled stays a few rows a message."""
    from convoframe.sources.scratch import materialised

    messages = [(20 * i, "am"[i % 2].replace("m", "me"), i % 2, str(i)) for i in range(1200)]
    runs = materialised(R.with_runs(R.numbered(frame(spark, messages))), "runs")
    rounds = materialised(R.extract_rounds(runs).withColumn("other_name", F.col("talker")), "rounds")
    assert rounds.count() == 600
    found = []
    rows = shuffled(spark, lambda: found.extend(X.history_lines(rounds, runs, F.lit("我")).collect()))
    assert len(found) == 600 and max(r.history.count("\n") for r in found) == X.LINES - 1
    assert rows < 15 * len(messages)


def test_samples_move_rounds_and_no_lines(spark):
    """As above for whole samples: the history is made where its round is, and not shuffled to it."""
    from convoframe.operators.samples import training_samples
    from convoframe.sources.scratch import materialised

    messages = [(20 * i, "am"[i % 2].replace("m", "me"), i % 2, str(i)) for i in range(1200)]
    runs = materialised(R.with_runs(R.numbered(frame(spark, messages))), "runs")
    rounds = materialised(R.extract_rounds(runs), "rounds")
    contacts = spark.createDataFrame([("a", "nick", "", "friend", "", None)], "contact_id string, nickname string, remark string, relationship string, relationship_detail string, first_contact_date timestamp_ntz")
    found = []
    rows = shuffled(spark, lambda: found.extend(training_samples(rounds, runs, contacts).collect()))
    assert len(found) == 600 and all("] nick: " in r.input for r in found)
    assert rows < 18 * len(messages)
