"""Incremental rounds and samples against a full rebuild, on random arrivals."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from convoframe.operators import rounds as R
from convoframe.operators.samples import training_samples
from convoframe.plans.incremental import Edges, Incremental, islands_around
from convoframe.sources.snapshots import Store

T0 = dt.datetime(2024, 3, 1)
MESSAGE = "msg_id string, create_time timestamp_ntz, is_sender int, talker string, room_name string, type_name string, content string, original_msg string, source_file string, file_row long"
CONTACTS = "contact_id string, nickname string, remark string, relationship string, relationship_detail string, message_count long, first_contact_date timestamp_ntz, last_contact_date timestamp_ntz"


def message(file, row, second, who, text):
    sender = 1 if who == "me" else 0
    return (f"{file}{row}", T0 + dt.timedelta(seconds=second), sender, who, None, "文本", text, text, file, row)


def burst(draw, file, start, n):
    """Messages with small and large gaps from a start on; equal times happen."""
    t, out = start, []
    for i in range(n):
        t += draw.choice([0, 5, 20, 80, 90, 95, 200, 300, 310, 2000])
        out.append(message(file, i, t, draw.choice(["me", "me", "a", "b"]), f"{file}.{i}"))
    return out


def contacts_of(spark, name="Ann"):
    return spark.createDataFrame([("a", name, "", "同事", "desk", 0, None, None), ("b", "Bob", "", "朋友", "", 0, None, None)], CONTACTS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def assert_as_rebuilt(spark, kept, messages, contacts):
    runs = R.with_runs(R.numbered(spark.createDataFrame(messages, MESSAGE)))
    rounds = R.extract_rounds(runs)
    assert rows_of(kept.timeline(), "ix", "t", "mine", "talker", "run", "content") == rows_of(runs, "ix", "t", "mine", "talker", "run", "content")
    assert rows_of(kept.rounds(), *rounds.columns) == rows_of(rounds, *rounds.columns)
    samples = training_samples(rounds, runs, contacts)
    assert rows_of(kept.samples(), *samples.columns) == rows_of(samples, *samples.columns)
    return rounds.count()


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_a_full_rebuild(spark, tmp_path, seed):
    draw = random.Random(seed)
    kept = Incremental(Store(spark, str(tmp_path / "store")))
    files: dict[str, list] = {}
    contacts, found = contacts_of(spark), 0
    for step in range(4):
        new = {}
        for k in range(draw.randrange(1, 3)):
            # Near midnight, so that runs, rounds and histories cross buckets.
            day = draw.choice([1, 1, 2, 3, 5, 9])
            new[f"f{step}{k}"] = burst(draw, f"f{step}{k}", day * 86_400 - draw.randrange(4000), draw.randrange(5, 25))
        changed = []
        if step == 2:  # a known file comes again, without some rows
            name = draw.choice(sorted(files))
            changed, new[name] = [name], [m for m in files[name] if draw.random() < 0.6]
        files.update(new)
        if step == 3:
            contacts = contacts_of(spark, "Anna")
        kept.update(spark.createDataFrame([m for f in new.values() for m in f], MESSAGE), contacts, changed)
        found = assert_as_rebuilt(spark, kept, [m for f in files.values() for m in f], contacts)
    assert found > 3


def test_only_what_a_change_reaches_is_written(spark, tmp_path):
    draw = random.Random(9)
    kept = Incremental(Store(spark, str(tmp_path / "store")))
    first = [m for d in range(20) for m in burst(draw, f"d{d}", d * 86_400 + 40_000, 12)]
    before = kept.update(spark.createDataFrame(first, MESSAGE), contacts_of(spark))
    late = burst(draw, "late", 10 * 86_400 + 50_000, 6)
    after = kept.update(spark.createDataFrame(late, MESSAGE), contacts_of(spark))
    moved = {name: {int(b) for b, f in after.tables[name]["folders"].items() if before.tables[name]["folders"].get(b) != f} for name in ("timeline", "rounds", "samples", "talkers")}
    day = int(T0.timestamp() // 86_400) + 10 if T0.tzinfo else (T0 - dt.datetime(1970, 1, 1)).days + 10
    assert moved["timeline"] == moved["talkers"] == {day} and moved["rounds"] <= {day} and moved["samples"] <= {day + i for i in range(4)}
    assert_as_rebuilt(spark, kept, first + late, contacts_of(spark))
    # The same file again is the same: nothing is added twice.
    kept.update(spark.createDataFrame(late, MESSAGE), contacts_of(spark), ["late"])
    assert_as_rebuilt(spark, kept, first + late, contacts_of(spark))
    stats = {r["talker"]: r["message_count"] for r in kept.message_stats().collect()}
    assert sum(stats.values()) == len(first + late)
    # Nothing new: no new version.
    version = kept.store.current().version
    assert kept.update(spark.createDataFrame([], MESSAGE), contacts_of(spark)).version == version


def test_bridge_over_midnight_comes_and_goes(spark, tmp_path):
    """A message that joins two islands across buckets, and then is taken away again."""
    kept = Incremental(Store(spark, str(tmp_path / "store")))
    a = [message("a", 0, 86_400 - 400, "a", "x"), message("a", 1, 86_400 + 100, "me", "y"), message("a", 2, 86_400 + 120, "a", "z")]
    bridge = [message("b", 0, 86_400 - 150, "a", "between"), message("b", 1, 2 * 86_400 + 5, "me", "far")]
    contacts = contacts_of(spark)
    kept.update(spark.createDataFrame(a, MESSAGE), contacts)
    assert assert_as_rebuilt(spark, kept, a, contacts) == 0
    kept.update(spark.createDataFrame(bridge, MESSAGE), contacts)
    assert assert_as_rebuilt(spark, kept, a + bridge, contacts) == 1
    kept.update(spark.createDataFrame(bridge[1:], MESSAGE), contacts, ["b"])
    assert assert_as_rebuilt(spark, kept, a + bridge[1:], contacts) == 0


@pytest.mark.parametrize("seed", range(20))
def test_islands_around_end_at_gaps(seed):
    draw = random.Random(seed)
    width, barrier = 100, 12
    times = [sorted(draw.choices(range(1200), k=draw.randrange(2, 120))) for _ in range(2)]
    touched = {t // width for t in set(times[0]) ^ set(times[1])} | {times[0][0] // width}

    def edges(ts):
        out = {}
        for b in {t // width for t in ts}:
            inner = [t for t in ts if t // width == b]
            starts = [y for x, y in zip(inner, inner[1:]) if y - x > barrier]
            out[b] = Edges(inner[0], inner[-1], starts[0] if starts else None, starts[-1] if starts else None)
        return out

    # Outside the touched buckets both lists must be alike.
    times[1] = sorted([t for t in times[1] if t // width in touched] + [t for t in times[0] if t // width not in touched])
    spans = islands_around(edges(times[0]), edges(times[1]), sorted(touched), barrier, width)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert all(any(lo <= b * width and (b + 1) * width <= hi for lo, hi in spans) for b in touched)
    for ts in times:
        for x, y in zip(ts, ts[1:]):
            if y - x <= barrier:
                assert all((lo <= x < hi) == (lo <= y < hi) for lo, hi in spans)


def test_a_commit_writes_its_messages_few_times(spark, tmp_path):
    """Passes over the timeline read what is written already."""
    from convoframe.plans import fixtures as A
    from convoframe.plans.incremental import Incremental
    from convoframe.sources.scratch import noted
    from convoframe.sources.snapshots import Store

    kept = Incremental(Store(spark, f"file://{tmp_path}/few-writes"))
    with noted() as made:
        kept.add(A.messages(spark, "/root/testdata/sf0.001")).publish()
    assert kept.rounds().count() > 0
    assert len(made) <= 5


def test_texts_are_written_few_times_on_the_way_to_samples(spark, tmp_path):
    """Passes over the timeline carry no texts, and samples read them from the store."""
    from convoframe.plans import fixtures as A
    from convoframe.sources.scratch import noted

    kept = Incremental(Store(spark, f"file://{tmp_path}/few-texts"))
    with noted() as made:
        kept.update(A.messages(spark, "/root/testdata/sf0.001"), A.contacts(spark, "/root/testdata/sf0.001"))
    assert kept.samples().count() > 0
    assert sum(bool({"content", "text"} & set(spark.read.parquet(path).columns)) for path in made) <= 5
