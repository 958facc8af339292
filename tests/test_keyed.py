"""Keyed tables: upserts touch their buckets only, reads give the latest row, repeats change nothing."""

import random

import pytest

from convoframe.sources import keyed
from convoframe.sources.snapshots import Store

SCHEMA = "key string, score double, note string"


@pytest.fixture
def table(spark, tmp_path):
    return keyed.Keyed(Store(spark, str(tmp_path / "store")), "cache", "key", SCHEMA, buckets=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def folders(snapshot):
    return {b: keyed._several(f) for b, f in snapshot.tables["cache"]["folders"].items()}


def test_random_upserts_equal_a_dict(spark, table, monkeypatch):
    monkeypatch.setattr(keyed, "DELTAS", 2)
    draw, known = random.Random(3), {}
    for step in range(6):
        rows = [(f"k{draw.randrange(12)}", float(step), f"{step}.{i}") for i in range(draw.choice([1, 2, 6]))]
        table.upsert(frame(spark, [*rows, (None, 0.0, "no key")]))
        for k in {r[0] for r in rows}:
            known[k] = max(r for r in rows if r[0] == k)
        assert {r["key"]: tuple(r) for r in table.read().collect()} == known
        assert max(len(f) for f in folders(table.store.current()).values()) <= 3
    wanted = frame(spark, [("k1", None, None), ("k1", None, None), ("nobody", None, None)])
    assert [tuple(r) for r in table.find(wanted).collect()] == [known[k] for k in ("k1",) if k in known]
    table.clear()
    assert table.read().collect() == []


def test_an_upsert_touches_its_buckets_only(spark, table):
    first = table.upsert(frame(spark, [(f"k{i}", 1.0, "") for i in range(100)]))
    second = table.upsert(frame(spark, [("k5", 2.0, "new"), ("k6", 2.0, "new")]))
    changed = [b for b, f in folders(second).items() if folders(first)[b] != f]
    assert len(folders(first)) == 8 and 1 <= len(changed) <= 2
    assert all(folders(second)[b][:-1] == folders(first)[b] for b in changed)  # nothing rewritten
    files = {r["f"] for r in table._rows(second, [int(changed[0])]).selectExpr("input_file_name() as f").collect()}
    assert all(f"_bucket={changed[0]}/" in f for f in files)


def test_repeats_and_deaths(spark, table, monkeypatch):
    rows = frame(spark, [("a", 1.0, "x"), ("b", 2.0, None)])
    table.upsert(rows)
    table.upsert(rows)  # a retry
    assert table.read().count() == 2
    version = table.store.current().version
    assert table.upsert(rows.filter("false")).version == version
    monkeypatch.setattr(table.store.files, "write_once", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.upsert(frame(spark, [("a", 9.0, "lost")]))
    monkeypatch.undo()
    assert {r["key"]: r["score"] for r in table.read().collect()} == {"a": 1.0, "b": 2.0}
    table.upsert(frame(spark, [("a", 3.0, "y")]))
    assert {r["key"]: r["score"] for r in table.read().collect()} == {"a": 3.0, "b": 2.0}
