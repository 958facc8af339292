"""Every query against its SQL oracle, on the smallest fixture."""

import duckdb
import pytest

import __spark_entry__ as entry
from convoframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    found = got.collect()
    assert found or name == "q_contact_search"
    if name in catalogue.ORACLES:
        expected = duck.sql(catalogue.ORACLES[name])
        assert sorted(expected.columns) == sorted(got.columns)
        assert rows(got.columns, found) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 28
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_training_samples_know_their_contacts(spark):
    found = catalogue.QUERIES["q_training_samples"](spark, SF).collect()
    assert any("你的朋友" not in r["instruction"] for r in found)
