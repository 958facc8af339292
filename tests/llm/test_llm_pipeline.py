"""The pipeline's stages against their operators' brute force, and the registered queries."""

import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as P
from convoframe.llm import queries as Q
from test_llm_operators import WORD, base_spans, brute_components, water_fill

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = P.read_table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in P.STAGES:
        docs = P.write_table(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def test_language_keeps_clean_documents(stages):
    before = {r["doc_id"]: r["text"] for r in stages["documents"].collect()}
    after = {r["doc_id"] for r in stages["language"].collect()}
    assert after <= set(before)
    gone = [before[d] for d in set(before) - after]
    assert len(gone) <= 0.01 * len(before) and all(len(re.findall(r"[^\W\d_]", t or "")) < 200 for t in gone)


def test_one_document_of_a_group_stays(stages):
    groups = brute_components([(r["doc_id"], r["text"]) for r in stages["language"].collect()], 5)
    assert {r["doc_id"] for r in stages["neardup"].collect()} == {d for d, (_, c) in groups.items() if c == d}


def test_secrets_are_gone(stages):
    assert any(base_spans(r["text"] or "") for r in stages["neardup"].collect())
    assert not any(base_spans(r["text"] or "") for r in stages["secrets"].collect())
    assert stages["secrets"].count() == stages["neardup"].count()
    assert stages["secrets"].filter("n_chars <> length(text)").count() == 0


def test_mix_meets_its_targets(stages):
    sizes, taken = Counter(), Counter()
    for r in stages["secrets"].collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in stages["mixing"].collect():
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    for s, target in water_fill(sizes).items():
        assert abs(taken[s] - target) <= 1


def test_packing_covers_all_ids(stages):
    pieces = stages["packing"].collect()
    docs = Counter(r["doc_id"] for r in stages["mixing"].collect())
    starts = Counter(p["doc_id"] for p in pieces if p["start"] == 0)
    assert starts == docs
    ends = Counter(p["doc_id"] for p in pieces if p["start"] + p["length"] == p["doc_tokens"])
    assert ends == docs


def test_columns_stay(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_odd_documents_pass_through(spark):
    rows = spark.createDataFrame([(1, None, None, None), (1, "again the same id and the text of it", "en", "s"), (None, "no id but text in the row of this table", "en", "s"), (2, "the of and to in is that", "en", None), (2, "the of and to in is that", "en", None)], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = P.write_table(rows, "odd")
    for _, stage in P.STAGES:
        docs = P.write_table(stage(spark, docs, SF), "odd")
    assert docs.count() >= 1
    empty = P.write_table(rows.filter("false"), "none")
    for _, stage in P.STAGES:
        empty = P.write_table(stage(spark, empty, SF), "none")
    assert empty.count() == 0


CLASHING = ("_taken", "_copies", "_part", "_kept", "_copy", "_row", "_text", "_id", "size", "taken", "kept", "Key with space", "_Row_")


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("broadcast", [P.BROADCAST_ROWS, 0])
def test_clashing_columns_keep_their_values(spark, unique, broadcast, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", broadcast)
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").drop("n_chars")
    rows = sample.filter("length(text) < 3000")
    if not unique:
        rows = rows.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.floor(F.col("doc_id") / 2))).withColumn("doc_id", F.col("doc_id").cast("long"))
    for name in CLASHING:
        rows = rows.withColumn(name, F.concat(F.lit(f"{name}:"), F.md5(F.concat_ws("|", "doc_id", "lang", "source"))))
    docs = P.write_table(rows, "clashing")
    plain = P.write_table(docs.drop(*CLASHING), "plain")
    for name, stage in P.STAGES[:-1]:
        docs, plain = P.write_table(stage(spark, docs, SF), name), P.write_table(stage(spark, plain, SF), name)
        assert docs.columns == rows.columns
        for c in CLASHING:
            assert docs.filter(F.col(f"`{c}`") != F.concat(F.lit(f"{c}:"), F.md5(F.concat_ws("|", "doc_id", "lang", "source")))).count() == 0
        if unique:
            assert sorted(docs.select("doc_id", "text").collect()) == sorted(plain.select("doc_id", "text").collect())
        else:
            assert docs.count() == plain.count()


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - {"op12_clicks"}))
def test_queries_return_every_row(spark, name):
    out = Q.QUERIES[name](spark, SF)
    table, key = ("pages", "page_id") if "url" in name else ("conversations", "conv_id") if "repair" in name else ("documents", "doc_id")
    expected = spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()
    assert out.select(key).distinct().count() == expected
    if "packing" not in name:
        assert out.count() == expected


def test_windows_are_of_known_clicks_and_once(spark):
    """A click may have no window (all its copies late) or several, of different starts."""
    out = Q.QUERIES["op12_clicks"](spark, SF)
    known = spark.read.parquet(f"{SF}/clicks.parquet").select("click_id")
    assert out.join(known, "click_id", "left_anti").count() == 0
    assert out.select("click_id", "start_hour").distinct().count() == out.count() > known.count() // 2


@pytest.mark.parametrize("name", ["op5_sharding", "op7_mixing", "op8_quality", "op9_urlfilter"])
def test_native_queries_run_no_python(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)


def test_scans_read_only_what_they_use(spark):
    plan = Q.op9_urlfilter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[-1]
