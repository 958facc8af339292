"""The T-occurrence join against brute force, and its defined results in corner cases."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoframe.llm import overlap
from convoframe.llm import queries as Q

sys.path.insert(0, str(Path(__file__).parent))
from test_llm_operators import ODD, brute_components

SF = "/root/testdata/sf0.001"


def groups_of(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()}


def linked(n, pairs):
    """Each place's least place reachable by pairs."""
    root = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("seed", range(30))
def test_merge_and_divide_skip_find_what_counting_finds(seed):
    draw = random.Random(seed)
    post, lists = [], []
    for _ in range(draw.randrange(1, 12)):
        docs = sorted(draw.sample(range(40), draw.randrange(1, 30)))
        lists.append((len(post), len(post) + len(docs)))
        post += docs
    counts = Counter(post)
    for least in range(1, len(lists) + 2):
        enough = {d: n for d, n in counts.items() if n >= least}
        assert dict(overlap.merge_skip(lists, post, least)) == enough
        if least <= len(lists):
            assert dict(overlap.divide_skip(lists, post, least, lambda d: d % 3 > 0, lambda d: least + d % 2)) == {d: n for d, n in enough.items() if d % 3 > 0 and n >= least + d % 2}


@pytest.mark.parametrize("seed", range(30))
def test_block_search_joins_what_all_pairs_join(seed):
    draw = random.Random(seed)
    percent = draw.choice([50, 80, 85, 100])
    sets = []
    for _ in range(draw.randrange(1, 6)):
        base = draw.sample(range(1000), draw.randrange(1, 60))
        for _ in range(draw.randrange(1, 8)):
            edited = [x for x in base if draw.random() > 0.08] + draw.sample(range(1000, 1100), draw.randrange(4))
            sets.append(np.unique(np.array(edited or base, np.uint64)))
    near = lambda a, b: 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i].tolist(), sets[j].tolist())]
    found = overlap.search_block(sets, list(range(len(sets))), percent)
    assert set(map(frozenset, found)) <= set(map(frozenset, pairs))
    assert linked(len(sets), found) == linked(len(sets), pairs) and len(found) == len(sets) - len(set(linked(len(sets), pairs)))
    indexed = [draw.random() < 0.5 for _ in sets]
    labels = [draw.randrange(4) if not i else 10 + k for k, i in enumerate(indexed)]
    same = [(i, j) for i in range(len(sets)) for j in range(i) if labels[i] == labels[j]]
    found = overlap.search_block(sets, labels, percent, indexed)
    assert linked(len(sets), found + same) == linked(len(sets), same + [(i, j) for i, j in pairs if indexed[i] or indexed[j]])


def test_query_equals_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = groups_of(Q.QUERIES["op11_overlap"](spark, SF))
    assert got == brute_components([(r["doc_id"], r["text"]) for r in documents.collect()], 4, 85)
    assert sum(d != c for d, (_, c) in got.items()) > 5


def families(seed, n=120):
    """Texts of one template with own parts, near copies of one text, chains of edits and unrelated texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    head, block, docs = [word() for _ in range(60)], [[word() for _ in range(12)] for _ in range(8)], []
    copy = [word() for _ in range(200)]
    for _ in range(n):
        kind = draw.randrange(4)
        if kind == 0:
            text = head + [word() for _ in range(draw.randrange(4, 20))]
        elif kind == 1:
            text = list(copy)
            for _ in range(draw.randrange(6)):
                text[draw.randrange(len(text))] = word()
        elif kind == 2:
            text = head[:20] + sum(draw.sample(block, 5), [])
        else:
            copy = [*copy[draw.randrange(3) :], word()]
            text = copy
        docs.append(" ".join(text))
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,block", [(1, 1 << 19), (2, 2000), (3, 800)])
def test_groups_of_several_blocks(spark, monkeypatch, seed, block):
    monkeypatch.setattr(overlap, "BLOCK_SHINGLES", block)
    docs = families(seed)
    got = groups_of(overlap.overlap_groups(spark.createDataFrame(docs, "doc_id long, text string"), width=2, percent=85))
    assert got == brute_components(docs, 2, 85)


def test_links_between_blocks_are_found(spark, monkeypatch):
    """The last step by itself: pairs of different components in different blocks of one group."""
    docs = families(5)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(overlap, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(overlap, "_in_blocks", lambda groups, f=overlap._in_blocks: f(groups).filter("x = leader"))
    monkeypatch.setattr(overlap, "_leader_pairs", lambda signed, percent: signed.filter("_set is not null").select(F.lit(min_set(signed)).alias("leader"), F.col("_set").alias("x"), F.col("_n").alias("x_n")).filter("x <> leader").distinct())
    assert groups_of(overlap.overlap_groups(rows, width=2, percent=85)) == brute_components(docs, 2, 85)


def min_set(signed):
    return signed.agg(F.min("_set")).first()[0]


def test_copies_grow_with_their_number(spark, monkeypatch):
    """Near copies take a search a block, not one a pair."""
    searches = []
    search = overlap.divide_skip
    monkeypatch.setattr(overlap, "divide_skip", lambda *a: searches.append(1) or search(*a))
    draw = random.Random(3)
    base = list(range(300))
    for n in (50, 400):
        searches.clear()
        sets = [np.unique(np.array([x for x in base if draw.random() > 0.02], np.uint64)) for _ in range(n)]
        assert len(overlap.search_block(sets, list(range(n)), 85)) == n - 1
        assert len(searches) <= n


def test_odd_rows_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    plain = Counter(map(tuple, overlap.overlap_groups(rows).collect()))
    assert Counter(d for d, _, _ in plain.elements()) == Counter(r[0] for r in ODD)
    by_id = {d: (n, c) for d, n, c in plain}
    assert by_id[1] == (0, 1) and by_id[3] == (0, 3) and by_id[5] == (1, 4) and by_id[4] == (1, 4) and by_id[None][0] == 1
    for name in ("_id", "_n", "_set", "_bands", "_text", "leader", "x", "root", "block", "component_id", "n_shingles"):
        rows = rows.withColumn(name, F.lit("clash"))
    assert Counter(map(tuple, overlap.overlap_groups(rows).collect())) == plain
    assert overlap.overlap_groups(rows.filter("false")).collect() == []
    by_text = overlap.overlap_groups(rows.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).collect()
    assert {r["doc_id"]: r["component_id"] for r in by_text}["d5"] == "d4"


def test_members_that_nobody_can_be_linked_to_are_left_out(spark):
    """A shared shingle with too few behind it makes no pair; every linked pair still meets in a group."""
    kind = "_set long, _n long, _bands array<long>"
    late = [(1, 100, [*range(1, 15), 99]), (2, 100, [*range(21, 35), 99]), (3, 100, [50]), (4, 86, [50]), (5, 60, [70]), (6, 100, [70])]
    assert {(r["leader"], r["x"]) for r in overlap._leader_pairs(spark.createDataFrame(late, kind), 85).collect()} == {(4, 3)}
    for seed, percent in ((1, 85), (2, 60), (3, 100)):
        draw = random.Random(seed)
        sets = []
        for _ in range(25):
            base = draw.sample(range(400), draw.randrange(1, 60))
            sets += [set(base)] + [set(draw.sample(base, max(1, len(base) - draw.randrange(5)))) | set(draw.sample(range(400), draw.randrange(4))) for _ in range(4)]
        sets = list({tuple(sorted(s)) for s in sets})
        rows = [(i, len(s), list(s[: len(s) - -(-percent * len(s) // 100) + 1])) for i, s in enumerate(sets)]
        groups = {}
        for r in overlap._leader_pairs(spark.createDataFrame(rows, kind), percent).collect():
            groups.setdefault(r["leader"], {r["leader"]}).add(r["x"])
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len({*a} & {*b}) >= percent * len({*a} | {*b}):
                    assert any({i, j} <= g for g in groups.values()), (percent, a, b)
