"""Tree merges: prompts within their size, one path asked again, nothing lost."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from convoframe.operators import reduction as R

ITEM = "owner string, pos long, sub long, weight long, text string"


def brute_groups(items, fan, limit):
    blocks = defaultdict(list)
    for owner, pos, sub, weight, text in items:
        half = limit // 2
        for p in range(max(1, -(-len(text) // half))):
            blocks[owner, pos // fan].append((pos, sub, p, weight if p == 0 else 0, text[p * half : (p + 1) * half]))
    out = {}
    for (owner, block), parts in blocks.items():
        parts.sort(key=lambda x: x[:3])
        whole, at = sum(len(p[4]) for p in parts) <= limit, 0
        for *_, weight, text in parts:
            g = out.setdefault((owner, block, 0 if whole else at // half_of(limit)), [0, 0, 0, []])
            g[0], g[1], g[2] = g[0] + 1, g[1] + weight, g[2] + len(text)
            g[3].append(text)
            at += len(text)
    return {k: tuple(v) for k, v in out.items()}


def half_of(limit):
    return limit // 2


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_packing_by_hand(spark, seed):
    draw = random.Random(seed)
    items = [(draw.choice("ab"), p, s, draw.randrange(5), draw.choice("xyz") * draw.choice([0, 3, 20, 59, 60, 200])) for p in range(30) for s in range(draw.choice([1, 1, 2]))]
    got = {(r["owner"], r["block"], r["grp"]): (r["parts"], r["weight"], r["chars"], r["texts"]) for r in R.groups(spark.createDataFrame(items, ITEM), 4, 120).collect()}
    assert got == {k: (*v[:3], v[3]) for k, v in brute_groups(items, 4, 120).items()}
    assert max(v[2] for v in got.values()) <= 120


class Tree:
    """A reduction whose replies are remembered by content and counted."""

    def __init__(self, spark, path, reply, limit=200):
        self.spark, self.path, self.reply, self.limit, self.known, self.asked, self.longest, self.runs = spark, path, reply, limit, {}, [], 0, 0

    def keep(self, df, name):
        path = f"{self.path}/{self.runs}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def ask(self, groups, number):
        out = []
        for g in groups.collect():  # a test's groups are few
            key = (g["owner"], tuple(g["texts"]))
            self.longest = max(self.longest, g["chars"])
            if key not in self.known:
                self.asked.append(number)
                self.known[key] = self.reply(g)
            out.append((g["owner"], g["block"], g["grp"], g["leaves"], g["weight"], self.known[key]))
        return self.spark.createDataFrame(out, "owner string, block long, grp int, leaves long, weight long, text string")

    def run(self, items):
        self.runs += 1
        self.asked = []
        return {r["owner"]: (r["leaves"], r["text"]) for r in R.reduce_tree(self.spark.createDataFrame(items, ITEM), self.ask, self.keep, 4, self.limit).collect()}


def test_one_changed_text_asks_one_path(spark, tmp_path):
    items = [("a", p, 0, 1, f"text {p:03d}") for p in range(64)] + [("b", 0, 0, 1, "only")]
    tree = Tree(spark, tmp_path, lambda g: hashlib.md5(repr(g["texts"]).encode()).hexdigest())
    first = tree.run(items)
    assert Counter(tree.asked) == {1: 17, 2: 4, 3: 1} and first["a"][0] == 64 and first["b"][0] == 1 and tree.longest <= 200
    items[37] = ("a", 37, 0, 1, "text new")
    assert tree.run(items)["a"][0] == 64 and tree.asked == [1, 2, 3]
    assert tree.run(items)["a"] and tree.asked == []
    tree.run([*items, ("a", 64, 0, 1, "text 064")])
    # The added text's block; the old root moves up unchanged to be merged with it once.
    assert Counter(tree.asked) == {1: 1, 4: 1}


def test_long_texts_and_replies_stay_within_the_limit(spark, tmp_path):
    draw = random.Random(4)
    items = [(o, p, 0, 7, draw.choice("xyz") * draw.randrange(900)) for o in "abc" for p in range(23)]
    tree = Tree(spark, tmp_path, lambda g: "r" * (g["chars"] // 3), limit=300)
    got = tree.run(items)
    assert {o: w for o, (w, _) in got.items()} == {"a": 23, "b": 23, "c": 23} and tree.longest <= 300


def test_replies_that_do_not_shrink_are_an_error(spark, tmp_path):
    tree = Tree(spark, tmp_path, lambda g: "r" * 190)
    with pytest.raises(ValueError, match="do not shrink"):
        tree.run([("a", p, 0, 1, "x" * 90) for p in range(9)])


def test_no_items_and_spread_places(spark, tmp_path):
    tree = Tree(spark, tmp_path, lambda g: "r")
    assert tree.run([]) == {}
    rows = spark.range(100).withColumn("contact", F.concat(F.lit("c"), "id"))
    some = {r["contact"]: r["pos"] for r in R.spread(rows.filter("id < 90"), "contact", 90, 4).collect()}
    more = {r["contact"]: r["pos"] for r in R.spread(rows, "contact", 100, 4).collect()}
    assert all(more[c] == p for c, p in some.items()) and max(more.values()) < 256
    assert {r["pos"] for r in R.spread(rows.filter("id < 4"), "contact", 4, 4).collect()} == {0}
