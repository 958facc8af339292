"""The segmenter: best paths against all paths, learnt words against counting, and corner cases."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convoframe.operators import lexicon as L
from convoframe.operators import segment as G


def all_cuts(run):
    for bits in range(1 << max(0, len(run) - 1)):
        ends = [i + 1 for i in range(len(run) - 1) if bits >> i & 1] + [len(run)]
        yield [run[a:b] for a, b in zip([0, *ends], ends)] if run else []


@pytest.mark.parametrize("seed", range(20))
def test_best_path_equals_all_paths(seed):
    draw = random.Random(seed)
    words = {"".join(draw.choices("一丁七万", k=draw.randrange(1, 5))): draw.choice([0, 1, 2, 5, 5, 40]) for _ in range(12)}
    d = G.Dictionary(words)
    total = max(1, sum(words.values()))
    cost = lambda w: min([round(G.SCALE * (math.log(total) - math.log(words[w])))] if words.get(w) else [], default=None)
    for _ in range(20):
        run = "".join(draw.choices("一丁七万丈", k=draw.randrange(0, 11)))
        best = None
        for cut in all_cuts(run):
            costs = [cost(w) if cost(w) is not None else d.unknown if len(w) == 1 else None for w in cut]
            if None not in costs:
                # Of equal paths the one with the longer word first.
                key = (sum(costs), [-len(w) for w in cut])
                best = min(best, (key, cut)) if best else (key, cut)
        assert d.cut(run) == best[1]


def test_words_of_mixed_text():
    d = G.Dictionary({"我们": 50, "今天": 40, "去": 30, "吃饭": 20, "天去": 1})
    assert d.words("我们今天去吃饭，ok? 哈Ünïcode哈 v2。") == ["我们", "今天", "去", "吃饭", "ok", "哈", "Ünïcode", "哈", "v"]
    assert d.words("") == [] and G.Dictionary({}).words("你好") == ["你", "好"]
    assert G.with_words(d, [("ok了", 9), ("今天", 0)]).cut("今天") == ["今", "天"]
    assert G.Dictionary({"the": 5, "and": 5}).words("theand x1", G.CUT_ALL) == ["the", "and", "x"]


def test_spark_cuts_as_python_does(spark):
    d = G.Dictionary({"我们": 50, "今天": 40, "去": 30})
    texts = [None, "", "我们今天去", "我们 today去" * 3000, "。！", "我们今天去", "x" * 30_000]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "ix int, content string, word string")
    got = {r["ix"]: r["words"] for r in rows.select("ix", G.segmented_words(F.col("content"), d).alias("words")).collect()}
    assert got == {i: d.words(t or "") for i, t in enumerate(texts)}
    top = L.word_frequency(rows, words=G.segmented_words(F.col("content"), d)).collect()
    assert [r["word"] for r in top[:2]] == ["today", "我们"] or {r["word"] for r in top[:2]} == {"我们", "today"}


def brute_words(texts, longest, min_count, min_cohesion, min_entropy):
    counts, left, right = Counter(), {}, {}
    for t in texts:
        for run in re.findall(f"[{G._HAN}]+", t or ""):
            for i in range(len(run)):
                for j in range(i + 1, min(len(run), i + longest) + 1):
                    w = run[i:j]
                    counts[w] += 1
                    left.setdefault(w, Counter())[run[i - 1] if i else ("end", counts[w])] += 1
                    right.setdefault(w, Counter())[run[j] if j < len(run) else ("end", counts[w])] += 1
    total = sum(n for w, n in counts.items() if len(w) == 1)
    entropy = lambda c: -sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values())
    out = {}
    for w, n in counts.items():
        if len(w) >= 2 and n >= min_count:
            cohesion = min(n * total / counts[w[:i]] / counts[w[i:]] for i in range(1, len(w)))
            if cohesion >= min_cohesion and min(entropy(left[w]), entropy(right[w])) >= min_entropy:
                out[w] = (n, round(cohesion, 6), round(entropy(left[w]), 6), round(entropy(right[w]), 6))
    return out


def sentences(n=300, others=0):
    draw = random.Random(5)
    words = [chr(0x5000 + 2 * i) + chr(0x5001 + 2 * i) for i in range(others)] + ["我们", "今天", "吃饭", "图书馆", "去", "了", "的", "你", "他", "一起", "不知道", "好"]
    return ["".join(draw.choices(words, k=draw.randrange(1, 12))) + draw.choice(["。", "ok", ""]) for _ in range(n)], words


def test_learnt_words_equal_counting(spark):
    texts, _ = sentences()
    rows = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "content string")
    limits = {"min_count": 5, "min_cohesion": 2.0, "min_entropy": 0.8}
    found = G.learn_words(G.gram_counts(rows, "content", longest=5), 4, **limits).collect()
    got = {r["word"]: (r["n"], *(round(r[c], 6) for c in ("cohesion", "left_entropy", "right_entropy"))) for r in found}
    assert got == brute_words(texts, 4, *limits.values()) and len(got) > 5


def test_learnt_dictionary_cuts_its_language(spark):
    texts, words = sentences(1500)
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    d = G.learn_dictionary(rows, "content", min_cohesion=3.0)
    assert {"我们", "今天", "吃饭", "图书馆", "一起", "不知道"} <= set(d.counts)
    assert d.cut("我们今天一起去图书馆吃饭") == ["我们", "今天", "一起", "去", "图书馆", "吃饭"]
    assert G.dictionary_of(G.learn_words(G.gram_counts(rows, "content", longest=5), 4, min_cohesion=3.0), most=3).counts.keys() <= d.counts.keys()
    empty = rows.filter("false")
    assert G.learn_dictionary(empty, "content").counts == {}


def test_language_patterns_cut_chinese(spark):
    from convoframe.plans.stages import language_patterns

    texts, _ = sentences(1500, others=10)
    rows = spark.createDataFrame([(i, t, i % 2 == 0, "a", 1, i) for i, t in enumerate(texts)], "ix long, content string, mine boolean, talker string, is_sender int, t long")
    words = {r["word"]: r["n"] for r in language_patterns(rows)["words"].collect()}
    assert {"我们", "今天", "图书馆"} <= set(words) and all(len(w) >= 2 for w in words)


def test_a_large_batch_is_cut_in_parts(spark, monkeypatch):
    """However many texts an Arrow batch holds, a worker has the words of few at a time."""
    import pyarrow as pa

    found = []
    monkeypatch.setattr(G.F, "arrow_udf", lambda kind: lambda f: found.append(f) or (lambda c: c))
    G.segmented_words(G.F.lit("x"), G.Dictionary({"ab": 3}), G.CUT_ALL)
    parts = list(found[0](iter([pa.array(["abab", None, "a1b"] * 200)])))
    assert max(map(len, parts)) == G.AT_ONCE
    assert pa.chunked_array(parts).to_pylist() == [["ab", "ab"], [], ["a", "b"]] * 200
