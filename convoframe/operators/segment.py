"""Words of scripts that put no spaces between them: a dictionary learnt from the corpus, and best paths through it.

Which runs of text have to be cut is a pattern; runs of other letters are words as they
stand.  A run is cut into the words of the dictionary that cost least in all, a word's
cost being the negative logarithm of its frequency in whole millionths, so that sums
are exact.  Of equal paths the one with the longer word first is taken.  A character
outside the dictionary is a word of its own, at the cost of one seen once.

The dictionary holds strings whose parts belong together (cohesion: how much more often
they occur together than by chance, for the worst cut) and whose neighbours vary on both
sides (branching entropy).  Counts, cohesion and entropies are plain aggregations over
the whole corpus; only the words found, at most ``most``, are brought together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.sources.ship import ship_package

#: Runs that have to be cut: Han characters.
HAN = r"\p{IsHan}+"
#: The same for Python's expressions.
_HAN = "々〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
CUT_HAN = re.compile(f"([{_HAN}]+)|((?:(?![{_HAN}])[^\\W\\d_])+)")
#: Every run of letters is cut.
CUT_ALL = re.compile(r"([^\W\d_]+)|(?!)()")
SCALE = 1_000_000
#: Runs whose words a task remembers.
REMEMBERED = 1 << 16
#: Texts turned into words at once, whatever an Arrow batch holds.
AT_ONCE = 128


@dataclass(frozen=True)
class Dictionary:
    """Words with their counts, all their beginnings, and costs."""

    counts: dict[str, int]
    costs: dict[str, int] = field(init=False, repr=False)
    unknown: int = field(init=False)

    def __post_init__(self):
        total = max(1, sum(n for n in self.counts.values() if n > 0))
        costs: dict[str, int] = {}
        for word, n in self.counts.items():
            if n > 0 and word:
                for i in range(1, len(word)):
                    costs.setdefault(word[:i], -1)  # a beginning only
                costs[word] = round(SCALE * (math.log(total) - math.log(n)))
        object.__setattr__(self, "costs", costs)
        object.__setattr__(self, "unknown", round(SCALE * math.log(total)))

    def cut(self, run: str) -> list[str]:
        """The cheapest words of a run; of equal ones, the longer first."""
        n = len(run)
        to_go, ends = [0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            best, end, j = self.unknown + to_go[i + 1], i + 1, i + 1
            while j <= n:
                cost = self.costs.get(run[i:j])
                if cost is None:
                    break
                if cost >= 0 and cost + to_go[j] <= best:
                    best, end = cost + to_go[j], j
                j += 1
            to_go[i], ends[i] = best, end
        words, i = [], 0
        while i < n:
            words.append(run[i : ends[i]])
            i = ends[i]
        return words

    def words(self, text: str, pattern: re.Pattern[str] = CUT_HAN) -> list[str]:
        """All words of a text, in order: the pattern's first group is cut, its second kept."""
        return [w for run, kept in pattern.findall(text) for w in (self.cut(run) if run else [kept])]


def segmented_words(text: Column, dictionary: Dictionary, pattern: re.Pattern[str] = CUT_HAN) -> Column:
    """A text's words as an array, in Arrow batches; null texts have none.

    A batch's texts are cut ``AT_ONCE`` at a time, so that a worker holds one batch and the words of few texts.
    """
    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[str]] = {}

        def words_of(text: str | None) -> list[str]:
            words: list[str] = []
            for run, kept in pattern.findall(text) if text else ():
                if run:
                    parts = known.get(run)
                    if parts is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        parts = dictionary.cut(run)
                        if len(run) <= 32:
                            known[run] = parts
                    words += parts
                else:
                    words.append(kept)
            return words

        for texts in batches:
            for start in range(0, len(texts), AT_ONCE):
                yield pa.array([words_of(t) for t in texts.slice(start, AT_ONCE).to_pylist()], pa.list_(pa.string()))

    ship_package(SparkSession.active())
    return cut(text)


def gram_counts(df: DataFrame, text_col: str, runs: str = HAN, longest: int = 5) -> DataFrame:
    """``gram, n``: all strings of up to ``longest`` characters inside the runs; equal runs are counted first."""
    found = df.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"({runs})"), F.lit(1))).alias("run"))
    found = found.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    size = F.length("run")
    grams = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda k: F.substr(F.col("run"), i, k)))
    return found.filter(size > 0).select(F.explode(F.flatten(grams)).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


def learn_words(counts: DataFrame, longest: int = 4, min_count: int = 5, min_cohesion: float = 8.0, min_entropy: float = 1.0) -> DataFrame:
    """``word, n, cohesion, left_entropy, right_entropy`` of strings of two to ``longest`` characters that pass all limits.

    ``counts`` are those of ``gram_counts`` with one character more than ``longest``.
    Where a run ends, the neighbour counts as one met nowhere else.
    """
    total = counts.filter(F.length("gram") == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = F.length("gram")
    words = counts.filter((size >= 2) & (size <= longest) & (F.col("n") >= min_count)).select(F.col("gram").alias("word"), "n")
    part = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")
    parts = words.select("word", "n", part).select("word", "n", F.substr("word", F.lit(1), F.col("at")).alias("head"), F.substr("word", F.col("at") + 1).alias("tail"))
    short = counts.filter(size < longest)
    parts = parts.join(short.select(F.col("gram").alias("head"), F.col("n").alias("head_n")), "head").join(short.select(F.col("gram").alias("tail"), F.col("n").alias("tail_n")), "tail")
    together = parts.groupBy("word", "n").agg(F.min(F.col("n") * F.lit(float(total)) / F.col("head_n") / F.col("tail_n")).alias("cohesion")).filter(F.col("cohesion") >= min_cohesion)
    grown = counts.filter(size >= 2).select("gram", "n", (F.col("n") * F.log("n")).alias("s"))

    def entropy(name: str, of: Column) -> DataFrame:
        return grown.groupBy(of.alias("word")).agg(F.sum("s").alias(name))

    right, left = entropy("right_s", F.substr("gram", F.lit(1), F.length("gram") - 1)), entropy("left_s", F.substr("gram", F.lit(2)))
    found = together.join(right, "word", "left").join(left, "word", "left")
    value = lambda c: F.log("n") - F.coalesce(c, F.lit(0.0)) / F.col("n")
    found = found.select("word", "n", "cohesion", value("left_s").alias("left_entropy"), value("right_s").alias("right_entropy"))
    return found.filter(F.least("left_entropy", "right_entropy") >= min_entropy)


def dictionary_of(words: DataFrame, singles: DataFrame | None = None, most: int = 500_000) -> Dictionary:
    """A dictionary from ``word, n`` and, from ``gram_counts``, single characters: the ``most`` frequent ones, which is its bound."""
    rows = words.select("word", "n")
    if singles is not None:
        rows = rows.unionByName(singles.filter(F.length("gram") == 1).select(F.col("gram").alias("word"), "n"))
    return Dictionary({r["word"]: r["n"] for r in rows.orderBy(F.desc("n"), "word").limit(most).collect()})


def learn_dictionary(df: DataFrame, text_col: str, runs: str = HAN, longest: int = 4, most: int = 500_000, **limits) -> Dictionary:
    """The dictionary of a corpus: its words and single characters."""
    from convoframe.sources.scratch import materialised

    counts = materialised(gram_counts(df, text_col, runs, longest + 1), "grams", work=4)
    return dictionary_of(learn_words(counts, longest, **limits), counts, most)


def with_words(dictionary: Dictionary, more: Iterable[tuple[str, int]]) -> Dictionary:
    """A dictionary with words added or counted anew (a user's own words)."""
    return Dictionary({**dictionary.counts, **dict(more)})
