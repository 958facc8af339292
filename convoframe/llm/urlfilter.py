"""URL filter: allow and block rules, then logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled table (its rows are a
parameter) and enters the plan as one array of weights; scoring is built-in
functions only.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import let, lower_ascii

#: Hash buckets of a host's and of a path's n-grams.
HOST_BUCKETS, PATH_BUCKETS = 4096, 1024
SIZES = (3, 4)
#: Hosts decide; what a path says counts so much less.
PATH_WEIGHT = 0.3
EPOCHS = 1500
RATE = 10.0
PENALTY = 1e-4
#: The threshold is the least of 0.01, 0.02, ... that blocks at most this share of the allowed URLs held out from training.
FALSE_ALARMS = 0.02

#: (host, path prefix, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: The words the default table's URLs are made of: what tells blocked and allowed sites, and what both have.
BLOCKED_WORDS = (
    "casino", "poker", "betting", "bets", "slots", "jackpot", "lottery", "roulette", "adult", "porn", "xxx", "sex", "cams", "escort", "nude", "hentai",
    "viagra", "pills", "meds", "payday", "loans", "malware", "virus", "phishing", "trojan", "warez", "cracks", "keygen", "spam", "linkfarm", "clickbait", "popup",
    "ads", "adserver", "tracker", "tracking", "prizes", "freemoney",
)
ALLOWED_WORDS = (
    "roads", "threads", "uploads", "essex", "sussex", "cameras", "racetrack", "alphabets", "apple", "bridge", "candle", "doctor", "engine", "fabric", "glacier", "harbor", "island", "jacket", "kettle", "lantern",
    "mountain", "needle", "orchard", "planet", "quarter", "river", "saddle", "teacher", "umbrella", "village", "window", "yellow", "zebra", "autumn", "blossom", "copper", "dentist", "eagle", "flower", "granite", "horizon", "ivory",
    "justice", "kitchen", "lemon", "meadow", "northern", "ocean", "pepper", "quilt", "ribbon", "silver", "timber", "news", "weather", "library", "museum", "university", "school", "science", "history", "music", "cooking", "recipes", "garden", "travel", "maps", "health", "hospital",
    "council", "sports", "football", "cinema", "books", "reading", "gallery", "photos", "nature", "wildlife", "banking", "insurance", "market", "bakery", "hotel", "railway",
    "energy", "software", "docs", "project", "forum", "wiki",
)
NEUTRAL_WORDS = ("site", "online", "club", "hub", "world", "zone", "live", "home", "center", "best", "my", "free")
#: Of the words of either kind, each so many-th is kept from training: half of them set the threshold, half are for tests.
HELD_OUT = 5
#: Hosts of random syllables, allowed: an unknown name is no reason to block.
SYLLABLE_HOSTS = 400


def labelled_urls() -> list[tuple[str, str, int, str]]:
    """(host, path, 1 to block or 0, part): the table the default model is made from, by rule.

    Parts: ``train``; ``test`` (other hosts of the same words); ``tune`` and
    ``unseen`` (words not trained on, for the threshold and for tests).
    """
    rng = random.Random(11)
    tail = lambda: rng.choice(("example.org", "example.net", "org", "net", "info.org", "web.net"))
    start = lambda: rng.choice(("", "", "www.", "m.", "blog.", "shop."))
    path = lambda: rng.choice(("/", f"/{rng.randint(1, 9999)}", f"/{rng.choice(('en', 'de', 'fr', 'es', 'it', 'nl'))}/{rng.randint(1, 9999)}", f"/{rng.choice(('en', 'de', 'fr', 'es', 'it', 'nl'))}/", f"/{rng.choice('abcdefgh')}{rng.choice('aeiou')}/{rng.randint(1, 9999)}", f"/page{rng.randint(1, 99)}.html", f"/20{rng.randint(10, 26)}/{rng.randint(1, 12)}/"))
    rows = [("", "", 0, part) for part in ("train", "train", "train", "tune", "unseen")]
    for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, w in enumerate(words):
            held = ("tune", "unseen")[i // HELD_OUT % 2] if i % HELD_OUT == HELD_OUT - 1 else None
            for k in range(24):
                a, b = rng.choice(NEUTRAL_WORDS), rng.choice(NEUTRAL_WORDS)
                host = start() + rng.choice((w, f"{w}-{a}", f"{a}-{w}", f"{w}{a}", f"{a}{w}", f"{a}-{w}-{b}")) + "." + tail()
                part = held or ("train" if k < 20 else "test")
                rows += [(host, path(), label, part) for _ in range(1 if part == "train" else 3)]
    syllable = lambda: rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "s", "t", "th", "ng", "on"))
    for i in range(SYLLABLE_HOSTS):
        part = ("train", "train", "train", "tune", "unseen")[i % 5]
        name = "".join(syllable() for _ in range(rng.randint(2, 4)))
        rows += [(start() + name + "." + tail(), path(), 0, part) for _ in range(1 if part == "train" else 3)]
    return rows


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls; a rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _grams(text: str, sizes) -> list[str]:
    return [text[i : i + n] for n in sizes for i in range(len(text) - n + 1)]


def _features(host: str, path: str, sizes=SIZES) -> dict[int, float]:
    """Counts of hashed n-grams, those of the host and those of the path each over the root of their number."""
    out: dict[int, float] = {}
    for text, first, buckets, weight in ((f"^{host}|", 0, HOST_BUCKETS, 1.0), (f"{path}$", HOST_BUCKETS, PATH_BUCKETS, PATH_WEIGHT)):
        grams = _grams(text, sizes)
        for g in grams:
            k = first + zlib.crc32(g.encode()) % buckets
            out[k] = out.get(k, 0.0) + weight / len(grams) ** 0.5
    return out


def fit(rows: list[tuple[str, str, int]], sizes=SIZES) -> tuple[list[float], float]:
    """Weights and bias by full-batch gradient descent with an L2 penalty, both labels weighing the same; deterministic."""
    import numpy as np

    x, y = np.zeros((len(rows), HOST_BUCKETS + PATH_BUCKETS), dtype=np.float32), np.array([r[2] for r in rows], dtype=np.float32)
    for i, (host, path, _) in enumerate(rows):
        for k, v in _features(host, path, sizes).items():
            x[i, k] = v
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    w, bias = np.zeros(x.shape[1], dtype=np.float32), np.float32(0)
    for _ in range(EPOCHS):
        error = (1 / (1 + np.exp(-(x @ w + bias))) - y) * share
        w -= RATE * (x.T @ error + PENALTY * w)
        bias -= RATE * error.sum()
    return w.tolist(), float(bias)


def probability(host: str, path: str, model: tuple[list[float], float]) -> float:
    """The model's probability for one URL, in Python (for the table's rows and tests)."""
    import math

    return 1 / (1 + math.exp(-(model[1] + sum(model[0][k] * v for k, v in _features(host, path).items()))))


@lru_cache(maxsize=1)
def train() -> tuple[tuple[list[float], float], float]:
    """The default model and its threshold, from ``labelled_urls``."""
    rows = labelled_urls()
    model = fit([r[:3] for r in rows if r[3] == "train"])
    allowed = [probability(r[0], r[1], model) for r in rows if r[3] == "tune" and not r[2]]
    fits = (t / 100 for t in range(1, 100) if sum(p >= t / 100 for p in allowed) <= FALSE_ALARMS * len(allowed))
    return model, next(fits, 1.0)


def block_probability(host: Column, path: Column, model: tuple[list[float], float], sizes=SIZES) -> Column:
    """The model's probability that a URL is to be blocked; n-grams by code points, hashed with CRC-32."""
    weights, bias = model

    def part(text: Column, first: int, buckets: int) -> Column:
        table = F.array(*[F.lit(x) for x in weights[first : first + buckets]])

        def scored(t: Column, n: int) -> tuple[Column, Column]:
            at = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - F.lit(n - 1)))).otherwise(F.array().cast("array<int>"))
            weight = lambda i: F.element_at(table, (F.pmod(F.crc32(F.substring(t, i, F.lit(n))), F.lit(buckets)) + 1).cast("int"))
            return F.aggregate(at, F.lit(0.0), lambda acc, i: acc + weight(i)), F.size(at)

        def whole(t: Column) -> Column:
            found = [scored(t, n) for n in sizes]
            return sum((f[0] for f in found), F.lit(0.0)) / F.sqrt(F.greatest(sum((f[1] for f in found), F.lit(0)), F.lit(1)).cast("double"))

        return let(text, whole)

    z = F.lit(bias) + part(F.concat(F.lit("^"), host, F.lit("|")), 0, HOST_BUCKETS) + F.lit(PATH_WEIGHT) * part(F.concat(path, F.lit("$")), HOST_BUCKETS, PATH_BUCKETS)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model=None, threshold: float | None = None) -> DataFrame:
    """``id_col, host, path, rule, verdict, score``: rules first, then the model.

    Without ``model`` the default one judges, at its own threshold.  Null or
    malformed URLs have empty host and path, no rule, and the model's verdict on
    the empty URL (allowed); very long URLs are read whole.  One row out for each
    row in; further columns, of any name, are ignored.  Nothing is shuffled.
    """
    default, limit = train()
    model, threshold = model or default, limit if threshold is None else threshold
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    rule, says = match_rule(F.col("host"), F.col("path"), rules)
    score = block_probability(F.col("host"), F.col("path"), model)
    judged = parts.withColumn("rule", rule).withColumn("_says", says).withColumn("score", score)
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(id_col, "host", "path", "rule", F.coalesce("_says", by_model).alias("verdict"), "score")
