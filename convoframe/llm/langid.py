"""Language identification with error-correcting output codes.

Each language has a codeword; binary logistic classifiers over hashed character
n-grams predict its bits, and loss-weighted decoding takes the nearest codeword.
With few languages the code is exhaustive (every split of the languages is a
bit), so several wrong bits are corrected.  The classifiers are fitted from a
bounded sample of labelled rows; every text is predicted whole.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import arrow_batches, lean

UNKNOWN = "und"
BUCKETS = 4096
#: Bound of the training sample: rows in all, and rows of each language.
SAMPLE_ROWS = 2000
SAMPLE_ROWS_PER_LANGUAGE = 400
MAX_BITS = 63
STEPS = 150
#: Code points handled at a time.
PIECE = 1 << 19
#: A document is ambiguous if the two nearest codewords' losses differ by less than this share of the code.
AMBIGUOUS_MARGIN = 0.02
SHARPNESS = 4.0


def _slot(gram: int) -> int:
    return (((gram ^ (gram >> 16)) * 0x27D4EB2F) & 0xFFFFFFFF) >> 20


_BLANK = _slot((32 * 0x9E3779B1) & 0xFFFFFFFF)


@functools.cache
def _letters() -> np.ndarray:
    """A mark for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_features(text: str) -> np.ndarray | None:
    """L2-normalised square roots of the counts of hashed 1- to 3-grams of letters; None without a letter."""
    counts, letters = np.zeros(BUCKETS, dtype=np.int64), 0
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[max(0, at - 2) : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mark = _letters()[points]
        letters += int(mark.sum())
        points = np.where(mark, points, np.uint32(32))
        one = points * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
        skip = min(2, at)
        for grams in (one[skip:], two[max(0, skip - 1) :], three):
            if len(grams):
                counts += np.bincount((grams ^ (grams >> np.uint32(16))) * np.uint32(0x27D4EB2F) >> np.uint32(20), minlength=BUCKETS)
    if not letters:
        return None
    counts[_BLANK] = 0  # runs of separators say nothing about a language
    x = np.sqrt(counts.astype(np.float32))
    return x / max(1e-9, float(np.sqrt((x * x).sum())))


def codewords(n: int) -> np.ndarray:
    """n codewords of +1/-1: the exhaustive code where it is short, else the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.float32)
    if 2 ** (n - 1) - 1 <= MAX_BITS:
        bits = [[1 if i == 0 else 1 - 2 * (k >> (i - 1) & 1) for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(bits, dtype=np.float32).T
    best, most = None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((n, MAX_BITS)) < 0.5, 1, -1).astype(np.float32)
        apart = (code @ code.T - 2 * MAX_BITS * np.eye(n)).max() if n > 1 else 0
        distance = (MAX_BITS - apart) / 2
        if distance > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, distance
    return best


class Model:
    """Languages, their codewords, the bit classifiers and the bits' weights."""

    def __init__(self, features: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        self.code = codewords(len(self.languages))
        place = {x: i for i, x in enumerate(self.languages)}
        rows = np.array([place[x] for x in labels], dtype=np.int64)
        self.weights, self.bias = self._fit(features, self.code[rows]) if len(self.languages) > 1 else (np.zeros((BUCKETS, 1), np.float32), np.ones(1, np.float32))
        right = ((features @ self.weights + self.bias) * self.code[rows] > 0).mean(axis=0) if len(rows) else np.ones(1)
        self.bit_weights = np.maximum(1e-3, 2 * right - 1).astype(np.float32)
        self.bit_weights /= self.bit_weights.sum()

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bits' logistic regressions at once, by Adam over the full sample; bits are balanced by class."""
        n, bits = y.shape
        share = np.where(y > 0, 1.0 / np.maximum(1, (y > 0).sum(axis=0)), 1.0 / np.maximum(1, (y < 0).sum(axis=0))).astype(np.float32) / 2
        w = np.zeros((x.shape[1] + 1, bits), dtype=np.float32)  # the bias last
        m, v, grad = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            pull = -y * share / (1 + np.exp(np.clip(y * (x @ w[:-1] + w[-1]), -30, 30)))
            grad[:-1], grad[-1] = x.T @ pull + 1e-5 * w[:-1], pull.sum(axis=0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return w[:-1].copy(), w[-1].copy()

    def predict(self, x: np.ndarray) -> tuple[str, float, bool]:
        """(language, score, ambiguous) by loss-weighted decoding with the logistic loss."""
        f = np.clip(x @ self.weights + self.bias, -8, 8)
        losses = np.log1p(np.exp(-self.code * f)) @ self.bit_weights
        order = np.argsort(losses, kind="stable")
        near = np.exp(-SHARPNESS * (losses - losses[order[0]]))
        margin = losses[order[1]] - losses[order[0]] if len(order) > 1 else np.inf
        return self.languages[order[0]], float(1 / near.sum()), bool(margin < AMBIGUOUS_MARGIN)


def train(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, per_language: int = SAMPLE_ROWS_PER_LANGUAGE) -> Model | None:
    """Fits a model from labelled rows: of each language the ``per_language`` (``rows`` in all) least by a hash of id and text.

    Only non-null labels and texts with a letter count; None if there are none, as for an
    empty table.  Long texts are read whole; rows that repeat are in the sample together, up
    to its size; further columns, of any name, are ignored.
    The sample is bounded, so its features (``BUCKETS`` half-precision numbers a row) fit the driver.
    """
    arrow_batches(records.sparkSession)
    labelled = records.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("_lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).cast("string").alias("_text")
    )
    counts = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(rows).collect()}
    if not counts:
        return None
    each = max(1, min(per_language, rows // len(counts)))
    # A hash threshold leaves about twice as many rows as wanted, so that few texts are ranked.
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2.0 * each + 50) / n))])
    near = labelled.filter(F.shiftrightunsigned("_key", 11) / F.lit(float(1 << 53)) < F.try_element_at(shares, F.col("_lang")))

    def featured(batches):
        import pyarrow as pa

        for batch in batches:
            found = [ngram_features(x) for x in batch.column(2).to_pylist()]
            data = [x.astype(np.float16).tobytes() if x is not None else None for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, type=pa.binary())], names=["_lang", "_key", "_x"])

    got = near.mapInArrow(lean(featured), "_lang string, _key long, _x binary").filter(F.col("_x").isNotNull()).collect()
    taken, seen = [], {}
    for r in sorted(got, key=lambda r: (r["_lang"], r["_key"])):
        seen[r["_lang"]] = seen.get(r["_lang"], 0) + 1
        if seen[r["_lang"]] <= each:
            taken.append(r)
    if not taken:
        return None
    features = np.empty((len(taken), BUCKETS), dtype=np.float32)
    for i, r in enumerate(taken):
        features[i] = np.frombuffer(r["_x"], dtype=np.float16)
    labels = [r["_lang"] for r in taken]
    del got, taken
    return Model(features, labels)


def identify(records: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, ambiguous`` for every record, from its whole text.

    Null texts, and texts without a letter, are ``und`` with score 0; so is every
    text if there is no model.  Very long texts are read whole; null ids are passed
    through.  Repeated rows get the same prediction; an empty
    table gives an empty result; further columns are ignored.
    """
    arrow_batches(records.sparkSession)
    id_type = records.schema[id_col].dataType.simpleString()

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                x = ngram_features(text) if text and model else None
                out.append((UNKNOWN, 0.0, True) if x is None else model.predict(x))
            langs, scores, flags = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], names=[id_col, "lang_pred", "score", "ambiguous"])

    return records.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(predict), f"`{id_col}` {id_type}, lang_pred string, score double, ambiguous boolean")


def keep_identified(records: DataFrame, model: Model | None, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The records whose language is found: not ``und``, and not ambiguous with a score under ``min_score``.

    Null, empty and letterless texts go; very long ones are read whole; repeated rows
    fare alike; all columns, of any name, stay; an empty table stays empty.
    """
    arrow_batches(records.sparkSession)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            marks = []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                x = ngram_features(text) if text and model else None
                _, score, ambiguous = (UNKNOWN, 0.0, True) if x is None else model.predict(x)
                marks.append(x is not None and not (ambiguous and score < min_score))
            yield batch.filter(pa.array(marks, pa.bool_()))

    return records.mapInArrow(lean(keep), records.schema)
