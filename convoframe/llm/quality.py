"""Document quality rules: repetition counts, and divergence from language references.

All features of a document come from its own row by array functions, so the
corpus is read once and nothing but the references' sums is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import SCANNED, SEPARATOR_CLASS, let, write_table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Divergence is judged only from these sizes on; shorter texts scatter too much.
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = 30
#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a document fails: a level, and what a sample of its size may
#: scatter, over the root of its characters or words.  Chosen on a third of the labelled documents.
MAX_CLASS_DISTANCE, CLASS_SCATTER = 0.10, 3.0
MAX_WORD_DISTANCE, WORD_SCATTER = 0.17, 1.1

#: Frequent function words by language.
COMMON_WORDS = {
    "en": tuple("the of and to in is that was for with as it on be at by this had not are but from or have an they which one you were all her she there would their we him been has".split()),
    "fr": tuple("de la le les et des en un du que une est pour dans il qui par pas au sur ne se plus ce sont avec son aux elle mais ou cette nous leur être fait comme tout ont été".split()),
    "de": tuple("der die und zu den das von mit ist des im für auf dem sich ein nicht eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so".split()),
    "es": tuple("de la que el en y los del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también".split()),
}
#: The reference for other and null languages: character classes of all; their words are not judged.
POOLED = "*"
_WIDTH = 40


def _repeated_words(words: Column) -> Column:
    """Words in ``WINDOW``-word windows found twice or more, from the windows' sorted (hash, place) pairs."""
    n = F.size(words)
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), F.greatest(F.lit(0), n - F.lit(WINDOW)))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(*[words[i + F.lit(k)] for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda acc, x: acc + x
        )

    def repeated_at(pairs: Column) -> Column:
        def twice(p: Column, k: Column) -> Column:
            return F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(pairs, twice), lambda p: p["i"]))

    def counted(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(let(pairs, repeated_at), covered))

    return let(hashes, counted).cast("long")


def _classes(text: Column, words_chars: Column) -> Column:
    """Code points by class: lower, upper, digit, separator, other ASCII, the rest."""
    lower, upper, digit = (F.regexp_count(text, F.lit(p)).cast("double") for p in ("[a-z]", "[A-Z]", "[0-9]"))
    wide = F.regexp_count(text, F.lit(r"[^\x00-\x7F]")).cast("double")
    blank = (F.length(text) - words_chars).cast("double")
    other = F.greatest(F.lit(0.0), F.length(text) - lower - upper - digit - wide - blank)
    return F.array(lower, upper, digit, blank, other, wide)


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms; null where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (half(p) + half(q)) / 2

    shares = lambda a: let(F.nullif(total(a), F.lit(0.0)), lambda n: F.transform(a, lambda x: x / n))
    divergence = total(F.zip_with(shares(counts), shares(reference), term))
    return let(divergence, lambda d: F.when(d.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)))))


def features(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a record: the counts of the base rules and the two histograms (null text: empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = records.select(
        F.col(id_col).alias(id_col),
        F.when(F.col(lang_col).isin(list(COMMON_WORDS)), F.col(lang_col)).otherwise(F.lit(POOLED)).alias("_lang"),
        text.alias("_text"),
        F.filter(F.split(text, SEPARATOR_CLASS + "+"), lambda w: w != "").alias("_words"),
    )
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    own = F.create_map(*[x for lang, ws in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, ws)))])
    # The common words two blanks apart, so that each is a stretch of its own with a blank at either end.
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    spaced = F.lower(F.concat(F.lit(" "), F.array_join(F.filter("_words", lambda w: F.lower(w).isin(every)), "  "), F.lit(" ")))

    def histogram(args: Column) -> Column:
        size = F.octet_length(args["text"])
        count = lambda w: ((size - F.octet_length(F.replace(args["text"], F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + F.lit(2))).cast("double")
        counts = F.transform(args["words"], count)
        return F.concat(counts, F.array(F.greatest(F.lit(0.0), F.size("_words") - F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x))))

    common = F.when(F.col("_lang") != POOLED, let(F.struct(spaced.alias("text"), F.try_element_at(own, F.col("_lang")).alias("words")), histogram))
    chars = F.length(F.regexp_replace(F.col("_text"), SEPARATOR_CLASS, ""))
    return rows.select(
        id_col,
        "_lang",
        F.size("_words").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        F.regexp_count(F.col("_text"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.length("_text").alias("_chars"),
        _classes(F.col("_text"), chars).alias("_classes"),
        common.alias("_common"),
    )


def judge_quality(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, divergences and verdicts for every record.

    The references are the summed histograms of a language's records that pass the
    base rules, and a record is held against that sum without its own part.  A
    language outside ``COMMON_WORDS`` or null is held against the character classes
    of all; its words are not judged, nor is a record without others to compare it
    with.  Texts under the minimum lengths are not judged by divergence; very long
    ones are read whole.  Null and empty texts have no words and fail the base
    rule.  Repeated rows are judged alike; an empty table gives an empty result;
    further columns, of any name, are ignored.
    """
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rows = write_table(features(records, id_col, text_col, lang_col).withColumn("base_failed", base_failed), "quality-features", files_per_core=SCANNED)
    sums = [F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(6)] + [F.sum(F.col("_common")[i]).alias(f"w{i}") for i in range(_WIDTH + 1)]
    by_lang = rows.filter(~F.col("base_failed")).groupBy("_lang").agg(*sums)  # a row for each language of COMMON_WORDS, and one
    pooled = by_lang.agg(*[F.sum(c).alias(c) for c in by_lang.columns[1:]]).select(F.lit(POOLED).alias("_lang"), "*")
    references = by_lang.filter(F.col("_lang") != POOLED).unionByName(pooled).select(
        "_lang", F.array(*[F.col(f"c{i}") for i in range(6)]).alias("_rc"), F.array(*[F.col(f"w{i}") for i in range(_WIDTH + 1)]).alias("_rw")
    )
    judged = rows.join(F.broadcast(references), "_lang", "left")
    others = lambda all_, own: F.when(F.col("base_failed"), F.col(all_)).otherwise(F.zip_with(all_, own, lambda a, b: F.greatest(F.lit(0.0), a - b)))
    judged = judged.withColumn("class_distance", F.when(~F.col("base_failed") & (F.col("_chars") >= MIN_CLASS_CHARS), js_distance(F.col("_classes"), others("_rc", "_classes"))))
    judged = judged.withColumn("word_distance", F.when(~F.col("base_failed") & (F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("_lang") != POOLED), js_distance(F.col("_common"), others("_rw", "_common"))))
    limit = lambda level, scatter, n: F.lit(level) + F.lit(scatter) / F.sqrt(F.greatest(F.col(n), F.lit(1)).cast("double"))
    diverges = F.coalesce(F.col("class_distance") > limit(MAX_CLASS_DISTANCE, CLASS_SCATTER, "_chars"), F.lit(False)) | F.coalesce(F.col("word_distance") > limit(MAX_WORD_DISTANCE, WORD_SCATTER, "n_words"), F.lit(False))
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~diverges).alias("kept"), "class_distance", "word_distance"
    )
