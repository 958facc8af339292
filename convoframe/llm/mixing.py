"""Mixing sources to target weights by entropy balancing.

Among all document rates that meet the constraints, entropy balancing takes those
nearest (in Kullback-Leibler divergence, by tokens) to one copy of everything:

* each source's tokens meet its target,
* the mix keeps the corpus's balance of lengths: its mean length class (binary
  logarithm of a document's words), weighted by tokens, is that of the corpus,
* no rate exceeds the cap.

The rates are exponentially tilted, ``min(cap, exp(m + tilt * length class))`` with a
multiplier ``m`` for each source and one ``tilt`` for all.  For a given tilt each
source's multiplier is found exactly; Newton iterations solve the convex dual that
is left.  Documents enter it through their tokens by source and length class: they
are read once and reduced before anything is shuffled, and every iteration is one
distributed aggregation over the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoframe.llm.common import SCANNED, WORD, cut_into, let, write_table

NEWTON_STEPS = 200
#: How far the first step in search of the tilt's bounds goes; further ones go twice as far.
FIRST_TILT = 3.0
#: There neighbouring classes' rates differ 10^9-fold: more tilt changes nothing, and all classes together still fit a double.
LAST_TILT = 22.0
#: Length classes: documents of 2^k to 2^(k+1) - 1 words; longer ones are in the last.
CLASSES = 32
#: Documents a running sum handles in one piece, and the most pieces made of the hash's range.
PIECE_ROWS = 20_000
MAX_PIECES = 1 << 20


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``_rank``: the source's place in code-point order, null last.  Sources are sorted by ranges, not in one task."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.col("_source").isNull()
    placed = sources.repartitionByRange(parts, last, F.col("_source")).sortWithinPartitions(last, "_source").withColumn("_at", F.monotonically_increasing_id())
    placed = write_table(placed, "mix-sources").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_first")


def source_targets(sources: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to one row a source (``_source``, ``source_size``).

    Sources in code-point order (null last) take ``weights`` in turn and share
    ``share`` of all tokens; a target stops at ``cap`` times its source and the
    excess goes to the others by weight.  The common level is filled step by step:
    what is capped at one level raises the next, until nothing more is.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = _ranked(sources).withColumn("_w", F.element_at(cycle, (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    rows = write_table(rows.drop("_rank"), "mix-weights")
    total, width = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    budget, level, capped = float(total) * share, float(total) * share / width if width else 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        n, held, left = rows.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0))).first()
        if n == capped or not left:
            break
        capped, level = n, (budget - held) / left
    return rows.withColumn("target", F.least(F.col("_cap"), F.lit(level) * F.col("_w"))).drop("_w", "_cap")


def _total(cells: Column, f) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + f(c))


def _source_factor(cells: Column, target: Column, cap: float) -> Column:
    """``exp(m)`` of one source: with it, its classes' tokens ``n`` times ``min(cap, factor * e)`` meet the target.

    Classes found over the cap stay there, and the rest of the target goes to the
    others; so the factor only rises, and settles after at most as many steps as
    there are classes.
    """

    def step(k: Column, _) -> Column:
        left = target - _total(cells, lambda c: F.when(k * c["e"] >= cap, c["n"] * F.lit(cap)).otherwise(0.0))
        open_ = _total(cells, lambda c: F.when(k * c["e"] < cap, c["n"] * c["e"]).otherwise(0.0))
        return F.when(open_ > 0, left / open_).otherwise(k)

    first = target / F.nullif(_total(cells, lambda c: c["n"] * c["e"]), F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(CLASSES)), first, step)


def _tilted(rows: DataFrame, tilt: float, middle: float, cap: float) -> DataFrame:
    """Adds to sources with ``_cells`` (length class ``c``, tokens ``n``) their rates at a tilt: ``_rates`` (``c, n, z, r``)."""
    # Against the class with the largest rate, which only changes the source's multiplier, so nothing overflows.
    top = F.array_max(F.transform("_cells", lambda c: F.lit(tilt) * c["c"]))
    e = lambda c: F.struct(c["c"].alias("c"), c["n"].alias("n"), (c["c"] - F.lit(middle)).alias("z"), F.exp(F.lit(tilt) * c["c"] - top).alias("e"))

    def rates(cells: Column) -> Column:
        full = F.col("target") >= F.col("source_size") * F.lit(cap)
        rate = lambda k: F.transform(cells, lambda c: F.struct(c["c"], c["n"], c["z"], F.when(full, F.lit(cap)).otherwise(F.least(F.lit(cap), F.coalesce(k * c["e"], F.lit(0.0)))).alias("r")))
        return let(_source_factor(cells, F.col("target"), cap), rate)

    return rows.withColumn("_rates", let(F.transform("_cells", e), rates))


def balancing_tilt(rows: DataFrame, middle: float, cap: float) -> tuple[float, float]:
    """The dual's solution, and what it leaves of the length balance: the mix's mean length class less the corpus's.

    Newton on the length balance, whose gradient and Hessian each step sums over all
    sources.  The gradient rises with the tilt, so bounds follow the solution, and are
    doubled where it lies beyond them.  A balance that no tilt meets (targets and cap may
    not allow it) is met as far as possible, and the rest is returned.  An error is raised
    where the steps don't settle.
    """
    tilt, low, high = 0.0, None, None  # tilts known to be too low, too high
    for _ in range(NEWTON_STEPS):
        open_ = F.filter("_rates", lambda c: c["r"] < cap)
        weight = _total(open_, lambda c: c["n"] * c["r"])
        first, second = _total(open_, lambda c: c["n"] * c["r"] * c["z"]), _total(open_, lambda c: c["n"] * c["r"] * c["z"] * c["z"])
        bend = F.when(weight > 0, second - first * first / weight).otherwise(0.0)
        taken = _total(F.col("_rates"), lambda c: c["n"] * c["r"])
        sums = _tilted(rows, tilt, middle, cap).agg(F.sum(_total(F.col("_rates"), lambda c: c["n"] * c["r"] * c["z"])), F.sum(bend), F.sum("target"), F.sum(taken)).first()
        gradient, hessian, tokens, mixed = (float(x or 0.0) for x in sums)
        gap = gradient / mixed if mixed else 0.0
        if abs(gradient) <= 1e-10 * tokens or not tokens or abs(tilt) >= LAST_TILT:
            return tilt, gap
        low, high = (tilt, high) if gradient < 0 else (low, tilt)
        to = tilt - gradient / hessian if hessian > 1e-12 * tokens else None
        if low is not None and high is not None:
            if high - low < 1e-12:
                return tilt, gap
            to = to if to is not None and low < to < high else (low + high) / 2
        else:  # go on in one direction, not too far at once
            up = 1 if low is not None else -1
            far = up * min(LAST_TILT, max(FIRST_TILT, 2 * abs(tilt)))
            to = to if to is not None and 0 < (to - tilt) * up < (far - tilt) * up else far
        tilt = to
    raise RuntimeError(f"the length balance did not settle in {NEWTON_STEPS} steps: {gap} left")


def mix_to_targets(
    records: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document a mix takes so that each source meets its target.

    Returns ``id_col, size, source_size, target, rate, copies, taken, length_gap``: the
    tilted rate, the whole copies it was rounded to, the words taken, and, alike in all
    rows, what is left of the length balance (0 where targets and cap allow it).  Rates are
    rounded class by class of each source in an order by hash: every document gets
    the rate's whole part, and one more copy goes to documents in turn until the
    class's words are used up; the last of them gives its first words only.  The
    classes' words add up to the source's target, rounded down.  No document
    exceeds ``cap`` times its words.

    Null source: a source of its own, last.  Null text: no words, nothing taken.
    Very long texts are counted whole.  Repeated rows are documents of their own.
    Empty table: empty result.  Further columns, of any name, are ignored.  The
    order depends on ids and texts alone, so reruns agree.
    """
    cap = float(cap)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = write_table(
        records.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).cast("string").alias("_source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.col(id_col), text).alias("_key"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "mix-slim",
        files_per_core=SCANNED,
    )
    n_pieces = max(64, min(MAX_PIECES, slim.count() // PIECE_ROWS))
    of_cap = F.floor(F.col("size") * F.lit(cap - int(cap))).cast("long")  # what the cap allows beyond whole copies
    slim = slim.withColumn("_class", F.least(F.lit(CLASSES - 1), F.length(F.bin("size")) - 1)).withColumn("_piece", cut_into(F.col("_key"), n_pieces).cast("int")).withColumn("_odd", of_cap)
    pieces = write_table(slim.groupBy("_source", "_class", "_piece").agg(F.sum("size").alias("_size"), F.sum("_odd").alias("_odd")), "mix-pieces")
    cells = pieces.groupBy("_source", "_class").agg(F.sum("_size").alias("n"))
    sources = cells.groupBy("_source").agg(
        F.sum("n").alias("source_size"),
        F.array_sort(F.collect_list(F.struct(F.col("_class").cast("double").alias("c"), F.col("n").cast("double").alias("n")))).alias("_cells"),  # at most ``CLASSES``
    )
    rows = write_table(source_targets(sources, list(weights), share, cap), "mix-targets")
    middle = cells.agg(F.sum(F.col("n") * F.col("_class")) / F.nullif(F.sum("n"), F.lit(0))).first()[0] or 0.0
    tilt, gap = balancing_tilt(rows, middle, cap)
    rows = _tilted(rows, tilt, middle, cap)

    # The words each class takes: the target's running sum, rounded down at each class's end.
    whole = F.transform("_rates", lambda c, i: F.struct(c["c"].cast("int").alias("_class"), c["r"].alias("rate"), c["n"].alias("n"), _total(F.slice("_rates", F.lit(1), i + 1), lambda x: x["n"] * x["r"]).alias("_upto"), _total(F.slice("_rates", F.lit(1), i), lambda x: x["n"] * x["r"]).alias("_from")))
    plan = rows.select("_source", "source_size", "target", F.inline(whole))
    down = lambda c: F.floor(F.col(c) + F.lit(1e-6))
    plan = plan.withColumn("_base", F.floor(F.col("rate") + F.lit(1e-9))).withColumn("_extra", F.greatest(F.lit(0), down("_upto") - down("_from") - F.col("_base") * F.col("n")).cast("long"))
    plan = plan.select(F.col("_source").alias("_s"), F.col("_class").alias("_c"), "source_size", "target", "rate", "_base", "_extra")

    upto = Window.partitionBy("_source", "_class").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # over the pieces' sums
    run = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    pieces = pieces.select("_source", "_class", "_piece", run("_size").alias("_before"), run("_odd").alias("_odd_before"))
    plan = pieces.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c"))).select(F.col("_source").alias("_s"), F.col("_class").alias("_c"), F.col("_piece").alias("_p"), "_before", "_odd_before", "source_size", "target", "rate", "_base", "_extra")
    inside = Window.partitionBy("_source", "_class", "_piece").orderBy("_key", "_id", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = slim.withColumn("_in", F.sum("size").over(inside) - F.col("size")).withColumn("_odd_in", F.sum("_odd").over(inside) - F.col("_odd"))
    docs = docs.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_piece") == F.col("_p")))
    pick = lambda a, b: F.when(F.col("_base") < F.lit(int(cap)), a).otherwise(b)
    room, before = pick(F.col("size"), F.col("_odd")), pick(F.col("_before") + F.col("_in"), F.col("_odd_before") + F.col("_odd_in"))
    more = F.greatest(F.lit(0), F.least(room, F.col("_extra") - before))
    return docs.select(
        F.col("_id").alias(id_col),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        "rate",
        (F.col("_base") + F.when((more == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).cast("long").alias("copies"),
        (F.col("_base") * F.col("size") + more).cast("long").alias("taken"),
        F.lit(gap).alias("length_gap"),
    )
