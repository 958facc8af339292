"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components.

SuperMinHash draws, for every element, a random permutation of the signature's
places and ranks along it; place ``p`` keeps the least ``step + fraction`` over
all elements.  The ranks of an element are correlated (no two share a step),
which lowers the variance, and drawing stops at the first step that can improve
no place.

Bands of the signatures put documents into buckets.  In place of all pairs of a
bucket, each member is compared with the bucket's leader (the member that most
others meet), on full shingle sets.  Members of a leader's group that are still
apart may be near each other, and not to the leader (pages of one template, say).
They meet again by their differences to the leader, the shingles that only one of
the two has: two members differ from each other where one's difference lacks what
the other's has, so similar members far from the leader must share a part of their
differences, and that part follows from their sizes.  Sorted from the rarest
in the group, two lists that share ``k`` elements meet in the first ``size - k + 1``
of each.  What a template's pages have in common is in no difference, and what is a
page's own comes first in its list and meets nobody.  Where many members meet, they
are compared with one of them first, and then only pairs of different components.
So every pair that meets in a bucket is either in one component already or has been
compared.  Only pairs that meet again by what their differences share are listed.

Equal sets are one: by 128 bits of hash, and their size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe.llm.common import HEAVY, arrow_batches, arrow_texts, lean, write_table
from convoframe.llm.components import components

#: At similarity 0.8 exactly, a pair misses all bands with a chance of 3e-7; above that, less.
BANDS, ROWS = 38, 5
PLACES = BANDS * ROWS
#: Elements drawn at a time.
DRAW = 8192
#: Members of a leader's group that one salt takes.
SALT_ROWS = 128
#: Up to so many ids (16 bytes each) are sent to the scan of the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_FRACTION = np.uint64((1 << 56) - 1)
_NONE = np.uint64((1 << 64) - 1)


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of sets of 64-bit elements: one row a set, ``step << 56 | fraction``; empty sets keep the maximum."""
    from convoframe.llm.wordhash import mix64

    out = np.full((len(sets), PLACES), _NONE, dtype=np.uint64)
    order = np.argsort([len(s) for s in sets], kind="stable")
    group: list[int] = []
    total = 0
    groups = []
    for i in order:
        n = len(sets[i])
        if n == 0:
            continue
        if group and total + n > DRAW:
            groups.append(group)
            group, total = [], 0
        group.append(int(i))
        total += n
    if group:
        groups.append(group)
    for group in groups:
        h = out[group].reshape(-1)
        elements = np.concatenate([sets[i] for i in group])
        owner = np.repeat(np.arange(len(group)), [len(sets[i]) for i in group])
        for at in range(0, len(elements), DRAW):
            _draw(h, mix64(elements[at : at + DRAW] ^ np.uint64(0xA0761D6478BD642F)), owner[at : at + DRAW], mix64)
        out[group] = h.reshape(len(group), PLACES)
    return out


def _draw(h: np.ndarray, e: np.ndarray, owner: np.ndarray, mix64) -> None:
    n = len(e)
    places = np.tile(np.arange(PLACES, dtype=np.uint8), (n, 1))
    rows, base = np.arange(n), owner * PLACES
    alive = np.arange(n)
    for step in range(PLACES):
        drawn = mix64(e[alive] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        other = step + ((drawn >> np.uint64(32)) * np.uint64(PLACES - step) >> np.uint64(32)).astype(np.int64)
        mine = rows[alive]
        slot = places[mine, other]
        places[mine, other] = places[mine, step]
        value = (mix64(drawn) & _FRACTION) | np.uint64(step << 56)
        np.minimum.at(h, base[alive] + slot, value)
        # A set is finished once all its places hold a value of this step or before.
        worst = h.reshape(-1, PLACES).max(axis=1) >> np.uint64(56)
        open_sets = worst > np.uint64(step)
        if not open_sets.any():
            return
        alive = alive[open_sets[owner[alive]]]
        if not len(alive):
            return


def band_keys(signatures: np.ndarray) -> np.ndarray:
    from convoframe.llm.wordhash import mix64

    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, r])
    return keys


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes a set, from sums over its elements and its size (empty set: that of size 0)."""
    from convoframe.llm.wordhash import mix64

    n = np.array([len(s) for s in sets], dtype=np.uint64)
    one = np.array([mix64(s).sum() for s in sets], dtype=np.uint64)
    two = np.array([mix64(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum() for s in sets], dtype=np.uint64)
    return mix64(one + n), mix64(two ^ mix64(n))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signature_table(records: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``_id, _n, _set, _hash, _check, _bands``: set size, the set's two hashes (null: empty set; ``_set`` is the first), band keys."""
    arrow_batches(records.sparkSession)
    id_type = records.schema[id_col].dataType.simpleString()

    def sign(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        from convoframe.llm.wordhash import WordHasher, shingles

        hasher = WordHasher()
        for batch in batches:
            offsets, data = arrow_texts(batch.column(1))
            sets = [shingles(hasher.text(data[a:b]), width) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            hashes, checks = (pa.array(_signed(x), pa.int64()) for x in set_hashes(sets))
            empty = np.array([len(s) == 0 for s in sets], dtype=bool)
            keys = _signed(band_keys(super_minhash(sets))) if sets else np.zeros((0, BANDS), np.int64)
            flat = pa.array(keys.reshape(-1), pa.int64())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), flat)
            hashes = pa.compute.if_else(pa.array(empty), pa.scalar(None, pa.int64()), hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), hashes, hashes, checks, bands], names=["_id", "_n", "_set", "_hash", "_check", "_bands"])

    return records.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(sign), f"_id {id_type}, _n long, _set long, _hash long, _check long, _bands array<long>")


def _sized(small: DataFrame) -> DataFrame:
    """A table to be joined: broadcast if it is small, else left to a shuffled join, whose large keys Spark splits."""
    return F.broadcast(small) if small.count() <= BROADCAST_IDS else small


def _told_apart(signed: DataFrame) -> DataFrame:
    """Sets with equal first hashes but other second ones get numbers of their own."""
    found = signed.filter("_set is not null").groupBy("_set").agg(F.min("_check").alias("lo"), F.max("_check").alias("hi")).filter("lo <> hi")
    found = write_table(found.select(F.col("_set").alias("_met"), F.lit(True).alias("_twice")), "set-collisions")
    if found.isEmpty():
        return signed
    joined = signed.join(_sized(found), F.col("_set") == F.col("_met"), "left")
    return joined.withColumn("_set", F.when(F.col("_twice"), F.xxhash64("_set", "_check")).otherwise(F.col("_set"))).select(*signed.columns)


def _leader_pairs(signed: DataFrame) -> DataFrame:
    """(``leader``, ``x``, ``x_n``): the other members of each leader's buckets, by set."""
    rows = signed.filter("_set is not null").select(F.explode("_bands").alias("key"), F.col("_set").alias("x"), F.col("_n").alias("x_n"))
    shared = rows.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("met")).filter("lo <> hi").select("key", "met")
    members = write_table(rows.join(shared, "key").distinct(), "bucket-members", work=8)
    drawn = members.groupBy("x").agg(F.sum("met").alias("pull"))
    leaders = members.join(drawn, "x").groupBy("key").agg(F.max(F.struct("pull", "x")).alias("l")).select("key", F.col("l.x").alias("leader"))
    return members.join(leaders, "key").filter("x <> leader").select("leader", "x", "x_n").distinct()


def _texts_of_sets(records: DataFrame, signed: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(``_set``, ``_z``): the compressed text of one document of each wanted set."""
    chosen = signed.join(wanted, "_set", "left_semi").groupBy("_set").agg(F.min("_id").alias("_one"), F.first("_hash").alias("_hash"), F.first("_check").alias("_check"))
    chosen = _sized(write_table(chosen, "wanted-sets"))

    def shrink(batches):
        import pyarrow as pa
        import zstandard

        from convoframe.llm.wordhash import WordHasher, shingles

        hasher, pressed = WordHasher(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            offsets, data = arrow_texts(batch.column(3))
            marks, out = [], []
            for a, b, one, two in zip(offsets[:-1], offsets[1:], batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = shingles(hasher.text(data[a:b]), width)  # an id may have several texts
                marks.append(len(s) > 0 and [int(_signed(x)[0]) for x in set_hashes([s])] == [one, two])
                out.append(pressed.compress(data[a:b].tobytes()) if marks[-1] else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["_set", "_z"]).filter(pa.array(marks, pa.bool_()))

    typed = records.select(F.col(id_col).alias("_one"), F.col(text_col).cast("string").alias("_text"))
    found = typed.join(chosen, typed["_one"].eqNullSafe(chosen["_one"])).select("_set", "_hash", "_check", "_text").mapInArrow(lean(shrink), "_set long, _z binary")
    return write_table(found, "wanted-texts", files_per_core=HEAVY).dropDuplicates(["_set"])


def _compare(pairs: DataFrame, texts: DataFrame, width: int, differences: bool = False) -> DataFrame:
    """Adds to (``leader``, ``x``) the sizes and the shared count.

    With ``differences``, where a leader has several members, also the shingles
    that only one of the two has.  A leader's members are dealt by salt.
    """
    several = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").withColumn("salts", F.ceil(F.col("members") / SALT_ROWS).cast("int"))
    several = _sized(write_table(several, "leader-sizes"))
    salts = F.coalesce("salts", F.lit(1))
    heads = pairs.select("leader").distinct().join(several, "leader", "left").join(texts.select(F.col("_set").alias("leader"), "_z"), "leader")
    heads = heads.select("leader", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("x"), "_z", F.lit(False).alias("shown"))
    rest = pairs.join(several, "leader", "left").join(texts, F.col("x") == F.col("_set"))
    rest = rest.select("leader", F.pmod(F.xxhash64("x"), salts).cast("int").alias("salt"), "x", "_z", (F.col("members").isNotNull() & F.lit(differences)).alias("shown"))
    dealt = heads.union(rest).repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.asc_nulls_first("x"))

    def run(batches):
        import pyarrow as pa
        import zstandard

        from convoframe.llm.wordhash import WordHasher, shingles

        hasher, plain = WordHasher(), zstandard.ZstdDecompressor()
        leader, base = None, None
        kind = pa.list_(pa.int64())
        for batch in batches:
            rows = []
            for a, x, z, shown in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                s = shingles(hasher.text(np.frombuffer(plain.decompress(z), np.uint8)), width)
                if x is None:
                    leader, base = a, s
                    continue
                assert a == leader
                near = np.minimum(np.searchsorted(base, s), len(base) - 1)
                hit = base[near] == s
                apart = None
                if shown:
                    gone = np.ones(len(base), dtype=bool)
                    gone[near[hit]] = False
                    apart = _signed(np.concatenate([base[gone], s[~hit]]))
                rows.append((a, x, len(base), len(s), int(hit.sum()), apart))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)] + [pa.array([r[5] for r in rows], kind)], names=["leader", "x", "leader_n", "x_n", "shared", "apart"]
            )

    return dealt.mapInArrow(lean(run), "leader long, x long, leader_n long, x_n long, shared long, apart array<long>")


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.filter(F.col("shared") * (100 + percent) >= (F.col("leader_n") + F.col("x_n")) * percent).select(F.col("leader").alias("a"), F.col("x").alias("b"))


def _rooted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("v").alias("x"), F.col("root").alias("_r")), "x", "left").withColumn("root", F.coalesce("_r", "x")).drop("_r")


def _open_tokens(compared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(``leader, token, class, other, x, x_n``) of groups whose members are in several components: by what members meet.

    With ``d`` shingles in its difference and ``n`` in all, a member has the excess
    ``(100 + percent) * d - (100 - percent) * n``; two are similar if what their
    differences share is at least their excesses' sum over ``2 * (100 + percent)``.
    Excesses are cut into classes, and a member shows, for each class (``other``) that
    may hold members similar to it, as many of its rarest shingles as then must meet.
    """
    rows = _rooted(compared.filter("apart is not null").select("leader", "leader_n", "x", "x_n", "apart"), labels)
    groups = rows.groupBy("leader").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("leader")
    rows = write_table(rows.join(_sized(write_table(groups, "open-leaders")), "leader", "left_semi").drop("root"), "open-groups")
    met = F.count(F.lit(1)).over(Window.partitionBy("leader", "token"))
    each = rows.select("leader", "leader_n", "x", "x_n", F.explode("apart").alias("token")).withColumn("met", met)
    rows = each.groupBy("leader", "leader_n", "x", "x_n").agg(F.array_sort(F.collect_list(F.struct("met", "token"))).alias("apart"))
    up, down, d, n = 100 + percent, 100 - percent, F.size("apart").cast("long"), F.col("x_n")
    rows = rows.withColumn("width", F.greatest(F.lit(1), F.floor(F.col("leader_n") * down / 12))).withColumn("excess", up * d - down * n)
    rows = rows.withColumn("class", F.floor(F.col("excess") / F.col("width")))
    least, most = F.col("excess") - 2 * down * F.ceil(n * 100 / percent), F.col("excess") + 2 * down * n
    rows = rows.withColumn("other", F.explode(F.sequence(F.floor(least / F.col("width")), F.floor(most / F.col("width")))))
    # Members with an excess up to the leader's part are linked to it: two classes of such members need not meet.
    near = lambda c: (F.col(c) + 1) * F.col("width") <= F.col("leader_n") * down
    rows = rows.filter(~(near("class") & near("other")))
    share = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("other") * F.col("width")) / (2 * up)))
    first = F.slice("apart", F.lit(1), F.greatest(F.lit(0), d - share + 1).cast("int"))
    shown = F.transform(F.filter(first, lambda t: t["met"] > 1), lambda t: t["token"])
    return rows.select("leader", "class", "other", "x", "x_n", F.explode(shown).alias("token"))


def _mixed(tokens: DataFrame, by: list[str], head) -> DataFrame:
    """The tokens' buckets whose members are in several components, with ``head`` of each."""
    return tokens.groupBy(*by).agg(head.alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select(*by, "h")


def _near_heads(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's members with its smallest, size class by size class; twice, with classes shifted by half of one."""
    parts = []
    for shift in (0.0, 0.5):
        rows = tokens.select("leader", "token", "x", "x_n", "root").distinct().withColumn("size", F.floor(F.log(F.col("x_n").cast("double")) / F.log(F.lit(100.0 / percent)) + shift))
        heads = _mixed(rows, ["leader", "token", "size"], F.min(F.struct("x_n", "x", "root")))
        parts.append(rows.join(heads, ["leader", "token", "size"]).filter(F.col("root") != F.col("h.root")).select(F.col("h.x").alias("leader"), "x", "x_n"))
    return parts[0].union(parts[1]).distinct()


def _near_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs that meet and are in different components, the smaller set as ``leader``."""
    small = tokens.select("leader", "token", F.col("class").alias("other"), F.col("other").alias("class"), F.col("x").alias("a"), F.col("x_n").alias("a_n"), F.col("root").alias("a_root"))
    found = small.join(tokens, ["leader", "token", "class", "other"]).filter((F.struct("a_n", "a") < F.struct("x_n", "x")) & (F.col("a_root") != F.col("root")) & (F.col("a_n") * 100 >= F.col("x_n") * percent))
    return found.select(F.col("a").alias("leader"), "x", "x_n").distinct()


def _inside_groups(compared: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The components when members of a leader's group have been compared that may be near each other by their differences to it."""
    tokens = write_table(_open_tokens(compared, labels, percent), "open-tokens")
    for meet in (_near_heads, _near_pairs):
        pairs = write_table(meet(_rooted(tokens, labels), percent), "near-pairs")
        if pairs.isEmpty():
            continue
        more = write_table(_linked(_compare(pairs, texts, width), percent), "inside-edges")
        if not more.isEmpty():
            labels = components(labels.select(F.col("v").alias("a"), F.col("root").alias("b")).union(more))
    return labels


def near_duplicates(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every record.

    Words are lower-cased (A-Z) runs outside 0x20 and 0x09-0x0D; a record's set
    holds its distinct ``width``-word shingles (with fewer words, all as one).
    Records with ``100 * intersection >= percent * union`` are linked; the component
    id is the least ``id_col`` reachable, and the record with that id is kept.

    Null and empty texts have an empty set and no link; long texts are read whole.  Null ids are passed
    through.  Rows that share an id keep or lose it together.  An empty table
    gives an empty result; further columns are ignored.
    """
    signed = _told_apart(write_table(signature_table(records, id_col, text_col, width), "signatures", files_per_core=HEAVY))
    slim = signed.select("_id", "_n", "_set", "_hash", "_check")
    pairs = write_table(_leader_pairs(signed), "leader-pairs", work=8)
    wanted = pairs.select(F.col("leader").alias("_set")).union(pairs.select("x")).distinct()
    texts = _texts_of_sets(records, slim.filter("_set is not null"), wanted, id_col, text_col, width)
    compared = write_table(_compare(pairs, texts, width, differences=True), "compared", files_per_core=HEAVY)
    labels = _inside_groups(compared, components(_linked(compared, percent)), texts, width, percent)
    placed = slim.select("_id", "_n", "_set").join(labels.select(F.col("v").alias("_set"), F.col("root").alias("_root")), "_set", "left").withColumn("_root", F.coalesce("_root", "_set"))
    placed = write_table(placed, "placed")
    # Written, so that a large component's rows can be split in the join.
    least = write_table(placed.filter("_root is not null").groupBy("_root").agg(F.min("_id").alias("_least")), "least-ids")
    out = placed.join(_sized(least), "_root", "left").withColumn("component_id", F.when(F.col("_root").isNull(), F.col("_id")).otherwise(F.col("_least")))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
