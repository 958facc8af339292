"""Jaccard join on word shingles by T-occurrence search, and the groups it links.

Two sets of sizes ``n`` and ``m`` are linked if they share at least
``T = ceil(percent * (n + m) / (100 + percent))`` shingles: a document is found where it
occurs in T of a query's inverted lists.  DivideSkip sets the longest lists apart,
merges the short ones by a heap that skips what cannot reach ``T`` less the number of
long lists, and probes the long lists for the documents left by binary search.

One index of everything would be in one place.  So shingles have one order for all
documents, from rare to frequent (by a count table of fixed size over all documents; any
order is exact), and linked documents share one of the first ``n - T + 1`` of each.
Documents of like sizes that share such a shingle form a bucket, buckets are joined by
their leader (the member most others meet), and each leader's group is a search of its own: indexed
in blocks of bounded size, all with the leader in them.  Members that are in one
component need not find each other, so a group of copies takes one search.

What a group of several blocks may still miss are links between blocks.  Where its
members are in several components, they are routed again by the order of the group's own
frequencies; a group of several blocks that this leaves has the members outside its
largest component indexed, and all members search them, block by block.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe.llm.common import HEAVY, arrow_batches, arrow_texts, lean, write_table
from convoframe.llm.components import components
from convoframe.llm.neardup import _rooted, _signed, _sized, _texts_of_sets, _told_apart, set_hashes
from convoframe.sources.scratch import drop, last_only, noted

#: Slots of the count table that orders shingles (a byte each where it is sent); parts it is added up in.
SLOTS, PARTS = 1 << 20, 64
#: Shingles of one block, on average.
BLOCK_SHINGLES = 1 << 19
#: The most sets whose copies a task knows again.
SEEN = 1 << 17
#: DivideSkip's weight of a long list's probe against a merge.
MU = 0.1


def least_overlap(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


# --- the search


def merge_skip(lists: list[tuple[int, int]], post: list[int], least: int):
    """(document, number of lists) of documents in at least ``least`` of the lists, spans of ``post`` in order."""
    heap = [(post[s], s, e) for s, e in lists if s < e]
    heapify(heap)
    while len(heap) >= least:
        doc, popped = heap[0][0], []
        while heap and heap[0][0] == doc:
            popped.append(heappop(heap))
        if len(popped) >= least:
            yield doc, len(popped)
            for _, s, e in popped:
                if s + 1 < e:
                    heappush(heap, (post[s + 1], s + 1, e))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heappop(heap))
        if not heap:
            return
        doc = heap[0][0]  # no document before it is in enough lists
        for _, s, e in popped:
            s = bisect_left(post, doc, s, e)
            if s < e:
                heappush(heap, (post[s], s, e))


def divide_skip(lists: list[tuple[int, int]], post: list[int], least: int, wanted, needed):
    """(document, number of lists) of ``wanted`` documents in at least ``needed(document)`` lists, which is ``least`` or more."""
    lists = sorted(lists, key=lambda x: x[0] - x[1])
    longest = lists[0][1] - lists[0][0]
    k = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
    for doc, n in merge_skip(lists[k:], post, least - k):
        if not wanted(doc):
            continue
        needs = needed(doc)
        for i, (s, e) in enumerate(lists[:k]):
            if n + k - i < needs:
                break
            at = bisect_left(post, doc, s, e)
            n += at < e and post[at] == doc
        if n >= needs:
            yield doc, n


class _Parts:
    """Union-find over a block's documents."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(label, i) for i, label in enumerate(labels)]
        self.n = len(first)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def union(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)
        self.n -= 1


def search_block(sets: list[np.ndarray], labels: list, percent: int, indexed: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links between a block's sets that join its components: pairs of places in ``sets``.

    ``labels`` are the components known before.  With ``indexed`` only those sets are
    in the index, and only pairs with one of them are found.
    """
    by_size = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = [len(sets[i]) for i in by_size]
    parts = _Parts([labels[i] for i in by_size])
    links: list[tuple[int, int]] = []
    if parts.n <= 1:
        return links
    m = len(by_size)
    tokens = np.concatenate([sets[i] for i in by_size])
    owner = np.repeat(np.arange(m), sizes)
    _, rank, met = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = met[rank] > 1
    rank, owner = rank[shared], owner[shared]
    order = np.argsort(rank, kind="stable")  # a list's documents are in order of size
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    mark = rank[order].astype(np.int64) * m + owner[order]
    starts = np.searchsorted(owner, np.arange(m + 1))
    if indexed is None:
        post_mark, post = mark, owner[order].tolist()
    else:
        kept = np.array([indexed[i] for i in by_size])[owner[order]]
        post_mark, post = mark[kept], owner[order][kept].tolist()
    for q in range(m):
        n = sizes[q]
        low = bisect_left(sizes, -(-percent * n // 100))
        # A pair is found from its larger set; if only some are indexed, from those not in the index with larger ones too.
        whole = indexed is not None and not indexed[by_size[q]]
        high = bisect_left(sizes, 100 * n // percent + 1) if whole else q
        if low >= high:
            continue
        of = rank[starts[q] : starts[q + 1]].astype(np.int64) * m
        s, e = np.searchsorted(post_mark, of + low), np.searchsorted(post_mark, of + high)
        least = least_overlap(n, sizes[low], percent)
        some = np.flatnonzero(s < e)
        if len(some) < least:
            continue
        lists = list(zip(s[some].tolist(), e[some].tolist(), strict=True))
        for doc, _ in divide_skip(lists, post, least, lambda d: parts.find(d) != parts.find(q), lambda d: least_overlap(n, sizes[d], percent)):  # noqa: B023
            parts.union(doc, q)
            links.append((by_size[doc], by_size[q]))
            if parts.n == 1:
                return links
    return links


# --- routing


def _sets_of(column, width: int, hasher):
    from convoframe.llm.wordhash import shingles

    offsets, data = arrow_texts(column)
    return [shingles(hasher.text(data[a:b]), width) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def frequency_ranks(records: DataFrame, text_col: str, width: int) -> np.ndarray:
    """A byte a slot: the logarithm (in quarters) of how many documents' shingles fall into it, over all documents.

    Each task adds its documents up in a table of ``SLOTS`` counts, parts of which are then added up over tasks.
    """
    arrow_batches(records.sparkSession)

    def count(batches):
        import pyarrow as pa

        from convoframe.llm.wordhash import WordHasher

        hasher, found = WordHasher(), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for s in _sets_of(batch.column(0), width, hasher):
                np.add.at(found, _slots(s), 1)
        parts = found.reshape(PARTS, -1)
        yield pa.RecordBatch.from_pydict({"part": list(range(PARTS)), "counts": [p.tobytes() for p in parts]}, schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        ranks = [np.round(4 * np.log2(np.maximum(c, 1))).astype(np.uint8).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_pydict({"part": list(sums), "ranks": ranks}, schema=pa.schema([("part", pa.int32()), ("ranks", pa.binary())]))

    counted = records.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(count), "part int, counts binary")
    added = counted.repartition(PARTS, "part").mapInArrow(lean(add), "part int, ranks binary").collect()  # SLOTS bytes
    out = np.zeros(SLOTS, np.uint8).reshape(PARTS, -1)
    for row in added:
        out[row["part"]] = np.frombuffer(row["ranks"], np.uint8)
    return out.reshape(-1)


def prefix_table(records: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``_id, _n, _set, _hash, _check, _bands``: size, the set's two hashes (null: empty), its first shingles from the rarest.

    Of equal sets in one task the first has the shingles, so copies are no rows by key (``SEEN`` sets are remembered at most).
    """
    spark = records.sparkSession
    ranks = spark.sparkContext.broadcast(frequency_ranks(records, text_col, width))
    id_type = records.schema[id_col].dataType.simpleString()

    def sign(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        from convoframe.llm.wordhash import WordHasher

        hasher, seen = WordHasher(), set()
        for batch in batches:
            sets = _sets_of(batch.column(1), width, hasher)
            hashes, checks = (_signed(x) for x in set_hashes(sets))
            firsts = []
            for s, known in zip(sets, zip(hashes.tolist(), checks.tolist(), strict=True), strict=True):
                firsts.append(s[:0] if known in seen else s[np.argsort(ranks.value[_slots(s)], kind="stable")[: len(s) - -(-percent * len(s) // 100) + 1]])
                if len(seen) < SEEN:
                    seen.add(known)
            hashes, checks = pa.array(hashes, pa.int64()), pa.array(checks, pa.int64())
            hashes = pa.compute.if_else(pa.array(np.array([len(s) == 0 for s in sets], dtype=bool)), pa.scalar(None, pa.int64()), hashes)
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in firsts]))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(np.concatenate([np.zeros(0, np.uint64), *firsts])), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), hashes, hashes, checks, bands], names=["_id", "_n", "_set", "_hash", "_check", "_bands"])

    return records.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(sign), f"_id {id_type}, _n long, _set long, _hash long, _check long, _bands array<long>")


def _leader_pairs(signed: DataFrame, percent: int) -> DataFrame:
    """(``leader``, ``x``, ``x_n``): the other members of each leader's buckets, by set.

    A bucket holds the sets that share a key of ``_bands`` and may be linked by their
    sizes: sizes are cut into classes as wide as linked sizes can differ, and a set is in its
    own class and the next.  The first key that linked sets share lies in both where
    enough shingles follow, so a key's place says how large the other may be (``reach``), and
    members that no other's size and reach allow are left out.  Rows move once by key; all windows lie in that.
    """
    ranked = signed.filter("_set is not null").select(F.posexplode("_bands").alias("at", "key"), F.col("_set").alias("x"), F.col("_n").alias("x_n")).filter("key is not null")
    reach = F.expr(f"(({100 + percent} * (x_n - at) - {percent} * x_n) div {percent})").alias("reach")
    rows = ranked.select("key", "x", "x_n", reach).repartition("key")
    several = lambda df, *by: df.withColumn("_lo", F.min("x").over(Window.partitionBy(*by))).withColumn("_hi", F.max("x").over(Window.partitionBy(*by))).filter("_lo <> _hi").drop("_lo", "_hi")
    rows = several(rows, "key").groupBy("key", "x").agg(F.first("x_n").alias("x_n"), F.max("reach").alias("reach"))
    # A little wider, so that no rounding tells linked sizes two classes apart.
    size = F.floor(F.log(F.col("x_n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0)).cast("int")
    rows = rows.withColumn("class", size).withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    bucket = Window.partitionBy("key", "class")
    by_size = bucket.orderBy("x_n", "x")
    rows = rows.withColumn("_next", F.lead("x_n").over(by_size)).withColumn("_reached", F.max("reach").over(by_size.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_least", F.min("x_n").over(bucket))
    rows = rows.filter("_next <= reach or (_reached >= x_n and _least <= reach)").select("key", "class", "x", "x_n")
    members = write_table(several(rows, "key", "class").withColumn("met", F.count(F.lit(1)).over(bucket)), "classed-members", work=4)
    drawn = members.groupBy("x").agg(F.sum("met").alias("pull"))
    led = members.join(drawn, "x").select("key", "class", "x", "x_n", "pull").withColumn("leader", F.max(F.struct("pull", "x")).over(bucket)["x"])
    return led.filter("x <> leader").select("leader", "x", "x_n").distinct()


def _grouped(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``leader, x, x_n, blocks``: the leaders' groups with their leaders, and how many blocks each takes."""
    leaders = pairs.select("leader").distinct().join(sizes, F.col("leader") == F.col("_set")).select("leader", F.col("leader").alias("x"), F.col("_n").alias("x_n"))
    rows = pairs.select("leader", "x", "x_n").unionByName(leaders)
    large = rows.groupBy("leader").agg(F.sum("x_n").alias("all")).filter(F.col("all") > BLOCK_SHINGLES).select("leader", F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    large = _sized(write_table(large, "large-groups"))
    return rows.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _found(dealt: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (``a``, ``b``) found in each (``leader``, ``block``, ``other``); ``x`` with its component ``root``, indexed or only searching."""
    rows = dealt.join(texts.withColumnRenamed("_set", "x"), "x").select("leader", "block", "other", "x", "root", "indexed", "_z")
    rows = rows.repartition("leader", "block", "other").sortWithinPartitions("leader", "block", "other")

    def run(batches):
        import pyarrow as pa
        import zstandard

        from convoframe.llm.wordhash import WordHasher, shingles

        hasher, plain = WordHasher(), zstandard.ZstdDecompressor()
        at, held, links = None, [], []

        def flush():
            links.extend((held[i][0], held[j][0]) for i, j in search_block([h[3] for h in held], [h[1] for h in held], percent, None if all(h[2] for h in held) else [h[2] for h in held]))
            held.clear()

        for batch in batches:
            for leader, block, other, x, root, indexed, z in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (leader, block, other) != at:
                    flush()
                    at = (leader, block, other)
                held.append((x, root, indexed, shingles(hasher.text(np.frombuffer(plain.decompress(z), np.uint8)), width)))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in range(2)], names=["a", "b"])
                links.clear()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in range(2)], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


def _in_blocks(groups: DataFrame) -> DataFrame:
    """Each member in one block of its group, the leader in all of them."""
    mine = F.array(F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    blocks = F.when(F.col("x") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(mine)
    return groups.select("leader", F.explode(blocks).alias("block"), F.lit(0).alias("other"), "x", "root", F.lit(True).alias("indexed"))


def _open_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The groups of several blocks whose members are in several components, with ``root``."""
    rows = _rooted(groups.filter("blocks > 1").drop("root"), labels)
    mixed = rows.groupBy("leader").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("leader")
    return write_table(rows.join(_sized(write_table(mixed, "open-leaders")), "leader", "left_semi"), "open-groups")


def _routed_again(groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(``leader``, ``x``, ``x_n``) by what members share of the shingles that are rarest in their group."""
    arrow_batches(groups.sparkSession)

    def unpack(batches):
        import pyarrow as pa
        import zstandard

        from convoframe.llm.wordhash import WordHasher, shingles

        hasher, plain = WordHasher(), zstandard.ZstdDecompressor()
        for batch in batches:
            sets = [_signed(shingles(hasher.text(np.frombuffer(plain.decompress(z), np.uint8)), width)) for z in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.list_(pa.int64()))], names=["leader", "x", "x_n", "tokens"])

    rows = groups.select("leader", "x", "x_n").join(texts.withColumnRenamed("_set", "x"), "x").select("leader", "x", "x_n", "_z")
    rows = write_table(rows.mapInArrow(lean(unpack), "leader long, x long, x_n long, tokens array<long>"), "open-sets", files_per_core=HEAVY)
    each = rows.select("leader", "x", "x_n", F.explode("tokens").alias("token"))
    met = each.groupBy("leader", "token").agg(F.count(F.lit(1)).alias("met"))
    ordered = each.join(met, ["leader", "token"]).groupBy("leader", "x", "x_n").agg(F.array_sort(F.collect_list(F.struct("met", "token"))).alias("tokens"))
    first = F.slice("tokens", F.lit(1), (F.col("x_n") - F.ceil(F.col("x_n") * percent / 100) + 1).cast("int"))
    keys = F.transform(first, lambda t: F.when(t["met"] > 1, F.xxhash64(F.col("leader"), t["token"])))
    return _leader_pairs(ordered.select(F.col("x").alias("_set"), F.col("x_n").alias("_n"), keys.alias("_bands")), percent)


def _across_blocks(groups: DataFrame) -> DataFrame:
    """Members outside their group's largest component indexed block by block, searched by every block of the group."""
    counts = groups.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("leader").agg(F.max(F.struct("n", "root")).alias("m")).select("leader", F.col("m.root").alias("main"))
    rows = groups.join(_sized(write_table(main, "main-components")), "leader")
    few = rows.filter("root <> main")
    blocks = few.groupBy("leader").agg(F.ceil(F.sum("x_n") / BLOCK_SHINGLES).cast("int").alias("few_blocks"))
    blocks = _sized(write_table(blocks, "few-blocks"))
    place = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
    index = few.join(blocks, "leader").select("leader", place("few_blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "x", "root", F.lit(True).alias("indexed"))
    asking = rows.join(blocks, "leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1)).alias("block"), place("blocks").alias("other"), "x", "root", (F.col("root") != F.col("main")).alias("_few"), place("few_blocks").alias("_home"))
    asking = asking.filter(~(F.col("_few") & (F.col("_home") == F.col("block")))).select("leader", "block", "other", "x", "root", F.lit(False).alias("indexed"))
    return index.unionByName(asking)


def overlap_groups(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every record.

    Words are lower-cased (A-Z) runs outside 0x20 and 0x09-0x0D; a record's set
    holds its distinct ``width``-word shingles (with fewer words, all as one).
    Records with ``100 * intersection >= percent * union`` are linked, equal sets are one
    (by 128 bits of hash and their size); the component id is the least ``id_col`` that links reach.

    Null and empty texts have an empty set and no link; long texts are read whole.
    Null ids are passed through; rows that share an id share its links.  An empty
    table gives an empty result; further columns are ignored.
    """
    with noted() as prefixes:
        signed = _told_apart(write_table(prefix_table(records, id_col, text_col, width, percent), "prefixes", files_per_core=HEAVY))
    slim = write_table(signed.select("_id", "_n", "_set", "_hash", "_check"), "sets")
    filled = slim.filter("_set is not null")
    pairs = last_only(records.sparkSession, lambda: write_table(_leader_pairs(signed, percent), "leader-pairs", work=8))
    drop(records.sparkSession, prefixes)
    wanted = pairs.select(F.col("leader").alias("_set")).union(pairs.select("x")).distinct()
    texts = _texts_of_sets(records, filled, wanted, id_col, text_col, width)
    sizes = filled.groupBy("_set").agg(F.first("_n").alias("_n"))
    groups = write_table(_grouped(pairs, sizes).withColumn("root", F.col("x")), "groups")
    labels = components(write_table(_found(_in_blocks(groups), texts, width, percent), "links", files_per_core=HEAVY))
    for last in (False, True):
        open_groups = _open_groups(groups, labels)
        if open_groups.isEmpty():
            break
        if last:
            dealt = _across_blocks(open_groups)
        else:
            again = last_only(records.sparkSession, lambda: write_table(_routed_again(open_groups, texts, width, percent), "leader-pairs", work=8))  # noqa: B023
            groups = write_table(_rooted(_grouped(again, sizes), labels), "groups")
            dealt = _in_blocks(groups)
        links = write_table(_found(dealt, texts, width, percent), "links", files_per_core=HEAVY)
        if not links.isEmpty():
            labels = components(labels.select(F.col("v").alias("a"), F.col("root").alias("b")).union(links))
    placed = slim.select("_id", "_n", "_set").join(labels.select(F.col("v").alias("_set"), F.col("root").alias("_root")), "_set", "left")
    placed = write_table(placed.withColumn("_root", F.coalesce("_root", "_set")), "placed")
    least = write_table(placed.filter("_root is not null").groupBy("_root").agg(F.min("_id").alias("_least")), "least-ids")
    out = placed.join(_sized(least), "_root", "left").withColumn("component_id", F.when(F.col("_root").isNull(), F.col("_id")).otherwise(F.col("_least")))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), "component_id")
