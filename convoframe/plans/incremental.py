"""Rounds and samples kept up to date as files arrive, change by change.

The timeline is cut into buckets of a day.  New, changed and vanished messages touch
the buckets they lie in.  From there the change spreads as far as the rules reach and no
further:

* Rounds: nothing crosses a gap wider than both the gap inside a run and the delay of a
  reply.  A touched bucket is widened to the nearest such gaps, found in a table with one
  row a bucket; what lies between them is computed again, the rest of their buckets kept.
* Samples: a round's history goes back ``hours`` and no further, and it names the contact.
  So the samples of the recomputed rounds, of rounds within ``hours`` after a touched bucket
  and of contacts shown otherwise than before are rendered again.

Positions in the whole timeline shift with every message before them.  Stored are
positions in the bucket, and distances, which don't; the bucket's offset is added when
tables are read.  All tables change in one commit of a snapshot store.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.functions.text import HOUR, SECOND, micros
from convoframe.operators import context as X
from convoframe.operators.messages import mine
from convoframe.operators.rounds import RoundRules, extract_rounds, with_runs
from convoframe.operators.samples import training_samples
from convoframe.operators.timeline import running
from convoframe.sources.scratch import materialised
from convoframe.sources.snapshots import Commit, Snapshot, Store

DAY = 24 * HOUR
MESSAGE = "msg_id string, create_time timestamp_ntz, is_sender int, talker string, room_name string, type_name string, content string, original_msg string, source_file string, file_row long"
TIMELINE = f"{MESSAGE}, t long, mine boolean, bucket long, pos long, run_back long"
EDGES = "bucket long, n long, first_t long, last_t long, first_start long, last_start long"
SOURCES = "source_file string, bucket long"
TALKERS = "bucket long, talker string, message_count long, first_time timestamp_ntz, last_time timestamp_ntz"
ROUNDS = "bucket long, pos long, talker string, other_first_back long, other_last_back long, my_last_on long, other_first_t long, other_last_t long, reply_t long, my_last_t long, other_n long, my_n long"
SAMPLES = "bucket long, pos long, talker string, reply_t long, instruction string, input string, output string"
SHOWN = "contact_id string, nickname string, remark string, relationship string, relationship_detail string, first_contact_date timestamp_ntz, me string"


@dataclass(frozen=True)
class Edges:
    """What the neighbours need to know of a bucket: its first and last message, and where in it a gap is followed."""

    first_t: int
    last_t: int
    first_start: int | None
    last_start: int | None


def _island(edges: dict[int, Edges], order: list[int], bucket: int, barrier: int, width: int) -> tuple[int, int]:
    """[from, to) around a bucket, out to the nearest gaps wider than ``barrier``."""
    lo, hi = bucket * width, (bucket + 1) * width
    if bucket not in edges:
        return lo, hi
    at = order.index(bucket)
    i = at
    while i > 0 and edges[order[i]].first_t - edges[order[i - 1]].last_t <= barrier:
        i -= 1
        start = edges[order[i]].last_start
        lo = edges[order[i]].first_t if start is None else start
        if start is not None:
            break
    i = at
    while i + 1 < len(order) and edges[order[i + 1]].first_t - edges[order[i]].last_t <= barrier:
        i += 1
        start = edges[order[i]].first_start
        hi = edges[order[i]].last_t + 1 if start is None else start
        if start is not None:
            break
    return lo, hi


def islands_around(old: dict[int, Edges], new: dict[int, Edges], touched: Iterable[int], barrier: int, width: int) -> list[tuple[int, int]]:
    """Disjoint stretches [from, to) that hold the touched buckets and, before and after the change, end at gaps."""
    spans = []
    for edges in (old, new):
        order = sorted(edges)
        spans += [_island(edges, order, b, barrier, width) for b in touched]
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _edges_of(rows: DataFrame) -> dict[int, Edges]:
    """A row a bucket: bounded by the days the timeline spans."""
    return {r["bucket"]: Edges(r["first_t"], r["last_t"], r["first_start"], r["last_start"]) for r in rows.collect()}


class Incremental:
    """The tables of one store, brought up to date by ``update``."""

    def __init__(self, store: Store, rules: RoundRules = RoundRules(), me: str = "我", hours: int = X.HOURS, width: int = DAY):
        self.store, self.spark, self.rules, self.me, self.hours, self.width = store, store.spark, rules, me, hours, width
        self.barrier = max(rules.max_gap, rules.max_delay) * SECOND

    # --- reading

    def _offsets(self, edges: DataFrame) -> DataFrame:
        """``bucket, offset``: messages before a bucket; a row a bucket, so summed up here."""
        total, rows = 0, []
        for r in edges.select("bucket", "n").orderBy("bucket").collect():
            rows.append((r["bucket"], total))
            total += r["n"]
        return self.spark.createDataFrame(rows, "bucket long, offset long")

    def _placed(self, rows: DataFrame, offsets: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(offsets), "bucket")

    def timeline(self, at: Snapshot | None = None) -> DataFrame:
        """All messages in their places, with runs: what ``with_runs(numbered(...))`` gives."""
        at = at or self.store.current()
        rows = self._placed(at.read("timeline", schema=TIMELINE), self._offsets(at.read("edges", schema=EDGES)))
        rows = rows.withColumn("ix", F.col("offset") + F.col("pos")).withColumn("run", F.col("ix") - F.col("run_back"))
        return rows.drop("bucket", "offset", "pos", "run_back")

    def _numbered(self, rounds: DataFrame, offsets: DataFrame) -> DataFrame:
        id_ = F.col("offset") + F.col("pos")
        return self._placed(rounds, offsets).select(
            id_.alias("round_id"), "talker", (id_ - F.col("other_first_back")).alias("other_first_ix"), (id_ - F.col("other_last_back")).alias("other_last_ix"), id_.alias("my_first_ix"),
            (id_ + F.col("my_last_on")).alias("my_last_ix"), "other_last_t", "reply_t", "other_n", "my_n",
        )

    def rounds(self, at: Snapshot | None = None) -> DataFrame:
        """All rounds, as ``extract_rounds`` gives them."""
        at = at or self.store.current()
        return self._numbered(at.read("rounds", schema=ROUNDS), self._offsets(at.read("edges", schema=EDGES)))

    def samples(self, at: Snapshot | None = None) -> DataFrame:
        """All samples, as ``training_samples`` gives them."""
        at = at or self.store.current()
        rows = self._placed(at.read("samples", schema=SAMPLES), self._offsets(at.read("edges", schema=EDGES)))
        return rows.select((F.col("offset") + F.col("pos")).alias("round_id"), "talker", "reply_t", "instruction", "input", "output")

    def message_stats(self, at: Snapshot | None = None) -> DataFrame:
        """Messages, first and last time by talker, from the sums kept by bucket."""
        at = at or self.store.current()
        stats = at.read("talkers", schema=TALKERS).groupBy("talker")
        return stats.agg(F.sum("message_count").alias("message_count"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))

    # --- writing

    def add(self, fresh: DataFrame, changed_files: Iterable[str] = ()) -> Commit:
        """A commit with messages added, and those of changed files replaced: timeline, edges, rounds.

        Give it to ``render`` to have the samples follow.
        """
        commit = self.store.commit()
        base, width = commit.base, F.lit(self.width)
        changed_files = list(changed_files)
        changed = self.spark.createDataFrame([(f,) for f in changed_files], "source_file string")
        t = micros(F.col("create_time"))
        kind = {c.split()[0]: c.split()[1] for c in MESSAGE.split(", ")}
        fresh = fresh.select(*[F.col(c).cast(k).alias(c) for c, k in kind.items()], t.alias("t"), mine(F.col("is_sender")).alias("mine"), F.floor(t / width).cast("long").alias("bucket"))
        fresh = materialised(fresh, "fresh-messages")
        files = base.read("sources", schema=SOURCES)
        gone = files.join(F.broadcast(changed), "source_file", "left_semi").select("bucket")
        touched = sorted({r["bucket"] for r in fresh.select("bucket").union(gone).distinct().collect()})
        if not touched:
            return commit
        kept = base.read("timeline", touched, TIMELINE)
        if changed_files:
            kept = kept.join(F.broadcast(changed), "source_file", "left_anti")
        order = ["t", "source_file", "file_row"]
        rows = kept.select(*fresh.columns).unionByName(fresh)  # written by ``running`` if it is more than two scans
        rows = running(rows, order, keys=("bucket",), sums={"pos": F.lit(1).cast("long")}, lasts={"_prev": F.col("t")})
        rows = materialised(rows, "touched-timeline")
        start = F.when(F.col("t") - F.col("_prev") > self.barrier, F.col("t"))
        fresh_edges = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min(start).alias("first_start"), F.max(start).alias("last_start"))
        old_edges = base.read("edges", schema=EDGES)
        edges = commit.write("edges", old_edges.filter(~F.col("bucket").isin(touched)).unionByName(fresh_edges))
        commit.write_buckets("sources", rows.select("source_file", "bucket").distinct(), "bucket", touched)
        stats = rows.groupBy("bucket", "talker").agg(F.count(F.lit(1)).alias("message_count"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))
        commit.write_buckets("talkers", stats, "bucket", touched)

        spans = islands_around(_edges_of(old_edges), _edges_of(edges), touched, self.barrier, self.width)
        reached = sorted({b for lo, hi in spans for b in range(lo // self.width, (hi - 1) // self.width + 1)})
        inside = self.spark.createDataFrame([(b, lo, hi) for lo, hi in spans for b in range(lo // self.width, (hi - 1) // self.width + 1)], "bucket long, lo long, hi long")
        offsets = self._offsets(edges)
        whole = rows.drop("_prev").withColumn("run_back", F.lit(None).cast("long")).unionByName(base.read("timeline", [b for b in reached if b not in touched], TIMELINE))
        met = F.exists("_spans", lambda s: (F.col("t") >= s["lo"]) & (F.col("t") < s["hi"]))
        by_bucket = inside.groupBy("bucket").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))  # two or three a bucket
        whole = self._placed(whole.join(F.broadcast(by_bucket), "bucket"), offsets).withColumn("ix", F.col("offset") + F.col("pos"))
        whole = whole.withColumn("_in", met).drop("_spans", "offset")
        # The passes carry no texts; a message meets its run again when it is written.
        runs = materialised(with_runs(whole.filter("_in").select("ix", "t", "mine", "talker"), self.rules), "reached-runs")
        columns = [c.split()[0] for c in TIMELINE.split(", ")]
        timeline = whole.join(runs.select("ix", "run"), "ix", "left").withColumn("run_back", F.coalesce(F.col("ix") - F.col("run"), "run_back")).select(*columns)
        commit.write_buckets("timeline", timeline, "bucket", reached)

        found = extract_rounds(runs, self.rules)
        firsts = runs.select(F.col("ix").alias("other_first_ix"), F.col("t").alias("other_first_t"))
        lasts = runs.select(F.col("ix").alias("my_last_ix"), F.col("t").alias("my_last_t"))
        found = found.join(firsts, "other_first_ix").join(lasts, "my_last_ix").withColumn("bucket", F.floor(F.col("reply_t") / width).cast("long"))
        id_ = F.col("round_id")
        found = self._placed(found, offsets).select(
            "bucket", (id_ - F.col("offset")).alias("pos"), "talker", (id_ - F.col("other_first_ix")).alias("other_first_back"), (id_ - F.col("other_last_ix")).alias("other_last_back"),
            (F.col("my_last_ix") - id_).alias("my_last_on"), "other_first_t", "other_last_t", "reply_t", "my_last_t", "other_n", "my_n",
        )
        old = base.read("rounds", reached, ROUNDS).join(F.broadcast(by_bucket), "bucket")
        old = old.filter(~F.exists("_spans", lambda s: (F.col("reply_t") >= s["lo"]) & (F.col("reply_t") < s["hi"]))).select(*found.columns)
        commit.write_buckets("rounds", old.unionByName(found), "bucket", reached)
        ahead = -(-self.hours * HOUR // self.width)
        commit.stale = sorted(set(reached) | {b + i for b in touched for i in range(ahead + 1)})
        return commit

    def written(self, commit: Commit) -> Snapshot:
        """A commit's tables, for its own writer to read before it is published."""
        return Snapshot(self.store, commit.version, commit.tables)

    def render(self, commit: Commit, contacts: DataFrame) -> Snapshot:
        """Publishes a commit with the samples that its rounds and the contacts change."""
        base, now = commit.base, self.written(commit)
        shown = contacts.select("contact_id", "nickname", "remark", "relationship", "relationship_detail", "first_contact_date", F.lit(self.me).alias("me"))
        shown = materialised(shown, "shown-contacts")
        old = base.read("shown", schema=SHOWN)
        same = F.lit(True)
        for c in shown.columns:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        other = shown.alias("a").join(old.alias("b"), F.col("a.contact_id") == F.col("b.contact_id"), "full").filter(~same)
        other = materialised(other.select(F.coalesce("a.contact_id", "b.contact_id").alias("talker")), "changed-contacts")
        stale = set(getattr(commit, "stale", []))
        rounds = now.read("rounds", schema=ROUNDS)
        if not other.isEmpty():
            stale |= {r["bucket"] for r in rounds.join(other, "talker", "left_semi").select("bucket").distinct().collect()}
            commit.write("shown", shown)
        elif not stale:
            return base
        stale = sorted(stale)
        mine_ = now.read("rounds", stale, ROUNDS)
        reach = mine_.agg(F.min("other_first_t").alias("lo"), F.max("my_last_t").alias("hi")).first()
        if reach["lo"] is not None:
            back = -(-self.hours * HOUR // self.width)
            needed = {b - i for b in now.buckets("rounds") if b in set(stale) for i in range(back + 1)}
            spans = mine_.select(F.explode(F.sequence(F.floor(F.col("other_first_t") / self.width), F.floor(F.col("my_last_t") / self.width))).alias("b")).distinct()
            needed |= {r["b"] for r in spans.collect()}
            offsets = self._offsets(now.read("edges"))
            lines = self._placed(now.read("timeline", needed, TIMELINE), offsets).withColumn("ix", F.col("offset") + F.col("pos")).withColumn("run", F.col("ix") - F.col("run_back"))
            lines = lines.drop("offset", "bucket", "pos", "run_back")  # read from the store by each that needs some of it
            numbered = materialised(self._numbered(mine_, offsets), "sample-rounds")
            samples = training_samples(numbered, lines, contacts, self.me).withColumn("bucket", F.floor(F.col("reply_t") / self.width).cast("long"))
            samples = self._placed(samples, offsets).select("bucket", (F.col("round_id") - F.col("offset")).alias("pos"), "talker", "reply_t", "instruction", "input", "output")
        else:
            samples = self.spark.createDataFrame([], SAMPLES)
        commit.write_buckets("samples", samples, "bucket", stale)
        return commit.publish()

    def update(self, fresh: DataFrame, contacts: DataFrame, changed_files: Iterable[str] = ()) -> Snapshot:
        """Adds messages and renders what they change."""
        return self.render(self.add(fresh, changed_files), contacts)
