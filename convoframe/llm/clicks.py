"""Duplicate clicks in windows that expire, by two chained stateful operators of one streaming query.

A click id's first row opens a window; rows up to ``keep`` hours after its start are
repeats of it, a later one closes it and opens the next.  Windows also expire when
time has moved on: the feeder ends each batch with control rows, one for each state
bucket, that tell the greatest hour seen.

The first operator stores opener and deadline of each open window and tags rows
with the window they belong to (key and start).  It turns deadlines passed, by rows or
by control rows, into closing events.  The second operator gets tags and events,
accumulates the counters of each window, and gives a window out, and forgets it, when
its closing event comes.

State is kept in buckets of keys, as packed arrays: a bucket's rows of a batch are
handled by a few numpy passes, and the number of buckets follows the rows, so that a
bucket stays small.  Rows of one window are added up where they are tagged, before
they are shuffled again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from convoframe.sources.scratch import checkpoint_root
from convoframe.sources.ship import ship_package

KEEP_HOURS = 48
LATE_HOURS = 24
#: Rows of a batch for each bucket of keys, on average; and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2048, 64
#: Rows of one bucket held before equal ones are added up.
HELD_ROWS = 1 << 16

#: Spark plans one operator of this kind only, because of how event time passes through several; these two use none.
CHAINED = {"spark.sql.streaming.unsupportedOperationCheck": "false"}

ROW = "batch long, key long, hour long, hash binary, crc long, bucket long, seen long, last boolean"
TAGGED = "bucket long, key long, start long, hash binary, opened boolean, repeats long, conflicts long, crc long, closed long"
CLOSED = "key long, start long, closed long, repeats long, conflicts long, crc long, hash binary"
OPEN_STATE = "seen long, keys binary, starts binary, hashes binary"
COUNT_STATE = "keys binary, starts binary, hashes binary, repeats binary, conflicts binary, crcs binary"


def _words(hashes) -> np.ndarray:
    """32-byte hashes as four big-endian words each: they sort as the bytes do."""
    return np.frombuffer(b"".join(hashes), dtype=">u8").reshape(-1, 4).astype(np.uint64)


def _bytes(words: np.ndarray) -> list[bytes]:
    flat = words.astype(">u8").tobytes()
    return [flat[i : i + 32] for i in range(0, len(flat), 32)]


def _added_up(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(batch, key, hour, words, crc, n) sorted by all but the last two, equal rows as one."""
    batch, key, hour, words, crc, n = rows
    order = np.lexsort((words[:, 3], words[:, 2], words[:, 1], words[:, 0], hour, key, batch))
    batch, key, hour, words, crc, n = (x[order] for x in rows)
    new = np.ones(len(key), dtype=bool)
    new[1:] = (batch[1:] != batch[:-1]) | (key[1:] != key[:-1]) | (hour[1:] != hour[:-1]) | (words[1:] != words[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return batch[at], key[at], hour[at], words[at], crc[at], np.add.reduceat(n, at) if len(at) else n


class OpenWindows:
    """The open windows of one bucket: key, start, opener's hash; at most one a key, sorted by key."""

    def __init__(self, keep: int, late: int, seen: int | None = None, keys: bytes = b"", starts: bytes = b"", hashes: bytes = b""):
        self.keep, self.late, self.seen = keep, late, seen
        self.keys, self.starts, self.words = np.frombuffer(keys, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(hashes, np.uint64).reshape(-1, 4)

    def packed(self) -> tuple:
        return self.seen, self.keys.tobytes(), self.starts.tobytes(), np.ascontiguousarray(self.words).tobytes()

    def take(self, batch: int, key: np.ndarray, hour: np.ndarray, words: np.ndarray, crc: np.ndarray, n: np.ndarray, seen: int | None, last: bool, advance: bool) -> tuple[np.ndarray, ...]:
        """Tags one batch's rows (sorted, equal ones added up) and closes what then has expired.

        Returns (key, start, words, opened, repeats, conflicts, crc, closed) of the windows that
        were touched; ``closed`` is -1 where a window stays open.
        """
        if self.seen is not None:
            on_time = hour >= self.seen - self.late
            key, hour, words, crc, n = (x[on_time] for x in (key, hour, words, crc, n))
        before = len(self.keys)
        low = min([0, *([hour.min()] if len(hour) else []), *([self.starts.min()] if before else [])])
        high = max([0, *([hour.max()] if len(hour) else []), *([self.starts.max()] if before else [])])
        step = int(high - low) + self.keep + 2
        groups, first, rank = np.unique(key, return_index=True, return_inverse=True)
        ends = np.append(first[1:], len(key)).astype(np.int64)
        place = rank * step + (hour - low)
        past = lambda g, start: np.minimum(np.searchsorted(place, g * step + np.minimum(start - low + self.keep + 1, step - 1)), ends[g])
        # The windows open so far, with the rows that repeat them.
        lo, hi = np.zeros(before, np.int64), np.zeros(before, np.int64)
        pos = first.astype(np.int64)
        overtaken = np.zeros(before, dtype=bool)
        if before and len(groups):
            w = np.minimum(np.searchsorted(self.keys, groups), before - 1)
            g = np.flatnonzero(self.keys[w] == groups)
            w = w[g]
            lo[w], hi[w] = pos[g], past(g, self.starts[w])
            pos[g] = hi[w]
            overtaken[w] = pos[g] < ends[g]
        los, his, keys, starts, heads, gone = [lo], [hi], [self.keys], [self.starts], [self.words], [overtaken]
        g = np.flatnonzero(pos < ends)
        while len(g):  # the next window of every key that has rows left
            start = hour[pos[g]]
            end = past(g, start)
            los.append(pos[g])
            his.append(end)
            keys.append(groups[g])
            starts.append(start)
            heads.append(words[pos[g]])
            gone.append(end < ends[g])
            pos[g] = end
            g = g[end < ends[g]]
        lo, hi, keys, starts, heads, gone = (np.concatenate(x) for x in (los, his, keys, starts, heads, gone))
        opened = np.arange(len(keys)) >= before
        # Each row's window, by the row its window begins at.
        full = np.flatnonzero(hi > lo)
        full = full[np.argsort(lo[full], kind="stable")]
        owner = full[np.searchsorted(lo[full], np.arange(len(key)), side="right") - 1] if len(full) else np.zeros(0, np.int64)
        other = (words != heads[owner]).any(axis=1) if len(owner) else np.zeros(0, dtype=bool)
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (n, n * other, n * other * crc)]
        repeats, conflicts, crcs = (s[hi] - s[lo] for s in sums)
        repeats = repeats - opened
        if advance:
            self.seen = seen if self.seen is None or (seen is not None and seen > self.seen) else self.seen
            if last:
                gone[:] = True
            elif self.seen is not None:
                gone |= starts + self.keep < self.seen - self.late
        stay = np.flatnonzero(~gone)
        stay = stay[np.argsort(keys[stay], kind="stable")]
        self.keys, self.starts, self.words = keys[stay], starts[stay], heads[stay]
        touched = np.flatnonzero(opened | gone | (hi > lo))
        return tuple(x[touched] for x in (keys, starts, heads, opened, repeats, conflicts, crcs, np.where(gone, batch, -1)))


def _column(frame, name: str) -> np.ndarray:
    return frame[name].to_numpy().astype(np.int64)


class TagRows:
    """First operator: openers and deadlines; rows become tags of their windows, passed deadlines closing events."""

    def __init__(self, keep: int, late: int):
        self.keep, self.late = keep, late

    def __call__(self, bucket: tuple, rows: Iterator, state) -> Iterator:
        import pandas as pd

        held, controls, n = [], {}, 0
        for frame in rows:
            control = frame["key"].isna().to_numpy()
            for b, seen, last in zip(*[frame.loc[control, c].tolist() for c in ("batch", "seen", "last")], strict=True):
                controls[int(b)] = (None if seen is None or seen != seen else int(seen), bool(last))
            frame = frame[~control]
            if len(frame):
                held.append((*[_column(frame, c) for c in ("batch", "key", "hour")], _words(frame["hash"]), _column(frame, "crc"), np.ones(len(frame), np.int64)))
                n += len(frame)
            if n > HELD_ROWS:
                held = [_added_up(tuple(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = len(held[0][0]) // 2
        windows = OpenWindows(self.keep, self.late, *(state.get if state.exists else ()))
        none = np.zeros(0, np.int64)
        batch, *columns = _added_up(tuple(np.concatenate(x) for x in zip(*held, strict=True))) if held else (none, none, none, np.zeros((0, 4), np.uint64), none, none)
        for b in sorted({*batch.tolist(), *controls}):
            mine = slice(*np.searchsorted(batch, [b, b + 1]))
            keys, starts, words, opened, repeats, conflicts, crcs, closed = windows.take(b, *(x[mine] for x in columns), *controls.get(b, (None, False)), b in controls)
            if len(keys):
                yield pd.DataFrame({"bucket": bucket[0], "key": keys, "start": starts, "hash": _bytes(words), "opened": opened, "repeats": repeats, "conflicts": conflicts, "crc": crcs, "closed": closed})
        state.update(windows.packed())


class CountWindows:
    """Second operator: the counters of open windows, given out at their closing events."""

    def __call__(self, bucket: tuple, rows: Iterator, state) -> Iterator:
        import pandas as pd

        parts = []
        if state.exists:
            keys, starts, hashes, *counters = state.get
            keys = np.frombuffer(keys, np.int64)
            parts.append((keys, np.frombuffer(starts, np.int64), np.frombuffer(hashes, np.uint64).reshape(-1, 4), *[np.frombuffer(c, np.int64) for c in counters], np.full(len(keys), -1, np.int64)))
        parts += [(_column(f, "key"), _column(f, "start"), _words(f["hash"]), *[_column(f, c) for c in ("repeats", "conflicts", "crc", "closed")]) for f in rows]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort((columns[1], columns[0]))
        keys, starts, words, *counters, closed = (x[order] for x in columns)
        at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1])))[: len(keys)])
        if len(at):
            counters, closed = [np.add.reduceat(c, at) for c in counters], np.maximum.reduceat(closed, at)
        keys, starts, words, out = keys[at], starts[at], words[at], closed >= 0
        state.update((keys[~out].tobytes(), starts[~out].tobytes(), np.ascontiguousarray(words[~out]).tobytes(), *[c[~out].tobytes() for c in counters]))
        if out.any():
            repeats, conflicts, crcs = (c[out] for c in counters)
            yield pd.DataFrame({"key": keys[out], "start": starts[out], "closed": closed[out], "repeats": repeats, "conflicts": conflicts, "crc": crcs, "hash": _bytes(words[out])})


def window_stream(rows: DataFrame, buckets: int, keep: int = KEEP_HOURS, late: int = LATE_HOURS) -> DataFrame:
    """Closed windows (``CLOSED``) of a stream of rows and control rows (``ROW``, ``bucket`` set in all).

    A row has a key, an hour and a 32-byte hash with its CRC.  In a batch a key's rows
    go by hour, then hash.  A control row has a null key: all rows of its ``batch`` are
    there, ``seen`` is the greatest hour so far (null: none) and ``last`` ends the
    stream.  Rows ``late`` hours behind what the batches before had are left out.  A
    key's rows must have the ``bucket`` of some control row.  Windows are counted in
    ``buckets`` buckets of their own, so those of one key spread.  The query needs the
    settings ``CHAINED``.
    """
    ship_package(rows.sparkSession)
    tagged = rows.groupBy("bucket").applyInPandasWithState(TagRows(keep, late).__call__, TAGGED, OPEN_STATE, "append", GroupStateTimeout.NoTimeout)
    tagged = tagged.withColumn("bucket", F.pmod(F.xxhash64("key", "start"), F.lit(buckets)))
    return tagged.groupBy("bucket").applyInPandasWithState(CountWindows().__call__, CLOSED, COUNT_STATE, "append", GroupStateTimeout.NoTimeout)


def replay_windows(rows: DataFrame, batches: int, shaped, keep: int = KEEP_HOURS, late: int = LATE_HOURS) -> DataFrame:
    """Closed windows of ``rows`` fed to ``window_stream`` in ``batches`` batches, the query started anew for each.

    ``rows`` has ``batch`` (long, from 0), ``key`` (long) and ``hour`` (long), and what
    ``shaped(rows)`` needs to add ``hash`` and ``crc``.  They are written once, by batch,
    to a new folder under ``spark.checkpoint.dir``, and a batch's files are moved to the
    stream's input when its turn comes.  Rows with a null key, hour or batch belong to no
    batch and are left out.  A batch without rows still moves time; an empty table
    gives an empty result.  Columns of any other name are kept in the batches.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_root(spark)}/windows-{uuid.uuid4().hex}"
    files = _Files(spark)
    files.gone_at_exit(folder)
    kept = rows.filter("key is not null and hour is not null and batch is not null")
    kept.withColumn("_batch", F.col("batch")).write.partitionBy("_batch").parquet(f"{folder}/staged")
    schema = spark.createDataFrame([], kept.schema).select("*", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("seen"), F.lit(None).cast("boolean").alias("last")).schema
    written = spark.read.schema(kept.schema).parquet(f"{folder}/staged")
    most = {r["batch"]: (r["most"], r["n"]) for r in written.groupBy("batch").agg(F.max("hour").alias("most"), F.count(F.lit(1)).alias("n")).collect()}  # a row a batch
    buckets = max(LEAST_BUCKETS, -(-sum(n for _, n in most.values()) // (batches * BUCKET_ROWS)))
    seen, so_far = [], None
    for b in range(batches):
        so_far = most[b][0] if b in most and (so_far is None or most[b][0] > so_far) else so_far
        seen.append(so_far)
    ids = spark.range(0, batches * buckets, 1, max(1, batches * buckets >> 18))
    batch = (F.col("id") / buckets).cast("long")
    told = F.element_at(F.array(*[F.lit(s).cast("long") for s in seen]), (batch + 1).cast("int"))
    control = ids.select(batch.alias("batch"), (F.col("id") % buckets).alias("bucket"), told.alias("seen"), (batch == batches - 1).alias("last"), batch.alias("_batch"))
    control.write.mode("append").partitionBy("_batch").parquet(f"{folder}/staged")
    files.make(f"{folder}/input")

    bucket = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("key"), F.lit(buckets)))
    stream = shaped(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/input"))
    stream = stream.withColumn("bucket", bucket).select(*[c.split()[0] for c in ROW.split(", ")])
    closed = window_stream(stream, buckets, keep, late)
    with _settings(spark, CHAINED):
        for b in range(batches):
            files.move(f"{folder}/staged/_batch={b}", f"{folder}/input/{b}")
            started = closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/closed")
            started.awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{folder}/closed")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    """Sets session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Files:
    """Moves folders on the file system of the shared folder."""

    def __init__(self, spark: SparkSession):
        self._conf, self._path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _at(self, path: str):
        hadoop = self._path(path)
        return hadoop, hadoop.getFileSystem(self._conf)

    def make(self, path: str) -> None:
        hadoop, fs = self._at(path)
        fs.mkdirs(hadoop)

    def move(self, old: str, new: str) -> None:
        hadoop, fs = self._at(old)
        if not fs.rename(hadoop, self._path(new)):
            raise OSError(f"{old} could not be moved to {new}")

    def gone_at_exit(self, path: str) -> None:
        hadoop, fs = self._at(path)
        fs.deleteOnExit(hadoop)


# --- clicks


def _utc_micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time; one without a zone is read as UTC, whatever the session's zone."""
    if rows.schema[name].dataType.simpleString() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(name)


def click_copies(clicks: DataFrame, batches: int) -> DataFrame:
    """The clicks' copies with ``key``, ``hour``, ``c`` and ``batch``: 1 to 3 a row, later ones of a click at later hours."""
    hours = F.floor(_utc_micros(clicks, "arrived_at") / F.lit(3_600_000_000)).cast("long")
    copies = clicks.select("*", hours.alias("_hour"), F.explode(F.sequence(F.lit(0), F.pmod("click_id", F.lit(3)).cast("int"))).alias("j"))
    copies = copies.withColumn("c", F.crc32(F.concat(F.col("click_id").cast("string"), F.lit(":"), F.col("j").cast("string"))))
    copies = copies.withColumn("hour", F.col("_hour") + 6 * F.col("j") * (F.col("c") % 10))
    line = F.col("hour") + F.floor(F.col("c") / 10) % 200
    low, high = copies.agg(F.min(line), F.max(line)).first()
    batch = F.floor((line - F.lit(low)) * batches / F.lit((high or 0) - (low or 0) + 1)).cast("long")
    return copies.select(F.col("click_id").cast("long").alias("key"), "hour", "c", batch.alias("batch"), "client_id", "kind", "value", "ts", "props")


def click_hash(copies: DataFrame) -> Column:
    """Lowercase hex of SHA-256 over a copy's content, bars between, nulls empty."""
    parts = (F.col("client_id"), F.col("kind"), F.floor(100 * F.col("value") + 0.5).cast("long"), _utc_micros(copies, "ts"), F.col("props"), F.col("c") % 3)
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def with_click_hash(copies: DataFrame) -> DataFrame:
    return copies.withColumn("_hex", click_hash(copies)).withColumn("hash", F.unhex("_hex")).withColumn("crc", F.crc32("_hex"))


def click_windows(clicks: DataFrame, batches: int = 10) -> DataFrame:
    """``click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash`` of every window.

    Conflicts are repeats with content unlike the opener's.  Rows without a click id or
    an arrival have no copies; a negative id has those of its remainder from 0 to 2; other
    nulls are empty in the hash; rows that repeat are rows of their own.  An empty table
    gives an empty result; further columns are ignored.
    """
    needed = clicks.select("click_id", "arrived_at", "client_id", "kind", "value", "ts", "props")
    closed = replay_windows(click_copies(needed, batches), batches, with_click_hash)
    return closed.select(
        F.col("key").alias("click_id"), F.col("start").alias("start_hour"), F.col("closed").alias("closed_batch"), F.col("repeats").alias("n_repeats"),
        F.col("conflicts").alias("n_conflicts"), F.col("crc").alias("conflict_crc"), F.lower(F.hex("hash")).alias("hash"),
    )
