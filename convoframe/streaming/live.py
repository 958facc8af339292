"""Live ingestion and live rounds.

The message stream is one timeline (rounds cross talkers), so the state of an
owner's timeline is what the batch operator would still need: the runs that no
message of mine has answered, which the delay and the look-ahead bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convoframe.functions.text import SECOND
from convoframe.operators.messages import clean_messages
from convoframe.operators.rounds import RoundRules
from convoframe.plans.incremental import Incremental
from convoframe.sources.csv_source import as_raw, parsed_rows
from convoframe.sources.ship import ship_package

ROUND = "owner string, round_id long, talker string, other_first_ix long, other_last_ix long, other_last_t long, reply_t long, other_n long"


def message_stream(spark: SparkSession, pattern: str, epoch_unit: str | None = None) -> DataFrame:
    """Clean messages from CSV files of any header as they appear in folders that match ``pattern``, read as the batch source reads them."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.csv").load(pattern)
    return clean_messages(as_raw(parsed_rows(files)), epoch_unit)


def talker_counts(messages: DataFrame, watermark: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Messages by talker and time window; late ones beyond the watermark are dropped."""
    timed = messages.withColumn("at", F.col("create_time").cast("timestamp")).withWatermark("at", watermark)
    return timed.groupBy(F.window("at", window), "talker").agg(F.count(F.lit(1)).alias("messages"))


class OpenRuns:
    """The runs that no message of mine has answered yet, and the message before: all that further messages need."""

    def __init__(self, rules: RoundRules, firsts=(), lasts=(), times=(), counts=(), talkers=(), prev_t=None, prev_mine=None, prev_talker=None):
        self.gap, self.delay, self.ahead = rules.max_gap * SECOND, rules.max_delay * SECOND, rules.look_ahead
        self.runs = [list(r) for r in zip(firsts, lasts, times, counts, talkers, strict=True)]
        self.prev_t, self.prev_mine, self.prev_talker = prev_t, prev_mine, prev_talker

    def packed(self) -> tuple:
        columns = [list(c) for c in zip(*self.runs, strict=True)] or [[], [], [], [], []]
        return (*columns, self.prev_t, self.prev_mine, self.prev_talker)

    def add(self, t: int, ix: int, own: bool, talker: str) -> tuple | None:
        """The round that a message, next in order, answers: all of ``ROUND`` but the owner."""
        found = None
        if own:
            if self.prev_mine is False:
                found = next(((ix, who, a, b, bt, t, n) for a, b, bt, n, who in self.runs if ix - b <= self.ahead and t - bt <= self.delay), None)
            self.runs = []
        elif self.prev_mine is False and self.prev_talker == talker and t - self.prev_t <= self.gap and self.runs:
            last = self.runs[-1]
            last[1], last[2], last[3] = ix, t, last[3] + 1
        else:
            self.runs.append([ix, ix, t, 1, talker])
        self.runs = [r for i, r in enumerate(self.runs) if i == len(self.runs) - 1 or (ix - r[1] < self.ahead and t - r[2] <= self.delay)]
        self.prev_t, self.prev_mine, self.prev_talker = t, own, talker
        return found


OPEN = "firsts array<long>, lasts array<long>, times array<long>, counts array<long>, talkers array<string>, prev_t long, prev_mine boolean, prev_talker string"
_ROUND = [c.split()[0] for c in ROUND.split(", ")]


def live_rounds(messages: DataFrame, rules: RoundRules = RoundRules()) -> DataFrame:
    """Rounds as their replies arrive, from ``owner, t, ix, is_sender, talker`` in order within and across batches.

    A round is sent when its reply's first message arrives.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = OpenRuns(rules, *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values(["t", "ix"])
        found = [runs.add(t, ix, sender == 1, talker) for t, ix, sender, talker in zip(rows["t"].tolist(), rows["ix"].tolist(), rows["is_sender"].tolist(), rows["talker"].tolist(), strict=True)]
        state.update(runs.packed())
        yield pd.DataFrame([(key[0], *r) for r in found if r], columns=_ROUND)

    ship_package(messages.sparkSession)
    return messages.groupBy("owner").applyInPandasWithState(step, ROUND, OPEN, "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """An owner's messages held until the watermark has passed them, then taken in order and numbered."""

    def __init__(self, rules: RoundRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.next_ix = handle.getValueState("next_ix", "ix long")
        self.held = handle.getListState("held", "t long, source_file string, file_row long, is_sender int, talker string")

    def _take(self, owner: str, rows: list[tuple], passed: int) -> Iterator[pd.DataFrame]:
        """Takes what the watermark (milliseconds) has passed, and asks to be woken when it passes the first of the rest."""
        rows.sort()
        ready = [r for r in rows if r[0] <= passed * 1000]
        rest = rows[len(ready) :]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.held.clear()
        if ready:
            runs = OpenRuns(self.rules, *(self.open.get() if self.open.exists() else ()))
            ix = self.next_ix.get()[0] if self.next_ix.exists() else 0
            found = []
            for t, _, _, sender, talker in ready:
                found.append(runs.add(t, ix, sender == 1, talker))
                ix += 1
            self.open.update(runs.packed())
            self.next_ix.update((ix,))
            yield pd.DataFrame([(owner, *r) for r in found if r], columns=_ROUND)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        for frame in rows:
            columns = [frame[c].tolist() for c in ("t", "source_file", "file_row", "is_sender", "talker")]
            held += zip(*columns, strict=True)
        yield from self._take(key[0], held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._take(key[0], [tuple(r) for r in self.held.get()] if self.held.exists() else [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def rounds_out_of_order(messages: DataFrame, rules: RoundRules = RoundRules(), late: str = "10 minutes") -> DataFrame:
    """Rounds from ``owner, create_time, source_file, file_row, is_sender, talker`` that arrive in any order.

    A message waits until the stream's newest one is ``late`` ahead of it; what arrives
    later than that is left out (Spark counts it as dropped by the watermark).  The order
    is that of the batch operator, positions are counted by the state, and a round is sent
    when its reply's first message has waited.  Needs the RocksDB state store.
    """
    ship_package(messages.sparkSession)
    timed = messages.select("owner", F.col("create_time").cast("timestamp").alias("at"), "source_file", F.col("file_row").cast("long").alias("file_row"), F.col("is_sender").cast("int").alias("is_sender"), "talker")
    timed = timed.withColumn("t", F.unix_micros("at")).withWatermark("at", late)
    return timed.groupBy("owner").transformWithStateInPandas(_InOrder(rules), ROUND, "Append", "EventTime")


def ingest(messages: DataFrame, kept: Incremental, contacts: Callable[[], DataFrame], checkpoint: str) -> StreamingQuery:
    """Starts a stream of messages into the tables of ``kept``: each batch is one commit, and rounds and samples follow.

    A batch that runs again after a failure replaces what its files gave before.
    ``contacts`` is asked at each batch for the contacts as they are then.
    """

    def add(batch: DataFrame, _: int) -> None:
        files = [r["source_file"] for r in batch.select("source_file").distinct().collect()]
        kept.update(batch, contacts(), files)

    return messages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
