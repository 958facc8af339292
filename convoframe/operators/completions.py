"""Calls to a text completion, with a cache by key and a log."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.sources.ship import ship_package

CACHE = "key string, response string, cached_at timestamp"
#: Prompts turned into Python texts at once, whatever an Arrow batch holds.
AT_ONCE = 64
LOG = "logged_at timestamp, analysis_type string, contact string, chunk long, prompt string, response string, prompt_length int, response_length int"


def _pause(error: Exception, attempt: int, wait: float) -> float | None:
    """Seconds before the next attempt: as told by the server, else doubled each time; None where another would fail too."""
    status = getattr(error, "code", None)
    if isinstance(status, int) and 400 <= status < 500 and status not in (408, 409, 425, 429):
        return None
    told = getattr(getattr(error, "headers", None), "get", lambda _: None)("Retry-After")
    return float(told) if told and str(told).isdigit() else wait * 2**attempt


class Journal:
    """Replies by key on a file system all executors share, written as they come: what was answered once is not asked again."""

    def __init__(self, place: str):
        from pyarrow import fs

        self._fs, self._root = fs.FileSystem.from_uri(place)

    def _path(self, key: str) -> str:
        name = hashlib.sha256(key.encode()).hexdigest()
        return f"{self._root}/{name[:2]}/{name}"

    def get(self, key: str) -> str | None:
        try:
            with self._fs.open_input_stream(self._path(key)) as f:
                return f.readall().decode()
        except FileNotFoundError:
            return None

    def put(self, key: str, reply: str) -> None:
        path = self._path(key)
        self._fs.create_dir(path.rpartition("/")[0], recursive=True)
        beside = f"{path}.{uuid.uuid4().hex}"
        with self._fs.open_output_stream(beside) as f:
            f.write(reply.encode())
        self._fs.move(beside, path)

    def clear(self) -> None:
        try:
            self._fs.delete_dir(self._root)
        except FileNotFoundError:
            pass


def complete(prompts: DataFrame, call: Callable[[str], str], attempts: int = 3, wait: float = 1.0, threads: int = 3, journal: str | None = None, per_minute: float | None = None) -> DataFrame:
    """``key, response, error`` of each row's ``prompt``.

    Calls run in a few threads for each partition.  One that fails is tried again, after a
    pause that doubles or that the server names; a request that is wrong in itself is not.
    After the last attempt the error is kept.  With ``journal``, a folder that all executors
    share, a reply is written there before anything else: a task that runs again, or the
    same prompts asked again, call for what is not there only.  ``per_minute`` bounds the
    calls of all tasks together, each having an equal share of it.  A batch's prompts are
    taken ``AT_ONCE`` at a time, so that a worker holds one batch and few texts besides.
    """
    ship_package(prompts.sparkSession)
    share = per_minute / prompts.sparkSession.sparkContext.defaultParallelism if per_minute else None

    def run(batches):
        import threading
        import time
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        known, lock, free = Journal(journal) if journal else None, threading.Lock(), [time.monotonic()]

        def turn() -> None:
            if share:
                with lock:
                    at = max(free[0], time.monotonic())
                    free[0] = at + 60 / share
                time.sleep(max(0.0, at - time.monotonic()))

        def one(item: tuple[str, str]) -> tuple[str | None, str | None]:
            key, prompt = item
            found = known.get(key) if known else None
            if found is not None:
                return found, None
            error = None
            for attempt in range(attempts):
                try:
                    turn()
                    reply = call(prompt)
                except Exception as e:  # noqa: BLE001  the completion is the user's
                    error, pause = str(e), _pause(e, attempt, wait)
                    if pause is None:
                        break
                    if attempt + 1 < attempts:
                        time.sleep(pause)
                    continue
                if known:
                    known.put(key, reply)
                return reply, None
            return None, error

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for start in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(start, AT_ONCE)
                    replies = list(pool.map(one, zip(*[c.to_pylist() for c in part.columns], strict=True)))
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[i] for r in replies], pa.string()) for i in range(2)]], names=["key", "response", "error"])

    return prompts.select("key", "prompt").mapInArrow(run, "key string, response string, error string")


def missing(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """One prompt of each key that the cache lacks."""
    return prompts.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def log_rows(prompts: DataFrame, replies: DataFrame, kind: str) -> DataFrame:
    """What was asked and answered, for the append-only log."""
    done = prompts.join(replies.filter("error is null"), "key")
    have = set(prompts.columns)
    return done.select(
        F.current_timestamp().alias("logged_at"), F.lit(kind).alias("analysis_type"),
        (F.col("contact") if "contact" in have else F.lit(None).cast("string")).alias("contact"),
        (F.col("chunk").cast("long") if "chunk" in have else F.lit(None).cast("long")).alias("chunk"),
        "prompt", "response", F.length("prompt").alias("prompt_length"), F.length("response").alias("response_length"),
    )
