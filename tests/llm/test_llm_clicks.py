"""Expiring windows against a row by row scan, and their defined results in corner cases."""

import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoframe.llm import clicks
from convoframe.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute_windows(rows, batches, keep=48, late=24):
    """Windows of (batch, key, hour, hash) rows as (key, start, closed, repeats, conflicts, crc, hash), row by row."""
    by_batch = defaultdict(list)
    for b, key, hour, digest in rows:
        by_batch[b].append((key, hour, digest))
    open_, done, seen = {}, [], None
    for b in range(batches):
        for key, hour, digest in sorted(by_batch[b]):
            if seen is not None and hour < seen - late:
                continue
            w = open_.get(key)
            if w and hour <= w[0] + keep:
                w[2] += 1
                if digest != w[1]:
                    w[3] += 1
                    w[4] += zlib.crc32(digest.encode())
                continue
            if w:
                done.append((key, w[0], b, *w[2:], w[1]))
            open_[key] = [hour, digest, 0, 0, 0]
        seen = max([h for _, h, _ in by_batch[b]] + ([] if seen is None else [seen]), default=None)
        for key, w in list(open_.items()):
            if b == batches - 1 or (seen is not None and w[0] + keep < seen - late):
                done.append((key, w[0], b, *w[2:], w[1]))
                del open_[key]
    return sorted(done)


def brute_copies(rows, batches):
    """The contract's copies of (click_id, arrived_at, client_id, kind, value, ts, props) rows."""
    micros = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    name = lambda x: "" if x is None else str(x)
    out = []
    for click, arrived, client, kind, value, ts, props in rows:
        for j in range(click % 3 + 1 if click is not None and arrived is not None else 0):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            cents = None if value is None else int(np.floor(100 * value + 0.5))
            text = "|".join(map(name, (client, kind, cents, None if ts is None else micros(ts), props, c % 3)))
            out.append((click, hour, hashlib.sha256(text.encode()).hexdigest(), hour + c // 10 % 200))
    low, high = min(x[3] for x in out), max(x[3] for x in out)
    return [((at - low) * batches // (high - low + 1), click, hour, digest) for click, hour, digest, at in out]


COLUMNS = ("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash")


def test_query_equals_row_by_row_scan(spark):
    table = spark.read.parquet(f"{SF}/clicks.parquet").select("click_id", "arrived_at", "client_id", "kind", "value", "ts", "props")
    before = spark.conf.get("spark.sql.streaming.unsupportedOperationCheck")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in Q.QUERIES["op12_clicks"](spark, SF).collect())
    assert got == brute_windows(brute_copies(map(tuple, table.collect()), 10), 10)
    assert len({r[2] for r in got}) == 10 and any(r[4] for r in got) and any(r[3] > r[4] for r in got)
    assert spark.conf.get("spark.sql.streaming.unsupportedOperationCheck") == before


ODD = [
    (1, "2024-01-01 00:00:00", 5, "view", 1.005, "2024-01-01 00:00:00.000001", "{}"), (1, "2024-01-01 00:00:00", 5, "view", 1.005, "2024-01-01 00:00:00.000001", "{}"),
    (2, "2024-01-01 05:59:59.999999", None, None, None, None, None), (2, "2024-01-09 00:00:00", None, None, -2.5, None, "x" * 50_000), (None, "2024-01-02 00:00:00", 1, "view", 1.0, None, None),
    (3, None, 1, "view", 1.0, None, None), (0, "1969-12-31 12:00:00", 1, "a|b", 0.0, "1969-12-31 12:00:00", "|"), (5, "2024-02-01 00:00:00", 1, "", 1e9, None, ""), (5, "2024-02-03 00:00:00", 1, "", 1e9, None, ""),
]


def test_odd_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame(ODD, "click_id long, arrived_at string, client_id long, kind string, value double, ts string, props string")
    rows = rows.withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    plain = [tuple(r) for r in rows.collect()]
    for name in ("key", "hour", "batch", "bucket", "c", "j", "hash", "crc", "seen", "last", "_batch", "_hour"):
        rows = rows.withColumn(name, F.lit("clash"))
    got = sorted(tuple(r[c] for c in COLUMNS) for r in clicks.click_windows(rows, 3).collect())
    assert got == brute_windows(brute_copies(plain, 3), 3)
    assert any(r[3] > r[4] for r in got)


def test_empty_table(spark):
    assert clicks.click_windows(spark.read.parquet(f"{SF}/clicks.parquet").filter("false"), 2).collect() == []


@pytest.mark.parametrize("seed", range(60))
def test_open_windows_over_batches(seed):
    """One bucket fed batch by batch, state packed between, with repeated rows and few hours and hashes."""
    draw = random.Random(seed)
    batches, span = draw.randrange(1, 5), draw.choice([30, 150, 600])
    digest = lambda k: hashlib.sha256(str(k).encode()).digest()
    rows = [(b, draw.randrange(6), b * span // 2 + draw.randrange(span), digest(draw.randrange(3)).hex()) for b in range(batches) for _ in range(draw.randrange(40))]
    state, seen, found = (), None, defaultdict(lambda: [None, 0, 0, 0, -1])
    for b in range(batches):
        mine = [r for r in rows if r[0] == b]
        seen = max([r[2] for r in mine] + ([] if seen is None else [seen]), default=None)
        hashes = [bytes.fromhex(r[3]) for r in mine]
        columns = (np.array([r[0] for r in mine], np.int64), np.array([r[1] for r in mine], np.int64), np.array([r[2] for r in mine], np.int64), clicks._words(hashes), np.array([zlib.crc32(r[3].encode()) for r in mine], np.int64), np.ones(len(mine), np.int64))
        windows = clicks.OpenWindows(48, 24, *state)
        out = windows.take(b, *clicks._added_up(columns)[1:], seen, b == batches - 1, True)
        for key, start, words, opened, repeats, conflicts, crc, closed in zip(*out, strict=True):
            w = found[int(key), int(start)]
            w[0] = clicks._bytes(words[None])[0].hex()
            w[1:4] = w[1] + int(repeats), w[2] + int(conflicts), w[3] + int(crc)
            assert w[4] == -1
            w[4] = int(closed)
        state = windows.packed()
    assert sorted((k, s, w[4], *w[1:4], w[0]) for (k, s), w in found.items()) == brute_windows(rows, batches)


def test_rows_are_added_up_while_they_stream(spark, monkeypatch):
    """A bucket's frames are combined before more are held; one key with a third of all rows gives the same windows."""
    import pandas as pd

    monkeypatch.setattr(clicks, "HELD_ROWS", 50)
    draw = random.Random(7)
    digest = [hashlib.sha256(str(k).encode()).digest() for k in range(4)]
    rows = [(0, draw.choice([1, 1, 2, 3]), draw.randrange(200), draw.choice(digest)) for _ in range(600)]

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    frame = pd.DataFrame({"batch": [r[0] for r in rows], "key": [r[1] for r in rows], "hour": [r[2] for r in rows], "hash": [r[3] for r in rows], "crc": [zlib.crc32(r[3].hex().encode()) for r in rows], "seen": None, "last": None})
    control = pd.DataFrame({"batch": [0], "key": [None], "hour": [None], "hash": [None], "crc": [None], "seen": [199], "last": [True]})
    tags = list(clicks.TagRows(48, 24)((0,), iter([*[frame[i : i + 40] for i in range(0, 600, 40)], control]), State()))
    out = pd.concat(clicks.CountWindows()((0,), iter(tags), State()))
    got = sorted((int(r.key), int(r.start), int(r.closed), int(r.repeats), int(r.conflicts), int(r.crc), r.hash.hex()) for r in out.itertuples())
    assert got == brute_windows([(b, k, h, d.hex()) for b, k, h, d in rows], 1)
