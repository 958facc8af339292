"""Calls that are asked once: replies survive their task, pauses follow the server, rates are shared."""

import os
import time

import pytest

from convoframe.operators import completions as P


def asked(folder):
    return sorted(line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split())


def counted(folder, dies_at=None):
    """A call that notes its prompt in a file, and kills its task at one prompt the first time."""

    def call(prompt):
        if prompt == dies_at and not os.path.exists(f"{folder}.died"):
            open(f"{folder}.died", "w").close()
            os._exit(1)
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(prompt + "\n")
        return f"re {prompt} ü"

    return call


@pytest.fixture
def prompts(spark):
    return spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(20)], "key string, prompt string").coalesce(1)


def test_a_task_that_dies_repeats_no_answered_call(spark, prompts, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    place = f"file://{tmp_path}/journal"
    try:
        P.complete(prompts, counted(str(calls), "p13"), threads=1, journal=place).collect()
    except Exception:  # noqa: BLE001  a local master does not run a task again: the next run stands for it
        pass
    assert len(asked(calls)) == 13
    got = P.complete(prompts, counted(str(calls), "p13"), threads=1, journal=place).collect()
    assert {r["key"]: r["response"] for r in got} == {f"k{i}": f"re p{i} ü" for i in range(20)}
    assert asked(calls) == sorted(f"p{i}" for i in range(20))  # each once
    P.Journal(place).clear()
    P.Journal(place).clear()
    assert P.Journal(place).get("k1") is None


def test_pauses():
    class Refused(Exception):
        def __init__(self, code, after=None):
            self.code, self.headers = code, {"Retry-After": after} if after else {}

    assert P._pause(OSError("net"), 0, 1.0) == 1.0 and P._pause(OSError("net"), 2, 1.0) == 4.0
    assert P._pause(Refused(503), 1, 1.0) == 2.0 and P._pause(Refused(429, "7"), 0, 1.0) == 7.0
    assert P._pause(Refused(401), 0, 1.0) is None and P._pause(Refused(408), 0, 1.0) == 1.0


def test_wrong_requests_are_not_repeated(spark, prompts, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(prompt, note=counted(str(calls))):
        note(prompt)
        error = OSError("refused")
        error.code = 400
        raise error

    rows = P.complete(prompts.limit(3), call, attempts=5, threads=1).collect()
    assert len(asked(calls)) == 3 and all(r["error"] == "refused" and r["response"] is None for r in rows)


def test_rate_is_held(spark, prompts):
    tasks = spark.sparkContext.defaultParallelism
    began = time.time()
    P.complete(prompts.limit(5), lambda p: p, threads=5, per_minute=240 * tasks).collect()
    assert time.time() - began >= 1.0  # five calls of a share of four a second


def test_a_large_batch_is_asked_in_parts(spark):
    """However many prompts an Arrow batch holds, few are texts of the worker at a time."""
    import pyarrow as pa

    class Frame:
        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    asked = []
    run = P.complete(Frame(), lambda p: asked.append(p) or p.upper(), threads=2)
    batch = pa.RecordBatch.from_pydict({"key": [f"k{i}" for i in range(300)], "prompt": [f"p{i}" for i in range(300)]})
    parts = run(iter([batch]))
    first = next(parts)
    assert first.num_rows == len(asked) == P.AT_ONCE
    rows = pa.Table.from_batches([first, *parts]).to_pylist()
    assert rows == [{"key": f"k{i}", "response": f"P{i}", "error": None} for i in range(300)]
