"""Conversation repair against brute force over all edit strings, and its defined results in corner cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from convoframe.llm import queries as Q
from convoframe.llm import repair

SF = "/root/testdata/sf0.01"
SHAPE = re.compile(r"(s?(ua)+)?")


def brute_edits(turns):
    """Cheapest edits by a search over all prefixes in the order of (cost, letters); turns are (role, text, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, roles = heapq.heappop(heap)
        if i == len(turns) and SHAPE.fullmatch(roles):
            return cost, letters
        # Only the last role and whether there are several matter for what may follow.
        if (i, roles[-1:], len(roles) > 1) in seen or not any(SHAPE.fullmatch(roles + rest) for rest in ("", "u", "a", "ua", "uaua", "aua")):
            continue
        seen.add((i, roles[-1:], len(roles) > 1))
        if cost < 5 * (len(turns) + 3):
            for r in "ua":
                heapq.heappush(heap, (cost + 5, letters + "I", i, roles + r))
        if i < len(turns):
            role, _, fault = turns[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, roles))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + extra, letters + "K", i + 1, roles + (role[:1] or "?")))
                for r in "ua":
                    heapq.heappush(heap, (cost + extra + 1, letters + "R", i + 1, roles + r))


def brute_report(rows):
    """The contract's columns for one conversation's rows after damage, (turn, role, text) in order."""
    found, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        found.append((role, text, fault))
    cost, audit = brute_edits(found)
    numbers = [t for t, _, _ in rows if t is not None]
    count = Counter(f for _, _, f in found)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    out, i, last = [], 0, ""
    for letter in audit:
        needed = "assistant" if last == "u" else "user"
        if letter == "D":
            i += 1
            continue
        role = needed if letter in "IR" else found[i][0]
        out.append(f"{role}:{'' if letter == 'I' else found[i][1]}")
        i, last = i + (letter != "I"), role[:1]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_equals_brute_force(spark):
    after = defaultdict(list)
    for conv, turn, role, text in map(tuple, spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()):
        kept, draw = after[conv], zlib.crc32(f"{conv}:{turn}".encode()) % 20
        row = (turn, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)
        kept += [row] * (0 if draw == 0 else 2 if draw == 3 else 1)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in Q.QUERIES["op13_repair"](spark, SF).collect()}
    assert got == {c: brute_report(sorted(rows, key=lambda r: r[0])) for c, rows in after.items()}
    assert len({r[6] for r in got.values()}) > 10


@pytest.mark.parametrize("seed", range(40))
def test_edits_are_cheapest_and_least(seed):
    draw = random.Random(seed)
    for _ in range(25):
        turns = [(draw.choice("suuaaax"), draw.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(draw.randrange(9))]
        codes = bytes(repair.coded(r, [None, "blank", "duplicate", "truncated"].index(f)) for r, f in turns)
        assert repair.cheapest_edits(codes) == brute_edits([(r, "", f) for r, f in turns])


ODD = [
    (1, 0, "user", "hi."), (1, 0, "user", "hi."), (1, 1, "assistant", "yes."), (1, None, "system", "be good."), (1, 5, "assistant", "cut"),
    (2, 0, None, None), (2, 1, "", "x."), (None, 0, "user", "no conversation."), (None, 1, "assistant", "none!\n"), (3, 0, "user", "  \t\n"),
    (4, 7, "user", "long. " * 30_000), (4, 9, "assistant", "a" * 40_000 + "?"), (5, None, "tool", "n."), (5, None, "assistant", "m."), (6, -3, "user", "日本語 😀."), (6, -1, "assistant", "ok. \x0b"),
]


def expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: brute_report(sorted(g, key=order)) for c, g in groups.items()}


def test_odd_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    for name in ("_conv", "_turn", "_role", "_text", "gaps", "cost", "audit", "position", "_first", "dropped"):
        rows = rows.withColumn(name, F.lit("clash"))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(rows).collect()}
    assert got == expected(ODD)
    by_text = rows.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert {r["conv_id"]: r["audit"] for r in repair.plan_repairs(by_text).collect()} == {None if c is None else f"c{c}": r[6] for c, r in expected(ODD).items()}


def test_dropped_rows_and_empty_table(spark):
    rows = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").withColumn("dropped", F.col("conv_id") == 1)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(rows, dropped_col="dropped").collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[6] == expected(ODD)[6]
    assert repair.repair_report(rows.filter("false"), dropped_col="dropped").collect() == []


def test_repaired_turns_are_legal_and_in_order(spark):
    turns = repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    plans = repair.plan_repairs(turns, dropped_col="dropped")
    groups = defaultdict(list)
    for r in repair.repaired_turns(turns, plans, dropped_col="dropped").collect():
        groups[r["conv_id"]].append(r)
    assert groups
    for rows in groups.values():
        assert [r["position"] for r in rows] == list(range(len(rows)))
        assert SHAPE.fullmatch("".join(r["role"][:1] for r in rows))
        assert all((r["text"] == "") == (r["edit"] == "I") for r in rows)


def test_long_conversation_is_planned_in_little_memory():
    import tracemalloc

    draw = random.Random(1)
    turns = bytes(repair.coded(draw.choice("sua"), draw.choice([0, 0, 0, 1, 3])) for _ in range(200_000))
    tracemalloc.start()
    cost, audit = repair.cheapest_edits(turns)
    peak = tracemalloc.get_traced_memory()[1]
    assert peak < 100 * len(turns) and len(audit) >= len(turns) and cost > 0
