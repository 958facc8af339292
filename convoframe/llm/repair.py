"""Structure repair of conversations: the cheapest edits that give them a legal order of roles.

Legal are an optional system turn and then user and assistant by turns, ending
with the assistant; or nothing.  A turn is kept (K), given the role user or
assistant (R) or deleted (D), and an empty turn of either may be inserted anywhere
(I).  Blank turns and copies of an earlier turn must go; a cut-off turn that stays
costs extra.

Cost-to-go is computed backward over turns and grammar states.  A walk forward
then takes, of the edits whose cost and cost-to-go add up, the first in ASCII, so
the edits are the cheapest and, of those, the least string.  As a state allows one
role only (the first one system or user), letter and state tell the next state.

A conversation is planned in one task, from a byte a turn, and rebuilt in a second
pass from its edits as its turns stream by; texts are never held together.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import arrow_batches, lean, write_table

SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
ENDINGS = ".!?"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)

#: Grammar states: nothing yet, after system, after user, after assistant.  By state and initial the next state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role a turn gets that is inserted or renamed in a state.
GIVEN = ("user", "user", "assistant", "user")
ENDS = (START, ASSISTANT)
_FAR = 1 << 60


@dataclass(frozen=True)
class EditCosts:
    """What the edits cost; ``truncated`` is added for a cut-off turn that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def faults(text: Column) -> Column:
    """``BLANK`` or ``TRUNCATED`` or ``OK``, by the text alone."""
    body = F.rtrim(text, F.lit(SEPARATORS))
    last = F.substring(body, -1, 1)
    return F.when(body == "", BLANK).when(~last.isin(*ENDINGS), TRUNCATED).otherwise(OK)


def _edits(initial: str, fault: int, state: int, costs: EditCosts):
    """(letter, cost, next state) of the edits of one turn in a state, in the order of letters."""
    yield "D", costs.delete, state
    if fault in (BLANK, DUPLICATE):
        return
    extra = costs.truncated if fault == TRUNCATED else 0
    if initial in NEXT[state]:
        yield "K", extra, NEXT[state][initial]
    yield "R", costs.rerole + extra, NEXT[state][GIVEN[state][0]]


def _with_inserts(least: list[int], costs: EditCosts) -> list[int]:
    """Cost-to-go by state where turns may be inserted first."""
    for _ in range(len(NEXT)):
        least = [min(c, costs.insert + least[NEXT[s][GIVEN[s][0]]]) for s, c in enumerate(least)]
    return least


def cheapest_edits(turns: bytes, costs: EditCosts = EditCosts()) -> tuple[int, str]:
    """(cost, letters) for the turns of one conversation, each a byte of ``coded``."""
    to_go = _with_inserts([0 if s in ENDS else _FAR for s in range(len(NEXT))], costs)
    # By turn and state, whether inserting is tight (bit 7) and which edit of the turn is (its letter, 0: none).
    choices = bytearray(len(NEXT) * (len(turns) + 1))
    for s, c in enumerate(to_go):
        choices[len(NEXT) * len(turns) + s] = 128 if s not in ENDS and c == costs.insert + to_go[NEXT[s][GIVEN[s][0]]] else 0
    known: dict[int, list[list[tuple[str, int, int]]]] = {}
    for i in range(len(turns) - 1, -1, -1):
        code = turns[i]
        if code not in known:
            known[code] = [list(_edits(INITIALS[code >> 2], code & 3, s, costs)) for s in range(len(NEXT))]
        here = [min(c + to_go[to] for _, c, to in known[code][s]) for s in range(len(NEXT))]
        least = _with_inserts(here, costs)
        for s, c in enumerate(least):
            letter = next((ord(x) for x, cost, to in known[code][s] if cost + to_go[to] == c), 0)
            choices[len(NEXT) * i + s] = letter | (128 if c == costs.insert + least[NEXT[s][GIVEN[s][0]]] else 0)
        to_go = least
    letters, state, i = [], START, 0
    while True:
        choice = choices[len(NEXT) * i + state]
        letter = chr(choice & 127) if choice & 127 else ""
        if choice & 128 and not (letter and letter < "I"):
            letter = "I"
        if not letter:
            return to_go[START], "".join(letters)
        letters.append(letter)
        if letter == "I":
            state = NEXT[state][GIVEN[state][0]]
            continue
        if letter == "K":
            state = NEXT[state][INITIALS[turns[i] >> 2]]
        elif letter == "R":
            state = NEXT[state][GIVEN[state][0]]
        i += 1


#: Initials by the upper bits of a turn's byte; all others are one.
INITIALS = ("", "s", "u", "a")


def coded(initial: str, fault: int) -> int:
    return (INITIALS.index(initial) if initial in INITIALS else 0) << 2 | fault


def _shaped(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, dropped_col: str | None) -> DataFrame:
    """``_conv, _turn, _role, _text, _sha, _gone`` with defined values for nulls."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col(dropped_col), F.lit(False)) if dropped_col else F.lit(False)
    return turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), role.alias("_role"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_sha"), gone.alias("_gone"))


_ORDER = ("_conv", "_turn", "_role", "_sha")  # nulls come first


def plan_repairs(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None, costs: EditCosts = EditCosts()) -> DataFrame:
    """``conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every conversation.

    ``gaps`` are turn numbers missing between the least and the greatest, ``illegal``
    neighbours whose roles do not follow each other, ``audit`` the letters of the
    edits.  A turn counts under its first fault.

    Turns are ordered by number, nulls first, ties by role and then by a hash of the
    text.  Null roles and texts are one space; a null conversation is one of its own;
    repeated rows are duplicates.  Rows with ``dropped_col`` are not there, but their
    conversation is reported: without turns it has zeros and no edits.  An empty
    table gives an empty result; further columns are ignored, whatever their names.
    """
    arrow_batches(turns.sparkSession)
    conv_type = turns.schema[conv_col].dataType.simpleString()
    rows = _shaped(turns, conv_col, turn_col, role_col, text_col, dropped_col).withColumn("_fault", faults(F.col("_text"))).drop("_text")
    # A turn seen at a lower number is a duplicate; equal turns of one number are neighbours below.
    place = F.struct(F.col("_turn").isNotNull().alias("there"), F.coalesce("_turn", F.lit(0)).alias("turn"))
    rows = rows.withColumn("_place", place)
    firsts = rows.filter("not _gone").groupBy("_conv", "_role", "_sha").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_met")).filter("_met > 1")
    firsts = firsts.select(F.col("_conv").alias("_c"), F.col("_role").alias("_r"), F.col("_sha").alias("_s"), "_first")
    rows = rows.join(firsts, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_role") == F.col("_r")) & (F.col("_sha") == F.col("_s")), "left")
    rows = rows.withColumn("_again", F.coalesce(F.col("_place") > F.col("_first"), F.lit(False)))
    rows = rows.select("_conv", "_turn", "_role", "_sha", "_gone", F.col("_fault").cast("int").alias("_fault"), "_again").repartition("_conv").sortWithinPartitions(*_ORDER)

    def plan(batches):
        import pyarrow as pa

        found, at, here = [], None, None

        def flush():
            kind = pa.schema([("conv", conv_arrow), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
            out = pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in found], schema=kind)
            found.clear()
            return out

        for batch in batches:
            conv_arrow = batch.schema.field(0).type
            for conv, turn, role, sha, gone, fault, again in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if here is None or conv != at:
                    if here is not None:
                        found.append((at, *here.report(costs)))
                    at, here = conv, _Conversation()
                if not gone:
                    here.add(turn, role, sha, fault, again)
            if len(found) >= 1000:
                yield flush()
        if here is not None:
            found.append((at, *here.report(costs)))
            yield flush()

    out = rows.mapInArrow(lean(plan), f"_conv {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return out.withColumnRenamed("_conv", conv_col)


class _Conversation:
    """One conversation's turns as they stream by: a byte each, and counts."""

    def __init__(self):
        self.turns, self.counts, self.illegal, self.numbers = bytearray(), [0, 0, 0, 0], 0, 0
        self.least = self.most = self.last = None

    def add(self, turn: int | None, role: str, sha: bytes, fault: int, again: bool) -> None:
        if turn is not None and (self.most is None or turn != self.most):
            self.numbers += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        if fault != BLANK and (again or self.last == (turn, role, sha)):
            fault = DUPLICATE
        initial = role[:1]
        if self.last is not None and self.last[1][:1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = (turn, role, sha)
        self.counts[fault] += 1
        self.turns.append(coded(initial, fault))

    def report(self, costs: EditCosts) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.numbers
        return (gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, *cheapest_edits(bytes(self.turns), costs))


def repaired_turns(turns: DataFrame, plans: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """``conv_col, position, edit, role, text``: the conversations after the edits of ``plan_repairs``.

    The turns of one conversation come from one task, in order.  Deleted turns are
    left out; ``edit`` is K, R or I.  Other rows as for ``plan_repairs``.
    """
    arrow_batches(turns.sparkSession)
    conv_type = turns.schema[conv_col].dataType.simpleString()
    rows = _shaped(turns, conv_col, turn_col, role_col, text_col, dropped_col).filter("not _gone").select("_conv", "_turn", "_role", "_sha", "_text", F.lit(1).alias("_rank"))
    heads = plans.select(F.col(conv_col).alias("_conv"), F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"), F.lit(None).cast("binary").alias("_sha"), F.col("audit").alias("_text"), F.lit(0).alias("_rank"))
    dealt = rows.unionByName(heads).repartition("_conv").sortWithinPartitions(_ORDER[0], "_rank", *_ORDER[1:])
    dealt = dealt.select("_conv", "_rank", "_role", "_text")

    def rebuild(batches):
        import pyarrow as pa

        conv, audit, at, state, position, out = None, "", 0, START, 0, []

        def inserted():
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                out.append((conv, position, "I", GIVEN[state], ""))
                state, at, position = NEXT[state][GIVEN[state][0]], at + 1, position + 1

        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field(0).type), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            for c, rank, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rank == 0:
                    inserted()
                    conv, audit, at, state, position = c, text, 0, START, 0
                    continue
                inserted()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                role = GIVEN[state] if letter == "R" else role
                out.append((conv, position, letter, role, text))
                state, position = NEXT[state][role[:1]], position + 1
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                out.clear()
        inserted()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return dealt.mapInArrow(lean(rebuild), f"_conv {conv_type}, position long, edit string, role string, text string").withColumnRenamed("_conv", conv_col)


def conversation_hashes(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col, repaired_sha256`` of conversations with turns: over ``role:text`` joined by line feeds, fed turn by turn.

    ``repaired`` is straight from ``repaired_turns``, whose tasks hold whole conversations in order.
    """
    conv_type = repaired.schema[conv_col].dataType.simpleString()

    def digest(batches):
        import pyarrow as pa

        conv, running, done, schema = None, None, [], None
        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field(0).type), ("sha", pa.string())])
            for c, position, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if position == 0:
                    if running is not None:
                        done.append({"conv": conv, "sha": running.hexdigest()})
                    conv, running = c, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if running is not None:
            yield pa.RecordBatch.from_pylist([*done, {"conv": conv, "sha": running.hexdigest()}], schema=schema)

    return repaired.select(conv_col, "position", "role", "text").mapInArrow(lean(digest), f"_conv {conv_type}, repaired_sha256 string").withColumnRenamed("_conv", conv_col)


def repair_report(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None, costs: EditCosts = EditCosts()) -> DataFrame:
    """The plan of every conversation and the hash of what it becomes (that of nothing where no turn is left)."""
    names = (conv_col, turn_col, role_col, text_col, dropped_col)
    plans = write_table(plan_repairs(turns, *names, costs), "repair-plans")
    hashes = conversation_hashes(repaired_turns(turns, plans, *names), conv_col).withColumnRenamed(conv_col, "_of")
    found = plans.join(hashes, F.col(conv_col).eqNullSafe(F.col("_of")), "left").drop("_of")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: rows with faults put in by a hash of conversation and turn.

    Of twenty, 0 is dropped (it stays, marked), 1 loses its text, 2 its sentence ends,
    3 comes twice, 4 gets the role user.  Null roles and texts are one space.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(draw == 4, "user").otherwise(name("role"))
    copies = F.explode(F.sequence(F.lit(0), F.when(draw == 3, 1).otherwise(0)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (draw == 0).alias("dropped"), copies.alias("copy")).drop("copy")
