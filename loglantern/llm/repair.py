"""Repairs the structure of conversations at the least cost, decided by one integer per state.

A conversation should read, by the first letters of its roles, ``(s?(ua)+)?``: perhaps a system
turn, then user and assistant in turn, ending with the assistant. Edits lead there: keep a
turn (0), give it another role (2), delete it (3), insert an empty turn of a user or assistant
(2). Blank and repeated turns must go, truncated turns that stay cost 1 more. Of the cheapest
edits those are taken whose letters (D, I, K, R in order of the turns) come first in ASCII.

Both goals are one integer: the high digits hold the cost, the low digits, base 8, the letters
of the edits from the left, with zeros after the last, so that a list comes before its own
continuations. An edit before a rest adds its cost on top, moves the rest's digits down by
one place and puts its letter first. From the last turn to the first, each state of the
grammar keeps the least integer, nothing else is compared; edits are read back from the
digits. Two inserts between turns are enough, as a third leads back to a state at a cost.

Rows are dealt by conversation and sorted in their partition; a worker holds one conversation
at a time, which is one value by nature (its turns are one list). Time grows with its turns
and, through the length of its integers, slowly with their square.

Defined cases: nulls in role, text and conversation are taken as one space, a null
conversation id is a conversation; turns without a number come first; turns of equal number
are taken by role, then text; a conversation with no turn left costs nothing and has no edits; an
empty table gives no rows; other columns are ignored. Long texts are passed on whole.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# workers get these functions themselves and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Digits of the edits, in ASCII order of their letters.
LETTERS = " DIKR"
BITS = 3

#: What has been read so far: nothing, a system turn, or a user's or an assistant's turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: The only state that a turn of user or assistant can lead to.
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}

SOUND = re.compile(r"[^\x20\x09-\x0D]")
BLANK, REPEATED, TRUNCATED = "blank", "duplicate", "truncated"
#: Text bytes of results that are handed on at once.
BATCH = 8 << 20


def after(state: int, role: str) -> int | None:
    """The state that a turn of a role leads to, if it is allowed there."""
    if role[:1] == "s":
        return SYSTEM if state == START else None
    return AFTER[state] if role[:1] == ROLES[AFTER[state]][0] else None


def faults(turns: list[tuple[str, str]]) -> list[str | None]:
    """The first fault of each (role, text)."""
    seen, found = set(), []
    for role, text in turns:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        found.append(BLANK if not last else REPEATED if (role, text) in seen else None if last in ".!?" else TRUNCATED)
        seen.add((role, text))
    return found


def cheapest(roles: list[str], found: list[str | None]) -> tuple[int, str]:
    """The least cost and, of its edits, the letters that come first in ASCII."""
    places = 3 * len(roles) + 2
    width = BITS * places
    digits = (1 << width) - 1

    def before(letter: str, cost: int, rest: int) -> int:
        return (((rest >> width) + cost) << width) + (LETTERS.index(letter) << width - BITS) + ((rest & digits) >> BITS)

    def inserted(rest: dict[int, int]) -> dict[int, int]:
        """The least integers of all states before perhaps one or two inserts."""
        for _ in range(2):
            more = {s: before("I", INSERT, rest[t]) for s, t in AFTER.items() if t in rest}
            rest = {s: min(r[s] for r in (rest, more) if s in r) for s in {*rest, *more}}
        return rest

    best = inserted({s: 0 for s in FINAL})
    for role, fault in zip(reversed(roles), reversed(found), strict=True):
        extra = CUT if fault == TRUNCATED else 0
        now = {}
        for state in AFTER:
            ways = [before("D", DELETE, best[state])]
            if fault in (None, TRUNCATED):
                kept = after(state, role)
                if kept is not None:
                    ways.append(before("K", KEEP + extra, best[kept]))
                ways.append(before("R", REROLE + extra, best[AFTER[state]]))
            now[state] = min(ways)
        best = inserted(now)
    least = best[START]
    letters = f"{least & digits:0{places}o}".translate({ord(str(i)): c for i, c in enumerate(LETTERS)})
    return least >> width, letters.rstrip(" ")


def replayed(turns: list[tuple[str, str]], edits: str) -> list[tuple[str, str]]:
    """The turns that the edits lead to."""
    state, given, made = START, iter(turns), []
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(given)
        if edit == "D":
            continue
        if edit == "K":
            state = after(state, role)
        else:
            state = AFTER[state]
            role = ROLES[state]
        made.append((role, text))
    return made


def repaired(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """A row per conversation of (conv_id, turn, role, text): its faults, cost, edits and repaired turns.

    Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), where
    ``gaps`` counts missing turn numbers, ``illegal`` neighbours that may not follow one
    another and ``repaired`` lists (role, text). Rows that ``gone`` marks only say that their
    conversation exists.
    """
    space = F.lit(" ")
    slim = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.lit(False) if gone is None else gone).alias("gone"),
    )
    id_type = slim.schema["conv_id"].dataType.simpleString()
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]

    def told(conv_id, numbers: list[int | None], rows: list[tuple[str, str]]) -> tuple:
        found = faults(rows)
        roles = [role for role, _ in rows]
        cost, audit = cheapest(roles, found)
        counted = {n for n in numbers if n is not None}
        gaps = max(counted) - min(counted) + 1 - len(counted) if counted else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        return (conv_id, gaps, *(found.count(f) for f in (BLANK, REPEATED, TRUNCATED)), illegal, cost, audit, replayed(rows, audit))

    def conversations(batches):
        """(conv_id, turn numbers, turns) of each conversation of a sorted partition."""
        now, numbers, rows, any_row = None, [], [], False
        for batch in batches:
            for conv_id, turn, role, text, left_out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if any_row and conv_id != now:
                    yield now, numbers, rows
                    numbers, rows = [], []
                now, any_row = conv_id, True
                if not left_out:
                    numbers.append(turn)
                    rows.append((role, text))
        if any_row:
            yield now, numbers, rows

    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def work(batches):
        out, size, id_kind = [], 0, None

        def first_kind(given):
            nonlocal id_kind
            for batch in given:
                id_kind = batch.schema.field("conv_id").type
                yield batch

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            turn = pa.struct([("role", pa.string()), ("text", pa.string())])
            lists = pa.array([[{"role": r, "text": t} for r, t in turns] for turns in columns[8]], pa.list_(turn))
            made = [pa.array(columns[0], id_kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string()), lists]
            return pa.RecordBatch.from_arrays(made, ["conv_id", *counts, "audit", "repaired"])

        for conv_id, numbers, rows in conversations(first_kind(batches)):
            out.append(told(conv_id, numbers, rows))
            size += sum(len(text) for _, text in rows) + 64
            if size > BATCH:
                yield packed(out)
                out, size = [], 0
        if out:
            yield packed(out)

    longs = ", ".join(f"{c} long" for c in counts)
    schema = f"conv_id {id_type}, {longs}, audit string, repaired array<struct<role: string, text: string>>"
    return slim.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with some turns dropped (``gone``), emptied, cut, repeated or given to the user.

    What happens to a turn follows from the checksum of its conversation and number; a null
    counts as one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    harm = F.col("harm")
    drawn = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("harm"))
    return drawn.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (harm == 0).alias("gone"),
        F.explode(F.when(harm == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def turns_digest(repaired_turns: Column) -> Column:
    """One hash over ``role:text`` of all turns, a line each."""
    lines = F.transform(repaired_turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)
