"""Repairs against all lists of edits tried out, and against a plain search over (cost, letters)."""

import re
from hashlib import sha256
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SMALL
from pyspark.sql import functions as F

from loglantern.llm import repair
from loglantern.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, audit int, gone int"
GOOD = re.compile(r"(s?(ua)+)?")


def tried_out(roles, faults):
    """The least (cost, letters) of all lists of edits with up to two inserts between turns."""
    edits = []
    for role, fault in zip(roles, faults, strict=True):
        ways = [("D", 3, "")]
        if fault not in ("blank", "duplicate"):
            cut = int(fault == "truncated")
            ways += [("K", cut, role[:1] or "?"), ("R", 2 + cut, "u"), ("R", 2 + cut, "a")]
        edits.append(ways)
    inserts = [[("I", 2, letter) for letter in some] for n in range(3) for some in product("ua", repeat=n)]
    best = None
    gaps = len(roles) + 1
    for own in product(*edits):
        for added in product(inserts, repeat=gaps):
            row = [e for i in range(gaps) for e in [*added[i], *own[i : i + 1]]]
            if GOOD.fullmatch("".join(e[2] for e in row)):
                found = sum(e[1] for e in row), "".join(e[0] for e in row)
                best = found if best is None else min(best, found)
    return best


def searched(roles, faults):
    """The least (cost, letters) by comparing pairs of numbers and strings, from the last turn."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserting(best):
        for _ in range(2):
            more = {s: (best[t][0] + 2, "I" + best[t][1]) for s, t in after.items() if t in best}
            best = {s: min(b[s] for b in (best, more) if s in b) for s in {*best, *more}}
        return best

    best = inserting({"": (0, ""), "a": (0, "")})
    for role, fault in list(zip(roles, faults, strict=True))[::-1]:
        now = {}
        for s, t in after.items():
            ways = [(best[s][0] + 3, "D" + best[s][1])]
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                ways.append((best[t][0] + 2 + cut, "R" + best[t][1]))
                if role[:1] == t or (role[:1] == "s" and s == ""):
                    rest = best[role[:1]]
                    ways.append((rest[0] + cut, "K" + rest[1]))
            now[s] = min(ways)
        best = inserting(now)
    return best[""]


turn = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "u"]), st.sampled_from([None, None, "blank", "duplicate", "truncated"]))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_all_short_conversations_like_all_edits_tried(n):
    turns = list(product(["s", "u", "a", "t"], [None, "blank", "truncated"]))
    for rows in product(turns, repeat=n):
        roles, faults = [r for r, _ in rows], [f for _, f in rows]
        assert repair.cheapest(roles, faults) == tried_out(roles, faults)


@settings(max_examples=300, deadline=None)
@given(st.lists(turn, max_size=14))
def test_any_conversation_like_a_search_over_pairs(rows):
    roles, faults = [r for r, _ in rows], [f for _, f in rows]
    cost, audit = repair.cheapest(roles, faults)
    assert (cost, audit) == searched(roles, faults)
    made = repair.replayed([(r, "text.") for r in roles], audit)
    assert GOOD.fullmatch("".join(r[:1] for r, _ in made))


def test_a_long_conversation():
    roles, faults = ["user", "user", "assistant", "tool", "system"] * 400, [None, "truncated", None, "blank", None, None, None] * 286
    assert repair.cheapest(roles, faults[:2000]) == searched(roles, faults[:2000])


def test_faults_are_told_in_order():
    turns = [("user", "a."), ("user", "a."), ("user", " \n"), ("user", " \n"), ("assistant", "cut"), ("assistant", "yes! \t"), ("assistant", "cut")]
    assert repair.faults(turns) == [None, "duplicate", "blank", "blank", "truncated", None, "duplicate"]


def test_odd_turns(spark):
    long = "word " * 200_000 + "end."
    rows = [
        (1, 0, "user", long, "x", 1, 1),
        (1, 3, "assistant", "yes.", "x", 1, 1),
        (2, None, None, None, "x", 1, 1),
        (2, None, "user", "first.", "x", 1, 1),
        (2, 5, "assistant", "second.", None, None, None),
        (None, None, None, None, None, None, None),
        (3, 1, "user", "gone.", "x", 1, None),
    ]
    given_rows = spark.createDataFrame(rows, SCHEMA)
    found = {r["conv_id"]: r for r in repair.repaired(given_rows, F.col("text").eqNullSafe("gone.")).collect()}
    assert set(found) == {1, 2, 3, None}
    assert (found[1]["cost"], found[1]["audit"], found[1]["gaps"]) == (0, "KK", 2)
    assert [len(t["text"]) for t in found[1]["repaired"]] == [len(long), 4]
    assert (found[2]["blank"], found[2]["audit"], found[2]["cost"], found[2]["gaps"], found[2]["illegal"]) == (1, "DKK", 3, 0, 1)
    assert (found[None]["audit"], found[None]["gaps"], found[None]["blank"]) == ("D", 0, 1)
    assert tuple(found[3])[1:] == (0, 0, 0, 0, 0, 0, "", [])


def test_no_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repaired(empty).collect() == []
    assert repair.repaired(repair.damaged(empty), F.col("gone")).collect() == []


def test_nothing_left_of_a_conversation_is_an_empty_text(spark):
    lone = spark.createDataFrame([(1, 0, "user", " ", None, None, None)], SCHEMA)
    found = repair.repaired(lone).select(repair.turns_digest(F.col("repaired")).alias("d")).first()
    assert found["d"] == sha256(b"").hexdigest()


def test_damage_is_of_all_kinds(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    harmed = repair.damaged(turns).collect()
    assert len(harmed) > turns.count() and any(r["gone"] for r in harmed)
    assert {r["conv_id"] for r in QUERIES["op12_integer_repair"](spark, SMALL).collect()} == {r["conv_id"] for r in turns.collect()}
