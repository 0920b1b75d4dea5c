"""Chat formatting in relations: turns are collected as structs, sorted, merged and joined.

The template opens a block per run of adjacent turns of one role, separates the turns within
it, and closes it. Control strings inside texts get a backslash after their first sign (and
those that already have some get one more), which reading back takes away: every text comes
back as it was. The loss mask is part of the result: ``pieces`` cuts the formatted text into
stretches that count for the loss (texts of the loss role) and stretches that do not.

Defined cases: a null text or role is empty; turns are ordered by turn (nulls first), then
role and text; repeated rows are turns of their own; a null conversation id is a conversation.
Line ends and backslashes of a role are escaped. Extra columns of the input are ignored. A
conversation becomes one text and so is bounded by what one value can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
LOSS_ROLE = "assistant"

#: Control strings of common templates, all behind a first sign of ``<`` or ``[``.
CONTROL = r"\|im_(?:start|end|sep)\|>|/?s>|</?SYS>>|/?INST\]"
ESCAPE = rf"([<\[])(\\*(?:{CONTROL}))"
UNESCAPE = rf"([<\[])\\(\\*(?:{CONTROL}))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    halves = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescaped(F.array_join(halves, "\\"))


def formatted(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: ``pieces`` (text, loss) in order and ``formatted``, their concatenation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    empty = F.lit(None).cast("array<struct<text:string,loss:boolean>>")

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def shown(x: Column, i: Column) -> Column:
        """Pieces of a turn: a new block unless the turn before has the same role, text, the end of its block."""
        joined = (i > 0) & (F.get("turns", i - 1)["role"] == x["role"])
        closed = F.coalesce(F.get("turns", i + 1)["role"] != x["role"], F.lit(True))
        before = F.when(joined, F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), _role_out(x["role"]), F.lit("\n")))
        after = F.when(closed, F.lit(CLOSE)).otherwise(F.lit(""))
        return F.array(
            piece(before, F.lit(False)), piece(escaped(x["text"]), x["role"] == loss_role), piece(after, F.lit(False))
        )

    pieces = F.coalesce(F.filter(F.flatten(F.transform("turns", shown)), lambda p: p["text"] != ""), empty)
    return turns.select("conv_id", pieces.alias("pieces")).select(
        "conv_id", "pieces", F.array_join(F.col("pieces.text"), "").alias("formatted")
    )


def read_back(rows: DataFrame) -> DataFrame:
    """Turns (role, text) read from the formatted text, and the unescaped text under the loss mask."""

    def block(text: Column) -> Column:
        body = F.substring_index(text, CLOSE, 1)
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(_role_in(role).alias("role"), unescaped(t).alias("text")))

    blocks = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda b: b != "")
    loss = F.filter("pieces", lambda p: p["loss"])
    return rows.select(
        "conv_id",
        F.flatten(F.transform(blocks, block)).alias("turns"),
        F.array_join(F.transform(loss, lambda p: unescaped(p["text"])), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(rows: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
