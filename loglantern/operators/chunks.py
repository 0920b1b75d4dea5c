"""Chunks of a log within a token limit.

A raw log is one text in one row, so its chunks are found within the row: no
shuffle.  Only the packing itself, which depends on every chunk before, runs in
Python, and it sees token counts, not text.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglantern import fixed_values as fx
from loglantern.functions.text import tokens_in
from loglantern.operators.ordered import first_rows

# workers get the packing function itself and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN = T.ArrayType(
    T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
)


def pack(tokens: np.ndarray, limit: int, overlap: int) -> list[dict[str, int]]:
    """Spans (1-based, closed) of lines per chunk.

    A chunk closes before the line that would take it over the limit; the next one
    starts some lines back, but never before its predecessor.
    """
    n = len(tokens)
    if n == 0:
        return []
    upto = np.concatenate([[0], np.cumsum(tokens)])  # upto[i]: tokens of the first i lines
    spans, start, seen = [], 0, 1
    while True:
        # first line past `seen` with which lines start..line hold more than the limit
        over = int(np.searchsorted(upto, upto[start] + limit, side="right")) - 1
        over = max(over, seen)
        if over >= n:
            spans.append({"first": start + 1, "last": n})
            return spans
        spans.append({"first": start + 1, "last": over})
        start, seen = max(start, over - overlap), over + 1


def spans_of(token_counts: Column, limit: int, overlap: int) -> Column:
    @F.pandas_udf(SPAN)
    def packed(counts: pd.Series) -> pd.Series:
        return counts.map(lambda t: pack(np.asarray(t, dtype=np.int64), limit, overlap))

    return packed(token_counts)


def kept_lines(lines: Column, excluded: Column) -> Column:
    """Lines, numbered from 1, without the excluded line numbers."""
    numbers = F.sequence(F.lit(1).cast("bigint"), F.size(lines).cast("bigint"))
    kept = F.array_except(numbers, excluded)  # by hash: linear in the lines
    return F.transform(kept, lambda n: F.get(lines, (n - 1).cast("int")))


def body_chunks(
    raw_logs: DataFrame,
    error_lines: DataFrame | None = None,
    limit: int = fx.CHUNK_TOKENS,
    overlap: int = fx.OVERLAP_LINES,
) -> DataFrame:
    """Chunks of the logs too long for one: ``log_id, chunk_id, first_line, last_line, chunk``.

    ``first_line`` and ``last_line`` count the kept lines.  ``error_lines``
    (``log_id, line_number``) are left out, being shown in the head chunk.
    """
    long_logs = raw_logs.filter(tokens_in(F.col("raw_content")) > limit)
    none = F.array().cast("array<bigint>")
    if error_lines is None:
        marked = long_logs.withColumn("excluded", none)
    else:
        # one list per raw log, no longer than the log's own text in its one row
        lists = error_lines.groupBy("log_id").agg(F.collect_set("line_number").alias("excluded"))
        marked = long_logs.join(lists, "log_id", "left").withColumn(
            "excluded", F.coalesce("excluded", none)
        )
    lines = marked.select("log_id", F.split("raw_content", "\n").alias("all"), "excluded")
    kept = lines.select("log_id", kept_lines(F.col("all"), F.col("excluded")).alias("lines"))
    counted = kept.withColumn("counts", F.transform("lines", tokens_in))
    packed = counted.select("log_id", "lines", spans_of(F.col("counts"), limit, overlap).alias("spans"))

    def cut(span: Column) -> Column:
        text = F.array_join(F.slice("lines", span["first"], span["last"] - span["first"] + 1), "\n")
        return F.struct(span["first"].alias("first"), span["last"].alias("last"), text.alias("chunk"))

    # texts are cut before rows are made, so no row carries the whole log
    return packed.select("log_id", F.posexplode(F.transform("spans", cut)).alias("n", "part")).select(
        "log_id",
        (F.col("n") + 1).cast("bigint").alias("chunk_id"),
        F.col("part.first").cast("bigint").alias("first_line"),
        F.col("part.last").cast("bigint").alias("last_line"),
        "part.chunk",
    )


def _section(rows: DataFrame, name: str, order: str, text: Column) -> DataFrame:
    """A few ordered rows per log as one text."""
    return rows.groupBy("log_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), text.alias("text")))),
                lambda e: e["text"],
            ),
            "\n",
        ).alias(name)
    )


# --- fixed values: the wording of the texts made below is what readers of them expect ---
def head_chunks(
    summary: DataFrame, entry_rows: DataFrame, stage_rows: DataFrame, prioritize_errors: bool = True
) -> DataFrame:
    """Metadata and, for logs with errors, the first ten errors and five warnings."""

    def item(extra: Column, n: Column) -> Column:
        return F.concat(
            F.lit("\n"), n, F.lit(". "), extra, F.lit("Line "), F.col("line_number"), F.lit(":\n   "), F.col("message")
        )

    n = F.col("position")
    errors = first_rows(entry_rows.filter("kind = 'error'"), "log_id", ["line_number"], 10)
    warnings = first_rows(entry_rows.filter("kind = 'warning'"), "log_id", ["line_number"], 5)
    level = F.concat(F.lit("["), F.col("level"), F.lit("] "))
    first_stages = first_rows(stage_rows, "log_id", ["stage_order"], 5)
    icon = F.when(F.col("status") == "SUCCESS", "✅").otherwise("❌")
    stage = F.concat(F.lit("  "), icon, F.lit(" "), F.col("stage"), F.lit(" - "), F.col("status"))
    joined = (
        summary.join(_section(errors, "errors", "position", item(level, n)), "log_id", "left")
        .join(_section(warnings, "warnings", "position", item(F.lit(""), n)), "log_id", "left")
        .join(_section(first_stages, "stages", "position", stage), "log_id", "left")
    )

    def more(count: str, shown: int, before: str, after: str) -> Column:
        left = F.col(count) - shown
        return F.when(left > 0, F.concat(F.lit(before), left, F.lit(after)))

    def or_else(value: str, other: str) -> Column:
        return F.coalesce(F.nullif(F.col(value), F.lit("")), F.lit(other))

    metadata = F.concat_ws(
        "\n",
        F.lit("=== BUILD METADATA ==="),
        F.concat(F.lit("Platform: "), "platform"),
        F.concat(F.lit("Job: "), or_else("job_name", "Unknown")),
        F.concat(F.lit("Build: "), or_else("build_number", "N/A")),
        F.concat(F.lit("Status: "), "status"),
        F.concat(F.lit("Errors: "), "error_count"),
        F.concat(F.lit("Warnings: "), "warning_count"),
        F.when(F.col("triggered_by") != "", F.concat(F.lit("Triggered by: "), "triggered_by")),
        F.when(F.col("stage_count") > 0, F.concat(F.lit("\nStages: "), "stage_count")),
        F.col("stages"),
        more("stage_count", 5, "  ... and ", " more"),
    )
    section = F.concat_ws(
        "\n",
        F.lit("\n=== ERRORS & WARNINGS ===\n"),
        F.concat(F.lit("Errors ("), "error_count", F.lit("):")),
        F.col("errors"),
        more("error_count", 10, "\n... and ", " more errors"),
        F.when(F.col("warning_count") > 0, F.concat(F.lit("\nWarnings ("), "warning_count", F.lit("):"))),
        F.col("warnings"),
        more("warning_count", 5, "\n... and ", " more warnings"),
    )
    shows_errors = (F.col("error_count") > 0) & F.lit(prioritize_errors)
    return joined.select(
        "log_id",
        F.when(shows_errors, F.concat_ws("\n\n", metadata, section)).otherwise(metadata).alias("head"),
    )


def assemble(
    heads: DataFrame,
    raw_logs: DataFrame,
    error_lines: DataFrame,
    limit: int = fx.CHUNK_TOKENS,
    overlap: int = fx.OVERLAP_LINES,
) -> DataFrame:
    """All chunks of every log: the head, with the whole text if it fits, then the body."""
    text = F.col("raw_content")
    fits = (tokens_in(text) <= limit) & (text != "")
    first = heads.join(raw_logs.select("log_id", "raw_content"), "log_id").select(
        "log_id",
        F.lit(1).cast("bigint").alias("chunk_id"),
        F.when(fits, F.concat_ws("\n\n", "head", "raw_content")).otherwise(F.col("head")).alias("chunk"),
    )
    rest = body_chunks(raw_logs, error_lines, limit, overlap).select(
        "log_id", (F.col("chunk_id") + 1).alias("chunk_id"), "chunk"
    )
    return first.unionByName(rest)
