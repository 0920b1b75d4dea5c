"""Views for readers: headers, stages, entries, verdicts, Markdown and JSON.

Reports are tables of lines in the order of (section, position); a log's lines are
never gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern.functions.line_rules import effective_status
from loglantern.operators.parse import first_entries



def _or(value: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(value), F.lit("")), F.lit(other))


def with_effective_status(summary: DataFrame) -> DataFrame:
    return summary.withColumn(
        "effective_status", effective_status(F.col("status"), F.col("error_count"))
    )


def report_headers(summary: DataFrame) -> DataFrame:
    # a duration of zero and an empty trigger are not shown
    duration = F.when(
        F.col("duration_seconds") != 0, F.concat(F.format_string("%.1f", "duration_seconds"), F.lit("s"))
    )
    return with_effective_status(summary).select(
        "log_id",
        F.concat(F.upper("platform"), F.lit(" - "), _or("job_name", "Unknown Job")).alias("title"),
        _or("build_number", "N/A").alias("build"),
        "effective_status",
        duration.alias("duration"),
        F.nullif(F.col("triggered_by"), F.lit("")).alias("triggered_by"),
        "total_lines",
        "stage_count",
        "error_count",
        "warning_count",
        F.when(F.col("retry_count") > 0, F.col("retry_count")).alias("retries_shown"),
    )


def summary_table(summary: DataFrame) -> DataFrame:
    return with_effective_status(summary).select(
        "log_id",
        "platform",
        _or("job_name", "Unknown").alias("job_name"),
        _or("build_number", "N/A").alias("build_number"),
        "effective_status",
        F.col("stage_count").alias("stages"),
        F.col("error_count").alias("errors"),
        F.col("warning_count").alias("warnings"),
        F.when(F.col("retry_count") > 0, F.col("retry_count")).alias("retries"),
    )


def report_stages(stage_rows: DataFrame) -> DataFrame:
    def note(count: str, word: str) -> Column:
        return F.when(F.col(count) > 0, F.concat(F.col(count), F.lit(f" {word}")))

    details = F.concat_ws(
        ", ",
        note("error_count", "errors"),
        note("warning_count", "warnings"),
        note("retry_count", "retries"),
    )
    label = F.concat(
        "stage",
        F.lit(" - "),
        "status",
        F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise(""),
    )
    return stage_rows.select("log_id", "stage_order", "stage", label.alias("label"))


def report_entries(entry_rows: DataFrame, show_all: bool = False) -> DataFrame:
    """Errors and warnings as shown: the first ten of each, messages cut to their width."""
    width = F.when(F.col("kind") == "error", fx.ERROR_MESSAGE_CHARS).otherwise(fx.WARNING_MESSAGE_CHARS)
    columns = ["log_id", "kind", "line_number", "level", F.col("message").substr(F.lit(1), width).alias("message")]
    if show_all:
        return entry_rows.select(*columns)
    errors = first_entries(entry_rows, "error", fx.TOP_ENTRIES)
    warnings = first_entries(entry_rows, "warning", fx.TOP_ENTRIES)
    return errors.unionByName(warnings).select(*columns)


# --- fixed values: the wording of the texts made below is what readers of them expect ---
def verdicts(counts: DataFrame) -> DataFrame:
    errors, warnings = F.col("error_count"), F.col("warning_count")
    text = (
        F.when(
            errors > 0,
            F.concat(
                F.lit("Build has "),
                errors,
                F.lit(" error(s)"),
                F.when(warnings > 0, F.concat(F.lit(" and "), warnings, F.lit(" warning(s)"))).otherwise(""),
            ),
        )
        .when(warnings > 0, F.concat(F.lit("Build completed with "), warnings, F.lit(" warning(s)")))
        .otherwise("Build completed successfully!")
    )
    action = (
        F.when(errors > 0, "Action required before deployment.")
        .when(warnings > 0, "Review warnings before production deployment.")
        .otherwise("No errors or warnings detected. Safe to deploy.")
    )
    return counts.select("log_id", text.alias("verdict"), action.alias("action"))


def verdict_stages(counts: DataFrame, stage_rows: DataFrame) -> DataFrame:
    """The failed stages a verdict with errors names, in one text per log.

    A log has as many entries here as it names different stages.
    """
    names = stage_rows.filter(F.col("status") == "FAILED").groupBy("log_id").agg(
        F.sort_array(F.collect_list(F.struct("stage_order", "stage"))).alias("items")
    )
    text = F.array_join(F.transform("items", lambda i: i["stage"]), ", ")
    return names.join(counts.filter(F.col("error_count") > 0).select("log_id"), "log_id", "left_semi").select(
        "log_id", F.concat(F.lit("Failed stages: "), text).alias("failed_stages")
    )


def markdown_report(summary: DataFrame, stage_rows: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """Markdown, one row per line: ``log_id, section, position, text``."""
    head = [
        F.lit("# Log Analysis Report"),
        F.lit(""),
        F.concat(F.lit("**Platform:** "), "platform"),
        F.concat(F.lit("**Job:** "), _or("job_name", "Unknown")),
        F.concat(F.lit("**Status:** "), "status"),
        F.concat(F.lit("**Build Number:** "), _or("build_number", "N/A")),
        F.lit(""),
        F.lit("## Statistics"),
        F.concat(F.lit("- Total Lines: "), "total_lines"),
        F.concat(F.lit("- Errors: "), "error_count"),
        F.concat(F.lit("- Warnings: "), "warning_count"),
        F.concat(F.lit("- Retries: "), "retry_count"),
        F.concat(F.lit("- Stages: "), "stage_count"),
        F.lit(""),
        F.when(F.col("stage_count") > 0, "## Stages"),
    ]
    frame = F.array(
        *[_report_line(1, F.lit(n), text) for n, text in enumerate(head, start=1)],
        _report_line(3, F.lit(1), F.when(F.col("error_count") > 0, "\n## Top Errors")),
    )
    frame_rows = summary.select("log_id", F.inline(frame)).filter(F.col("text").isNotNull())
    stage_text = F.concat(F.lit("- **"), "stage", F.lit("**: "), "status")
    error_text = F.concat(F.lit("- Line "), "line_number", F.lit(": "), "message")
    top = first_entries(entry_rows, "error", fx.MARKDOWN_ERRORS)
    return frame_rows.unionByName(
        stage_rows.select("log_id", F.inline(F.array(_report_line(2, F.col("stage_order"), stage_text))))
    ).unionByName(top.select("log_id", F.inline(F.array(_report_line(4, F.col("position"), error_text)))))


def _report_line(section: int, position: Column, text: Column) -> Column:
    return F.struct(
        F.lit(section).cast("bigint").alias("section"),
        position.cast("bigint").alias("position"),
        text.alias("text"),
    )


def parsed_json(summary: DataFrame, stage_rows: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """Parsed logs as JSON records: the log itself, its stages and its entries.

    One record per row, told apart by ``record``; together they hold what a nested
    document would, without gathering a log's entries into one value.
    """

    def records(rows: DataFrame, kind: str, order: Column) -> DataFrame:
        body = F.to_json(F.struct(*[c for c in rows.columns if c not in ("log_id", "slice")]))
        return rows.select(
            "log_id", F.lit(kind).alias("record"), order.cast("bigint").alias("position"), body.alias("json")
        )

    return (
        records(summary, "log", F.lit(0))
        .unionByName(records(stage_rows, "stage", F.col("stage_order")))
        .unionByName(records(entry_rows, "entry", F.col("line_number")))
    )


def nested_entries(entry_rows: DataFrame) -> DataFrame:
    """Entry lists, one row per log: the nested form, which holds a whole log's entries as one value."""
    items = F.struct("line_number", "level", "message", "raw_line")

    def ordered(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, items)))

    return entry_rows.groupBy("log_id").agg(
        ordered("error").alias("errors"), ordered("warning").alias("warnings")
    )


def parsed_documents(summary: DataFrame, stage_rows: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """One JSON document per log in pieces: (log_id, section, position, text).

    The pieces of a log in the order of (section, position) spell the object of its summary
    with the lists ``stages``, ``errors`` and ``warnings``, so no list of a log is ever one
    value.  Within a list, a piece after the first begins with a comma; the window that
    tells them looks one piece back.  Every log of the summary has a document.
    """
    fields = F.struct(*[c for c in summary.columns if c not in ("log_id", "slice")]).alias("log")
    opened = F.to_json(F.struct("log_id", fields))
    head = F.concat(F.left(opened, F.length(opened) - 1), F.lit(',"stages":['))
    frame = [(0, head), (2, F.lit('],"errors":[')), (4, F.lit('],"warnings":[')), (6, F.lit("]}\n"))]
    pieces = summary.select(
        "log_id", F.inline(F.array(*[_report_line(section, F.lit(0), text) for section, text in frame]))
    )

    def items(rows: DataFrame, section: Column, order: str) -> DataFrame:
        body = F.struct(*[c for c in rows.columns if c not in ("log_id", "slice", "kind")])
        return rows.select(
            "log_id",
            section.cast("bigint").alias("section"),
            F.col(order).cast("bigint").alias("position"),
            F.to_json(body).alias("text"),
        )

    listed = items(stage_rows, F.lit(1), "stage_order").unionByName(
        items(entry_rows, F.when(F.col("kind") == "error", 3).otherwise(5), "line_number")
    )
    every = pieces.unionByName(listed)
    before = F.lag("section").over(Window.partitionBy("log_id").orderBy("section", "position"))
    comma = (F.col("section") % 2 == 1) & (before == F.col("section"))
    return every.select(
        "log_id", "section", "position", F.concat(F.when(comma, F.lit(",")).otherwise(F.lit("")), "text").alias("text")
    )
