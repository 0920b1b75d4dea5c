"""The older line rules and their report, for logs of any platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern.functions import line_rules as lr
from loglantern.functions.text import any_case, first_match, strip
from loglantern.operators.ordered import first_rows, log_context

NO_STAGE = "Unknown"


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def legacy_lines(lines: DataFrame) -> DataFrame:
    """Classify stripped lines; errors and warnings are independent, echo lines (null) say nothing."""
    text = F.col("text")
    stripped_line = strip(F.col("raw_line"))
    stripped = (
        lines.withColumn("text", F.when(~stripped_line.startswith(fx.ECHO_START), stripped_line))
        .drop("raw_line")
        .withColumn("opens", first_match(text, fx.LEGACY_STAGE_OPEN))
    )
    told = log_context(stripped, {"stage": F.col("opens")})
    return told.select(
        "*",
        lr.legacy_error(text).alias("is_error"),
        lr.legacy_warning(text).alias("is_warning"),
        lr.legacy_retry(text).alias("is_retry"),
        F.upper(first_match(text, any_case(fx.LEGACY_FINISHED))).alias("mark"),
    )


def telling_lines(facts: DataFrame) -> DataFrame:
    """Lines that open a stage or say something, and the first line of each log."""
    text = F.col("text")
    says = (
        F.col("is_error")
        | F.col("is_warning")
        | F.col("is_retry")
        | F.col("mark").isNotNull()
        | F.col("opens").isNotNull()
        | text.contains("FAILED")
        | text.contains("FAILURE")
    )
    first = F.coalesce(F.col("line_number") == 1, F.lit(True))
    return facts.filter(first | F.coalesce(says, F.lit(False)))


def legacy_stage_rows(facts: DataFrame) -> DataFrame:
    """Counts per (log, stage); errors and warnings before any stage go to ``Unknown``.

    Log totals come from the same rows: ``all_retries`` holds retries outside stages too.
    """
    text, in_stage = F.col("text"), F.col("stage").isNotNull()
    failed = in_stage & (text.contains("FAILED") | text.contains("FAILURE"))
    critical = F.col("is_error") & in_stage & lr.legacy_critical(text)
    return (
        facts.groupBy("log_id", F.coalesce("stage", F.lit(NO_STAGE)).alias("stage"))
        .agg(
            F.sum(_one_if(F.col("is_error"))).alias("errors"),
            F.sum(_one_if(F.col("is_warning"))).alias("warnings"),
            F.sum(_one_if(F.col("is_retry") & in_stage)).alias("retries"),
            F.sum(_one_if(critical)).alias("criticals"),
            F.max(_one_if(failed)).alias("failed"),
            F.min(F.when(F.col("opens").isNotNull(), F.col("line_number"))).alias("opened_at"),
            F.sum(_one_if(F.col("is_retry"))).alias("all_retries"),
        )
    )


def legacy_stages(stage_rows: DataFrame) -> DataFrame:
    """Stages in opening order; a log that opens none lists its ``Unknown`` bucket if it has one."""
    opened = stage_rows.filter(F.col("opened_at").isNotNull())
    bucket = stage_rows.filter(
        F.col("opened_at").isNull() & (F.col("errors") + F.col("warnings") > 0)
    ).join(opened.select("log_id"), "log_id", "left_anti")
    return opened.unionByName(bucket).select(
        "log_id",
        "stage",
        F.coalesce("opened_at", F.lit(0)).cast("bigint").alias("stage_order"),
        F.when(F.col("failed") == 1, "FAILED").otherwise("SUCCESS").alias("status"),
        "errors",
        "warnings",
        "retries",
        "criticals",
    )


def legacy_totals(stage_rows: DataFrame) -> DataFrame:
    return stage_rows.groupBy("log_id").agg(
        F.sum("errors").alias("error_count"),
        F.sum("warnings").alias("warning_count"),
        F.sum("all_retries").alias("retry_count"),
    )


def finished_marks(facts: DataFrame) -> DataFrame:
    """The last ``Finished`` mark of each log that has one."""
    return (
        facts.filter(F.col("mark").isNotNull())
        .groupBy("log_id")
        .agg(F.max_by("mark", "line_number").alias("build_mark"))
    )


def legacy_rollup(totals: DataFrame, marks: DataFrame) -> DataFrame:
    """The log's own status against its mark."""
    own = F.when(F.col("error_count") + F.col("warning_count") > 0, "UNSTABLE").otherwise("SUCCESS")
    mismatch = F.coalesce(F.col("build_mark") != F.col("own_status"), F.lit(False))
    return (
        totals.withColumn("own_status", own)
        .join(marks, "log_id", "left")
        .select(
            "log_id",
            "error_count",
            "warning_count",
            "retry_count",
            F.coalesce("build_mark", F.lit("UNKNOWN")).alias("build_mark"),
            "own_status",
            _one_if(mismatch).cast("bigint").alias("mismatch"),
            F.when(
                mismatch, F.concat(F.lit("   (⚠ Mismatch: Summary marked "), "own_status", F.lit(")"))
            )
            .otherwise("")
            .alias("mismatch_note"),
        )
    )


def retry_types(facts: DataFrame) -> DataFrame:
    """Retries per log and type; ``first_line`` gives the order of first appearance."""
    return (
        facts.filter(F.col("is_retry"))
        .select("log_id", "line_number", lr.retry_type(F.col("text")).alias("retry_type"))
        .groupBy("log_id", "retry_type")
        .agg(F.count("*").alias("retries"), F.min("line_number").alias("first_line"))
    )


def top_texts(facts: DataFrame, flag: str, prefix: str, n: int) -> DataFrame:
    """The first ``n`` distinct texts with the prefix, in order of first appearance."""
    distinct = (
        facts.filter(F.col(flag) & F.col("text").startswith(prefix))
        .groupBy("log_id", "text")
        .agg(F.min("line_number").alias("first_line"))
    )
    return first_rows(distinct, "log_id", ["first_line"], n)


def legacy_top(facts: DataFrame, totals: DataFrame) -> DataFrame:
    """Top errors and top warnings with how many more lines there are than shown."""
    parts = []
    for kind, flag, prefix, n in (
        ("error", "is_error", "[ERROR]", fx.LEGACY_TOP_ERRORS),
        ("warning", "is_warning", "[WARNING]", fx.LEGACY_TOP_WARNINGS),
    ):
        top = top_texts(facts, flag, prefix, n)
        shown = top.groupBy("log_id").agg(F.count("*").alias("shown"))
        more = totals.join(shown, "log_id").select(
            "log_id", (F.col(f"{kind}_count") - F.col("shown")).alias("more")
        )
        parts.append(top.join(more, "log_id").withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1]).select("log_id", "kind", "position", "text", "more")


# --- fixed values: report texts ---------------------------------------------------
_ICONS = {"SUCCESS": "🌱 ", "UNSTABLE": "⚠ ", "FAILURE": "❌ "}
_THICK, _THIN = "=" * 49, "-" * 50
_CRITICAL_TAG = "❌ [CRITICAL] "


def _with_icon(status: Column) -> Column:
    icon = None
    for name, sign in _ICONS.items():
        icon = F.when(status == name, sign) if icon is None else icon.when(status == name, sign)
    return F.concat(icon.otherwise(" "), status)


def _numbered(section: int, *texts) -> list[Column]:
    """One struct per report line; plain strings are fixed texts."""
    return [
        F.struct(
            F.lit(section).cast("bigint").alias("section"),
            F.lit(n).cast("bigint").alias("position"),
            (F.lit(t) if isinstance(t, str) else t).alias("text"),
        )
        for n, t in enumerate(texts, start=1)
    ]


def _stage_text() -> Column:
    def note(count: str, before: str, after: str = "") -> Column:
        return F.when(F.col(count) > 0, F.concat(F.lit(before), F.col(count), F.lit(after)))

    notes = F.concat_ws(
        ", ",
        note("warnings", "Warnings: "),
        note("errors", "Errors: "),
        note("retries", "Retries: "),
        note("criticals", "", " CRITICAL"),
    )
    width = F.greatest(F.lit(0), 20 - F.length("stage"))
    padded = F.concat("stage", F.repeat(F.lit(" "), width))
    return F.concat(
        F.lit("- "),
        padded,
        F.lit(": "),
        "status",
        F.when(notes != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(""),
    )


def _error_text() -> Column:
    """A critical text carries the tag once, without dashes and blanks before it."""
    bare = F.ltrim(F.replace(F.col("text"), F.lit(_CRITICAL_TAG), F.lit("")), F.lit("- "))
    return F.concat(
        F.lit("- "),
        F.when(lr.legacy_critical(F.col("text")), F.concat(F.lit(_CRITICAL_TAG), bare)).otherwise(
            F.col("text")
        ),
    )


def legacy_report(
    rollup: DataFrame, retries: DataFrame, stage_rows: DataFrame, top: DataFrame
) -> DataFrame:
    """The text report, one row per report line: read by (section, position) within a log.

    Lines are never gathered per log, so a log with any number of stages is no burden.
    """
    count = {k: F.col(f"{k}_count") for k in ("error", "warning", "retry")}
    issues = count["error"] + count["warning"] > 0
    fixed = rollup.join(
        stage_rows.groupBy("log_id").agg(F.count("*").alias("stages")), "log_id", "left"
    ).join(
        top.groupBy("log_id").pivot("kind", ["error", "warning"]).agg(F.max("more")),
        "log_id",
        "left",
    )

    def tail(kind: str) -> Column:
        more = F.col(kind)
        return F.when(more.isNull(), F.lit("- None")).when(
            more > 0, F.concat(F.lit("... and "), more, F.lit(f" more {kind}s not shown"))
        )

    lines = F.array(
        *_numbered(
            1,
            _THICK,
            " Jenkins Build Summary",
            _THICK,
            F.concat(F.lit("Build Status : "), _with_icon(F.col("own_status"))),
            F.concat(F.lit("Jenkins Mark : "), _with_icon(F.col("build_mark")), "mismatch_note"),
            F.concat(F.lit("Errors       : "), count["error"]),
            F.concat(F.lit("Warnings     : "), count["warning"]),
            F.concat(F.lit("Retries      : "), count["retry"]),
            F.when(count["retry"] > 0, "Retries:"),
        ),
        *_numbered(
            3,
            _THIN,
            "",
            "Stage Summary:",
            F.when(F.col("stages").isNull(), "- No stage info found."),
        ),
        *_numbered(5, "", _THIN, "Top Errors / Failures:"),
        *_numbered(7, tail("error"), "", "Top Warnings:"),
        *_numbered(
            9,
            tail("warning"),
            "",
            _THIN,
            F.concat(
                F.lit("Final Result: Build completed with "),
                F.when(issues, "WARNINGS and ERRORS").otherwise("no issues."),
            ),
            F.when(issues, "⚠ Requires attention before production deployment."),
            _THICK,
        ),
    )
    frame = fixed.select("log_id", F.inline(lines)).filter(F.col("text").isNotNull())

    def section(rows: DataFrame, number: int, order: str, text: Column) -> DataFrame:
        return rows.select(
            "log_id",
            F.lit(number).cast("bigint").alias("section"),
            F.col(order).alias("position"),
            text.alias("text"),
        )

    retry_text = F.concat(F.lit("  - "), "retry_type", F.lit(": "), F.col("retries"))
    return (
        frame.unionByName(section(retries, 2, "first_line", retry_text))
        .unionByName(section(stage_rows, 4, "stage_order", _stage_text()))
        .unionByName(section(top.filter("kind = 'error'"), 6, "position", _error_text()))
        .unionByName(
            section(top.filter("kind = 'warning'"), 8, "position", F.concat(F.lit("- "), "text"))
        )
    )
