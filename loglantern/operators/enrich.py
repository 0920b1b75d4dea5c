"""Tables for enrichment by a language model: candidates, prompts and rule-based answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern import prompt_texts as pt
from loglantern.functions import line_rules as lr
from loglantern.operators.parse import first_entries, neighbours, stage_context


def fill(template: str, places: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced by a column."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[places[p].cast("string") if n % 2 else F.lit(p) for n, p in enumerate(parts) if p]
    )


def first_chars(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` characters of each log's text, from its lines.

    Every line but the last adds at least its line feed, so lines past ``n + 1`` are
    out; of the rest only those that start within the text are gathered.
    """
    chars = F.length("raw_line") + 1
    earlier = (
        Window.partitionBy("log_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    )
    near = (
        lines.filter((F.col("line_number") <= n + 1))
        .select("log_id", "line_number", chars.alias("chars"), F.substring("raw_line", 1, n).alias("text"))
        .withColumn("starts", F.coalesce(F.sum("chars").over(earlier), F.lit(0)))
        .filter(F.col("starts") <= n)
    )
    ordered = F.sort_array(F.collect_list(F.struct("line_number", "text")))
    joined = F.concat_ws("\n", F.transform(ordered, lambda e: e["text"]))
    return near.groupBy("log_id").agg(F.substring(joined, 1, n).alias("first_text"))


def log_sizes(lines: DataFrame) -> DataFrame:
    """Characters of the text (lines joined by line feeds), token and chunk estimates."""
    chars = F.sum(F.length("raw_line") + 1) - 1
    tokens = F.floor(F.col("chars") / fx.CHARS_PER_TOKEN).cast("bigint")
    return (
        lines.groupBy("log_id")
        .agg(F.coalesce(chars, F.lit(0)).cast("bigint").alias("chars"))
        .select(
            "log_id",
            "chars",
            tokens.alias("tokens"),
            F.greatest(F.lit(1), F.ceil(tokens / fx.CHUNK_TOKENS)).cast("bigint").alias("chunks"),
        )
    )


def _job(job_name: Column) -> Column:
    return F.coalesce(F.nullif(job_name, F.lit("")), F.lit("Unknown"))


def summary_prompts(summary: DataFrame, lines: DataFrame, size: int = 5000) -> DataFrame:
    """One prompt per log with the first characters of its text."""
    text = F.coalesce("first_text", F.lit(""))
    prompt = fill(
        pt.SUMMARY_PROMPT,
        {
            "platform": F.col("platform"),
            "job_name": _job(F.col("job_name")),
            "status": F.col("status"),
            "error_count": F.col("error_count"),
            "warning_count": F.col("warning_count"),
            "duration": F.lit("Unknown"),  # the parsed record has no field of that name
            "log_size": F.length(text),
            "log_content": text,
        },
    )
    return summary.join(first_chars(lines, size), "log_id", "left").select("log_id", prompt.alias("prompt"))


def candidates(entry_rows: DataFrame, per_log: int) -> DataFrame:
    """The first errors of each log, to explain or to fix."""
    return first_entries(entry_rows, "error", per_log)


def first_errors(entry_rows: DataFrame) -> DataFrame:
    return candidates(entry_rows, 1).drop("position")


def explain_prompts(
    chosen: DataFrame, summary: DataFrame, stage_rows: DataFrame
) -> DataFrame:
    context = F.concat(
        F.lit("Total errors: "),
        "error_count",
        F.lit("\n"),
        F.when(
            F.coalesce("triggered_by", F.lit("")) != "",
            F.concat(F.lit("Triggered by: "), "triggered_by", F.lit("\n")),
        ).otherwise(""),
    )
    prompt = fill(
        pt.EXPLAIN_PROMPT,
        {
            "platform": F.col("platform"),
            "error_type": lr.error_type(F.col("message")),
            "line_number": F.col("line_number"),
            "error_message": F.col("message"),
            "job_name": _job(F.col("job_name")),
            "stage_name": F.coalesce("error_stage", F.lit("Unknown")),
            "previous_stages": F.coalesce("previous_stages", F.lit("None")),
            "additional_context": context,
        },
    )
    return (
        chosen.join(summary, "log_id")
        .join(stage_context(stage_rows), "log_id", "left")
        .select("log_id", "line_number", prompt.alias("prompt"))
    )


def error_details(near: DataFrame) -> Column:
    """Where the error is, what it says and which errors are near it."""
    others = F.transform(
        F.col("near"),
        lambda e: F.concat(F.lit("  Line "), e["near_line"], F.lit(": "), e["near_message"], F.lit("\n")),
    )
    return F.concat(
        F.lit("Error at line "),
        "line_number",
        F.lit(":\n"),
        "message",
        F.lit("\n\n"),
        F.when(
            F.size("near") > 0, F.concat(F.lit("Related errors nearby:\n"), F.array_join(others, ""))
        ).otherwise(""),
    )


def fix_prompts(
    entry_rows: DataFrame, summary: DataFrame, stage_rows: DataFrame, per_log: int = fx.FIX_PER_LOG
) -> DataFrame:
    """Prompts for the first errors of each log.

    The errors shown near an error come first among its neighbours, so those of the first
    ``per_log`` are among the first few of the log, and no others are looked at.
    """
    few = candidates(entry_rows, per_log + fx.NEIGHBOURS_SHOWN - 1)
    near = neighbours(few, carry=("level", "position")).filter(F.col("position") <= per_log)
    prompt = fill(
        pt.FIX_PROMPT,
        {
            "error_summary": F.concat(F.lit("["), "level", F.lit("] "), "message"),
            "platform": F.col("platform"),
            "job_name": _job(F.col("job_name")),
            "environment": lr.environment_of(F.col("job_name")),
            "failed_stage": F.coalesce("failed_stage", F.lit("Unknown")),
            "error_details": error_details(near),
            "stack_trace": lr.stack_frames(F.col("message")),
        },
    )
    return (
        near.join(summary, "log_id")
        .join(stage_context(stage_rows), "log_id", "left")
        .select("log_id", "line_number", prompt.alias("prompt"))
    )


def ranking_prompts(entry_rows: DataFrame, summary: DataFrame, per_log: int = fx.TOP_ENTRIES) -> DataFrame:
    """One prompt per log with errors, listing its first errors."""
    item = F.concat(F.col("position"), F.lit(". Line "), F.col("line_number"), F.lit(": "), F.col("message"))
    listed = (
        candidates(entry_rows, per_log)
        .groupBy("log_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", item.alias("item")))).alias("items"))
        .select("log_id", F.concat_ws("\n", F.transform("items", lambda i: i["item"])).alias("errors_list"))
    )
    prompt = fill(
        pt.RANKING_PROMPT,
        {
            "platform": F.col("platform"),
            "job_name": _job(F.col("job_name")),
            "error_count": F.col("error_count"),
            "errors_list": F.col("errors_list"),
        },
    )
    return summary.join(listed, "log_id").select("log_id", prompt.alias("prompt"))


def previous_success(builds: DataFrame, job: str, build: str, slice_rows: int) -> DataFrame:
    """Each failed build of a job with the latest successful build before it.

    Jobs with very many builds are cut into runs of build numbers; what a run needs of
    the earlier ones is one row per run.
    """
    run = F.floor(F.col(build) / slice_rows)
    rows = builds.withColumn("run", run).withColumn(
        "good", F.when(F.col("status") == "SUCCESS", F.col(build))
    )
    before = Window.partitionBy(job, "run").orderBy(build).rowsBetween(Window.unboundedPreceding, -1)
    runs_before = Window.partitionBy(job).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    per_run = (
        rows.groupBy(job, "run")
        .agg(F.max("good").alias("last_good"))
        .select(job, "run", F.max("last_good").over(runs_before).alias("earlier_good"))
    )
    return (
        rows.withColumn("near_good", F.max("good").over(before))
        .join(per_run, [job, "run"], "left")
        .withColumn("success_build", F.coalesce("near_good", "earlier_good"))
        .filter((F.col("status") == "FAILED") & F.col("success_build").isNotNull())
        .drop("run", "good", "near_good", "earlier_good")
    )


def comparison_prompts(
    builds: DataFrame, entry_rows: DataFrame, slice_rows: int, per_log: int = fx.FIX_PER_LOG
) -> DataFrame:
    """A failed build against the successful one before it.

    ``builds`` has ``log_id, job, build, status, error_count, warning_count``.
    """
    pairs = previous_success(builds, "job", "build", slice_rows)
    item = F.concat(F.lit("- Line "), F.col("line_number"), F.lit(": "), F.col("message"))
    errors = (
        candidates(entry_rows, per_log)
        .groupBy("log_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", item.alias("item")))).alias("items"))
        .select("log_id", F.concat_ws("\n", F.transform("items", lambda i: i["item"])).alias("failed_errors"))
    )
    good = builds.select(
        "job",
        F.col("build").alias("success_build"),
        F.concat(
            F.col("error_count"), F.lit(" error(s), "), F.col("warning_count"), F.lit(" warning(s)")
        ).alias("success_summary"),
    )
    prompt = fill(
        pt.COMPARISON_PROMPT,
        {
            "failed_build_number": F.col("build"),
            "failed_status": F.col("status"),
            "failed_errors": F.coalesce("failed_errors", F.lit("None")),
            "success_build_number": F.col("success_build"),
            "success_summary": F.col("success_summary"),
            "git_changes": F.lit("Not available"),
        },
    )
    return (
        pairs.join(errors, "log_id", "left")
        .join(good, ["job", "success_build"])
        .select("log_id", "success_build", prompt.alias("prompt"))
    )


# --- fixed values: the wording of the texts made below is what readers of them expect ---
def fallback_summaries(summary: DataFrame, entry_rows: DataFrame, shown: int = 3) -> DataFrame:
    """Status, main issue, key points and impact of every log without asking a model."""
    point = F.concat(F.lit("Line "), F.col("line_number"), F.lit(": "), F.substring("message", 1, 100))
    points = (
        candidates(entry_rows, shown)
        .groupBy("log_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", point.alias("point")))).alias("items"))
        .select("log_id", F.transform("items", lambda i: i["point"]).alias("key_points"))
    )
    errors, warnings = F.col("error_count"), F.col("warning_count")
    issue = (
        F.when(
            errors > 0,
            F.concat(
                F.lit("Build failed with "), errors, F.lit(" error(s) and "), warnings, F.lit(" warning(s)")
            ),
        )
        .when(warnings > 0, F.concat(F.lit("Build completed with "), warnings, F.lit(" warning(s)")))
        .otherwise("Build completed successfully")
    )
    return summary.join(points, "log_id", "left").select(
        "log_id",
        "status",
        issue.alias("main_issue"),
        F.coalesce("key_points", F.array(F.lit(pt.FALLBACK_KEY_POINT))).alias("key_points"),
        lr.impact_of(errors).alias("impact"),
        F.lit(pt.FALLBACK_SUMMARY_CONFIDENCE).cast("bigint").alias("confidence"),
    )


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fallback_explanations(chosen: DataFrame) -> DataFrame:
    return chosen.select(
        "log_id",
        "line_number",
        F.col("message").alias("error_message"),
        F.concat(
            F.lit("This appears to be a "),
            lr.error_type(F.col("message")),
            F.lit(". Review the error message for details."),
        ).alias("root_cause"),
        _texts(pt.FALLBACK_SCENARIOS).alias("common_scenarios"),
        F.lit(pt.FALLBACK_DETAILS).alias("technical_details"),
        F.array().cast("array<string>").alias("related_errors"),
        F.lit(pt.FALLBACK_EXPLANATION_CONFIDENCE).cast("bigint").alias("confidence"),
    )


def fallback_fixes(chosen: DataFrame) -> DataFrame:
    return chosen.select(
        "log_id",
        "line_number",
        F.concat(F.lit("Error: "), F.substring("message", 1, 100)).alias("diagnosis"),
        F.lit(None).cast("string").alias("quick_fix"),
        _texts(pt.FALLBACK_STEPS).alias("detailed_steps"),
        F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<string>")
        ).alias("code_changes"),
        _texts(pt.FALLBACK_TIPS).alias("prevention_tips"),
        F.lit(pt.FALLBACK_VERIFICATION).alias("verification"),
        F.lit(pt.FALLBACK_FIX_CONFIDENCE).cast("bigint").alias("confidence"),
    )


SUMMARY_FIELDS = ("main_issue", "key_points", "impact", "confidence")


def enriched_logs(
    summary: DataFrame, rules: DataFrame, answers: DataFrame, memo_rows: DataFrame, type_name: str = "summaries"
) -> DataFrame:
    """One record per log: the stored result if the memo has one, else the model's answer, else the rules'.

    ``summary`` has the parsed fields, ``log_id`` and ``key`` (the memo's key of the log's
    text); ``rules`` and ``answers`` have ``log_id`` and the summary fields, ``answers`` one
    row per log at most; ``memo_rows`` are live entries ``cache_type, key, value``, the value
    being the summary fields as JSON.
    """
    kinds = {name: rules.schema[name].dataType.simpleString() for name in SUMMARY_FIELDS}
    shape = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    stored = memo_rows.filter(F.col("cache_type") == type_name).select("key", F.from_json("value", shape).alias("memo"))
    told = F.struct(*SUMMARY_FIELDS)
    met = (
        summary.join(stored, "key", "left")
        .join(answers.select("log_id", told.alias("answer")), "log_id", "left")
        .join(rules.select("log_id", told.alias("rule")), "log_id", "left")
    )
    source = F.when(F.col("memo").isNotNull(), "memo").when(F.col("answer").isNotNull(), "answer").otherwise("rule")
    chosen = F.coalesce("memo", "answer", "rule")
    return met.select(
        *[c for c in summary.columns if c != "key"],
        "key",
        source.alias("source"),
        *[chosen[name].alias(name) for name in SUMMARY_FIELDS],
    )


def to_store(records: DataFrame, written_at: Column, type_name: str = "summaries") -> DataFrame:
    """What a run adds to the memo: the records that did not come from it."""
    fresh = records.filter(F.col("source") != "memo")
    return fresh.select(
        F.lit(type_name).alias("cache_type"),
        "key",
        written_at.alias("written_at"),
        F.xxhash64("key").alias("write_id"),
        F.to_json(F.struct(*SUMMARY_FIELDS)).alias("value"),
    )


def listed(rows: DataFrame, columns, separator: str = " | ") -> DataFrame:
    """Lists as text, for flat outputs."""
    return rows.select(
        *[F.array_join(c, separator).alias(c) if c in columns else F.col(c) for c in rows.columns]
    )
