"""Lines, stages, entries and log records."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern.functions import line_rules as lr
from loglantern.functions.text import clean_line, strip_colours
from loglantern.operators import parse, reports
from loglantern.plans import duck
from loglantern.plans.duck import FACTS, LINES, STAGES, SUMMARY, any_of, as_int, matches, q, sql
from loglantern.plans.registry import Registry
from loglantern.rules import ACTIONS_BY_GROUP, PIPELINE
from loglantern.session import scratch
from loglantern.sources.raw_logs import read_log_lines, split_lines

registry = Registry()
query = registry.add
QUERIES, ORACLE = registry.queries, registry.oracle

BASE = ("log_id", "line_number")


def flag(column):
    return column.cast("bigint")


@query("log_lines", sql(LINES, "SELECT log_id, line_number, raw_line FROM lines"))
def _(logs):
    return logs.lines.select(*BASE, "raw_line")


@query(
    "text_lines",
    f"""
WITH parts AS (SELECT doc_id AS log_id, string_split_regex(text, {q(fx.LINE_BREAK)}) AS p FROM documents),
kept AS (SELECT log_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM parts)
SELECT log_id, CAST(generate_subscripts(p, 1) AS BIGINT) AS line_number, unnest(p) AS raw_line FROM kept""",
)
def _(logs):
    lines = split_lines(logs.raw_documents)
    return lines.filter(F.col("line_number").isNotNull()).select(*BASE, "raw_line")


@query(
    "file_lines",
    f"""
WITH parts AS (SELECT source, regexp_replace(unnest(string_split(concat(coalesce(text, ''), chr(10)), chr(10))[:-2]), '\\r\\z', '') AS piece
  FROM documents),
split AS (SELECT source, unnest(string_split_regex(piece, {q(fx.LINE_BREAK)})) AS raw_line FROM parts)
SELECT coalesce(source, 'none') AS source, count(*) AS total_lines, count(*) AS last_numbers,
  count(*) FILTER (raw_line = '') AS blank_lines, CAST(sum(length(raw_line)) AS BIGINT) AS chars,
  CAST(sum(CAST(concat('0x', substr(md5(raw_line), 1, 8)) AS BIGINT)) AS BIGINT) AS told
FROM split GROUP BY ALL""",
)
def _(logs):
    """All texts written as text files, a folder per source, and read as logs cut into splits."""
    path = scratch(logs.spark, "files")
    texts = logs.table("documents").select(F.coalesce("source", F.lit("none")).alias("source"), "text")
    texts.write.partitionBy("source").text(path)
    lines = read_log_lines(logs.spark, path)
    per_file = lines.groupBy("log_id").agg(
        F.count("line_number").alias("total_lines"),
        F.max("line_number").alias("last"),
        F.count(F.when(F.col("raw_line") == "", 1)).alias("blank_lines"),
        F.sum(F.length("raw_line")).alias("chars"),
        F.sum(F.conv(F.substring(F.md5("raw_line"), 1, 8), 16, 10).cast("bigint")).alias("told"),
    )
    source = F.url_decode(F.regexp_extract("log_id", "/source=([^/]*)/", 1))
    return per_file.groupBy(source.alias("source")).agg(
        F.sum("total_lines").alias("total_lines"),
        F.sum("last").alias("last_numbers"),
        *[F.sum(c).alias(c) for c in ("blank_lines", "chars", "told")],
    )


@query(
    "clean_lines",
    sql(
        LINES,
        f"""SELECT log_id, line_number, regexp_replace(raw_line, {q(fx.ANSI_COLOUR)}, '', 'g') AS plain,
  {duck.CLEAN} AS clean FROM lines""",
    ),
)
def _(logs):
    line = F.col("raw_line")
    return logs.lines.select(*BASE, strip_colours(line).alias("plain"), clean_line(line).alias("clean"))


_LEVELS = "CASE " + " ".join(
    f"WHEN {any_of('upper(raw_line)', words)} THEN '{name}'" for name, words in fx.LEVEL_WORDS
)


@query("line_levels", sql(LINES, f"SELECT log_id, line_number, {_LEVELS} ELSE 'INFO' END AS level FROM lines"))
def _(logs):
    return logs.lines.select(*BASE, lr.level_of(F.col("raw_line")).alias("level"))


def _flag_query(name, predicate, where):
    @query(name, sql(LINES, f"SELECT log_id, line_number, raw_line FROM lines WHERE {where}"))
    def _(logs):
        return logs.lines.filter(predicate(F.col("raw_line"))).select(*BASE, "raw_line")


_flag_query("echo_lines", lr.is_echo, duck.IS_ECHO)
_flag_query("error_lines", lr.is_error, duck.IS_ERROR)
_flag_query("warning_lines", lr.is_warning, duck.IS_WARNING)
_flag_query("retry_lines", lr.is_retry, duck.IS_RETRY)
_flag_query("legacy_error_lines", lr.legacy_error, matches("raw_line", fx.LEGACY_ERROR))
_flag_query("legacy_warning_lines", lr.legacy_warning, matches("raw_line", fx.LEGACY_WARNING))
_flag_query("legacy_retry_lines", lr.legacy_retry, matches("raw_line", fx.LEGACY_RETRY))
_flag_query("legacy_critical_lines", lr.legacy_critical, matches("raw_line", fx.LEGACY_CRITICAL))


@query(
    "line_kinds",
    sql(FACTS, f"SELECT log_id, line_number, kind, {as_int('is_retry')} AS is_retry FROM facts"),
)
def _(logs):
    return logs.facts.select(*BASE, "kind", flag(F.col("is_retry")).alias("is_retry"))


@query("platform_detect", sql(FACTS, "SELECT log_id, platform FROM marks"))
def _(logs):
    return logs.counts.select("log_id", "platform")


@query("current_stage", sql(FACTS, "SELECT log_id, line_number, stage, context FROM facts"))
def _(logs):
    return logs.facts.select(*BASE, "stage", "context")


@query("annotations", sql(FACTS, """SELECT log_id, line_number, kind, level, message FROM facts
  WHERE error_note IS NOT NULL OR warning_note IS NOT NULL"""))
def _(logs):
    noted = F.col("raw_line").contains("::error::") | F.col("raw_line").contains("::warning::")
    on_actions = F.col("rule") == 1
    return logs.facts.filter(on_actions & noted).select(*BASE, "kind", "level", "message")


@query("entries", sql(FACTS, "SELECT log_id, line_number, kind, level, message, raw_line FROM entries"))
def _(logs):
    return logs.entries.select(*BASE, "kind", "level", "message", "raw_line")


_STAGE_COLUMNS = "log_id, stage, error_count, warning_count, retry_count, critical_count"
_STAGE_NAMES = _STAGE_COLUMNS.split(", ")
_PIPELINE_LOGS = "log_id IN (SELECT log_id FROM marks WHERE platform = '{}')"


def _stages_of(name, columns, platform):
    chosen = ", ".join(columns)
    where = _PIPELINE_LOGS.format(platform)

    @query(name, sql(STAGES, f"SELECT {chosen} FROM stages WHERE {where}"))
    def _(logs):
        position = 0 if platform == PIPELINE.platform else 1
        return parse.stages(logs.rolled.filter(F.col("rule") == position)).select(*columns)


_stages_of("stage_counts", _STAGE_NAMES, "jenkins")
_stages_of("stage_status", ["log_id", "stage", "stage_order", "status"], "jenkins")
_stages_of("step_counts", _STAGE_NAMES, "github-actions")
_stages_of("step_status", ["log_id", "stage", "stage_order", "status"], "github-actions")


@query("step_counts_by_group", sql(FACTS, """SELECT log_id, stage,
  CAST(count(*) FILTER (kind = 'error') AS BIGINT) AS error_count,
  CAST(count(*) FILTER (kind = 'warning') AS BIGINT) AS warning_count,
  CAST(count(*) FILTER (is_retry) AS BIGINT) AS retry_count
  FROM facts WHERE platform = 'github-actions' AND stage IS NOT NULL GROUP BY ALL"""))
def _(logs):
    rules = (PIPELINE, ACTIONS_BY_GROUP)
    rolled = parse.roll_up(parse.read_lines(logs.lines, rules), rules)
    return parse.stages(rolled.filter(F.col("rule") == 1)).select(
        "log_id", "stage", "error_count", "warning_count", "retry_count"
    )


@query("build_status", sql(SUMMARY, "SELECT log_id, platform, found_status, status FROM summary"))
def _(logs):
    return logs.counts.select("log_id", "platform", "found_status", "status")


@query("triggered_by", sql(SUMMARY, "SELECT log_id, triggered_by FROM summary WHERE triggered_by IS NOT NULL"))
def _(logs):
    return parse.log_headers(logs.lines).filter("triggered_by IS NOT NULL").select("log_id", "triggered_by")


@query(
    "duration",
    sql(SUMMARY, "SELECT log_id, duration_seconds FROM summary WHERE duration_seconds IS NOT NULL"),
)
def _(logs):
    headers = parse.log_headers(logs.lines)
    return headers.filter("duration_seconds IS NOT NULL").select("log_id", "duration_seconds")


_SUMMARY_COLUMNS = """log_id, platform, job_name, build_number, status, duration_seconds, triggered_by,
  total_lines, stage_count, failed_stage_count, error_count, warning_count, retry_count, critical_count"""


# what the caller tells of a build, for logs of a known platform
_TOLD = """CASE WHEN platform <> 'unknown' THEN concat('https://builds.example/', log_id) END AS build_url,
  CASE WHEN platform <> 'unknown' THEN CASE WHEN log_id % 5 = 0 THEN 'main' ELSE concat('topic-', log_id % 5) END END
    AS branch,
  CASE WHEN platform <> 'unknown' THEN substring(md5(CAST(log_id AS VARCHAR)), 1, 12) END AS commit,
  CASE WHEN platform <> 'unknown' AND log_id % 4 = 2 THEN concat('flow-', log_id % 3) END AS workflow,
  CASE WHEN platform <> 'unknown' AND log_id % 4 = 2 THEN CAST(log_id * 100 AS VARCHAR) END AS run_id"""


@query("log_summary", sql(SUMMARY, f"SELECT {_SUMMARY_COLUMNS}, {_TOLD} FROM summary"))
def _(logs):
    columns = [c.strip() for c in _SUMMARY_COLUMNS.split(",")]
    return logs.summary.select(*columns, "build_url", "branch", "commit", "workflow", "run_id")


@query("quick_summary", sql(SUMMARY, """SELECT log_id, platform, status, job_name, build_number,
  duration_seconds AS duration, stage_count AS stages, error_count AS errors,
  warning_count AS warnings, retry_count AS retries FROM summary"""))
def _(logs):
    return parse.quick_summary(logs.summary)


_EFFECTIVE = "CASE WHEN status = 'SUCCESS' AND error_count > 0 THEN 'UNSTABLE' ELSE status END"


@query("effective_status", sql(SUMMARY, f"SELECT log_id, status, {_EFFECTIVE} AS effective_status FROM summary"))
def _(logs):
    return reports.with_effective_status(logs.counts).select("log_id", "status", "effective_status")


@query("verdict", sql(SUMMARY, """SELECT log_id,
  CASE WHEN error_count > 0 THEN concat('Build has ', error_count, ' error(s)',
      CASE WHEN warning_count > 0 THEN concat(' and ', warning_count, ' warning(s)') ELSE '' END)
    WHEN warning_count > 0 THEN concat('Build completed with ', warning_count, ' warning(s)')
    ELSE 'Build completed successfully!' END AS verdict,
  CASE WHEN error_count > 0 THEN 'Action required before deployment.'
    WHEN warning_count > 0 THEN 'Review warnings before production deployment.'
    ELSE 'No errors or warnings detected. Safe to deploy.' END AS action FROM summary"""))
def _(logs):
    return reports.verdicts(logs.counts)


@query("verdict_stages", sql(SUMMARY, """SELECT log_id,
  concat('Failed stages: ', string_agg(stage, ', ' ORDER BY stage_order)) AS failed_stages
  FROM stages s JOIN (SELECT log_id FROM summary WHERE error_count > 0) USING (log_id)
  WHERE status = 'FAILED' GROUP BY log_id"""))
def _(logs):
    logs = logs.written()
    return reports.verdict_stages(logs.counts, logs.stages)


@query("failed_stages", sql(STAGES, "SELECT log_id, stage, stage_order FROM stages WHERE status = 'FAILED'"))
def _(logs):
    return parse.failed_stages(logs.stages).select("log_id", "stage", "stage_order")


@query(
    "critical_entries",
    sql(FACTS, "SELECT log_id, line_number, message FROM entries WHERE level = 'CRITICAL'"),
)
def _(logs):
    return parse.critical_entries(logs.entries).select(*BASE, "message")


_RANKED = FACTS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY log_id, kind ORDER BY line_number) AS position
  FROM entries)"""


@query("top_entries", sql(_RANKED, """SELECT log_id, kind, position, line_number, message
  FROM ranked WHERE position <= 10"""))
def _(logs):
    errors = parse.first_entries(logs.entries, "error", fx.TOP_ENTRIES)
    warnings = parse.first_entries(logs.entries, "warning", fx.TOP_ENTRIES)
    return errors.unionByName(warnings).select("log_id", "kind", "position", "line_number", "message")


@query("first_errors", sql(_RANKED, """SELECT log_id, line_number, level, message
  FROM ranked WHERE kind = 'error' AND position = 1"""))
def _(logs):
    return parse.first_entries(logs.entries, "error", 1).select(*BASE, "level", "message")


@query("nested_entries", sql(FACTS, """SELECT log_id, count(*) FILTER (kind = 'error') AS errors,
  count(*) FILTER (kind = 'warning') AS warnings,
  string_agg(concat(line_number, ':', level), ',' ORDER BY line_number) FILTER (kind = 'error') AS error_list
  FROM entries GROUP BY log_id"""))
def _(logs):
    nested = reports.nested_entries(logs.entries)
    listed = F.array_join(
        F.transform("errors", lambda e: F.concat(e["line_number"], F.lit(":"), e["level"])), ","
    )
    return nested.select(
        "log_id",
        F.size("errors").cast("bigint").alias("errors"),
        F.size("warnings").cast("bigint").alias("warnings"),
        F.nullif(listed, F.lit("")).alias("error_list"),
    )
