"""The older rules and their report, and the reader views of the newer ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglantern.operators import legacy, reports
from loglantern.plans.duck import FACTS, LEGACY, LEGACY_TOP, STAGES, SUMMARY, matches, q, sql
from loglantern.plans.line_queries import _RANKED
from loglantern.plans.registry import Registry
from loglantern.session import scratch
from loglantern.sources import sinks

registry = Registry()
query = registry.add
QUERIES, ORACLE = registry.queries, registry.oracle


@query("legacy_counts", sql(LEGACY, "SELECT log_id, error_count, warning_count, retry_count FROM legacy_totals"))
def _(logs):
    return logs.legacy_totals


@query("legacy_stage_counts", sql(LEGACY, "SELECT * FROM legacy_stages"))
def _(logs):
    return legacy.legacy_stages(logs.legacy_rows)


@query("legacy_rollup", sql(LEGACY, "SELECT * FROM legacy_rollup"))
def _(logs):
    return logs.legacy_rollup


@query("retry_types", sql(LEGACY_TOP, "SELECT log_id, retry_type, retries, first_line FROM retry_types"))
def _(logs):
    return legacy.retry_types(logs.legacy_facts)


@query("legacy_top", sql(LEGACY_TOP, "SELECT log_id, kind, position, text, more FROM legacy_top"))
def _(logs):
    return legacy.legacy_top(logs.legacy_facts, logs.legacy_totals)


@query("distinct_error_texts", sql(LEGACY, """SELECT log_id, text, min(line_number) AS first_line
  FROM legacy_facts WHERE is_error GROUP BY ALL"""))
def _(logs):
    return (
        logs.legacy_facts.filter("is_error")
        .groupBy("log_id", "text")
        .agg(F.min("line_number").alias("first_line"))
    )


def _icon(status: str) -> str:
    return (
        f"concat(CASE {status} WHEN 'SUCCESS' THEN '🌱 ' WHEN 'UNSTABLE' THEN '⚠ '"
        f" WHEN 'FAILURE' THEN '❌ ' ELSE ' ' END, {status})"
    )


def _more(kind: str) -> str:
    return f"""CASE WHEN {kind} IS NULL THEN '- None'
      WHEN {kind} > 0 THEN concat('... and ', {kind}, ' more {kind}s not shown') END"""


_FRAME = [
    (1, 1, "repeat('=', 49)"),
    (1, 2, "' Jenkins Build Summary'"),
    (1, 3, "repeat('=', 49)"),
    (1, 4, f"concat('Build Status : ', {_icon('own_status')})"),
    (1, 5, f"concat('Jenkins Mark : ', {_icon('build_mark')}, mismatch_note)"),
    (1, 6, "concat('Errors       : ', error_count)"),
    (1, 7, "concat('Warnings     : ', warning_count)"),
    (1, 8, "concat('Retries      : ', retry_count)"),
    (1, 9, "CASE WHEN retry_count > 0 THEN 'Retries:' END"),
    (3, 1, "repeat('-', 50)"),
    (3, 2, "''"),
    (3, 3, "'Stage Summary:'"),
    (3, 4, "CASE WHEN stages IS NULL THEN '- No stage info found.' END"),
    (5, 1, "''"),
    (5, 2, "repeat('-', 50)"),
    (5, 3, "'Top Errors / Failures:'"),
    (7, 1, _more("error")),
    (7, 2, "''"),
    (7, 3, "'Top Warnings:'"),
    (9, 1, _more("warning")),
    (9, 2, "''"),
    (9, 3, "repeat('-', 50)"),
    (
        9,
        4,
        """concat('Final Result: Build completed with ',
        CASE WHEN error_count + warning_count > 0 THEN 'WARNINGS and ERRORS' ELSE 'no issues.' END)""",
    ),
    (
        9,
        5,
        """CASE WHEN error_count + warning_count > 0
        THEN '⚠ Requires attention before production deployment.' END""",
    ),
    (9, 6, "repeat('=', 49)"),
]
_FRAME_SQL = "\nUNION ALL ".join(f"SELECT log_id, {s}, {p}, {text} FROM frame" for s, p, text in _FRAME)

_REPORT = sql(
    LEGACY_TOP
    + """,
frame AS (
  SELECT r.*, s.stages, e.more AS error, w.more AS warning FROM legacy_rollup r
  LEFT JOIN (SELECT log_id, count(*) AS stages FROM legacy_stages GROUP BY 1) s USING (log_id)
  LEFT JOIN (SELECT DISTINCT log_id, more FROM legacy_top WHERE kind = 'error') e USING (log_id)
  LEFT JOIN (SELECT DISTINCT log_id, more FROM legacy_top WHERE kind = 'warning') w USING (log_id)),
notes AS (
  SELECT *, concat_ws(', ', CASE WHEN warnings > 0 THEN concat('Warnings: ', warnings) END,
    CASE WHEN errors > 0 THEN concat('Errors: ', errors) END,
    CASE WHEN retries > 0 THEN concat('Retries: ', retries) END,
    CASE WHEN criticals > 0 THEN concat(criticals, ' CRITICAL') END) AS note FROM legacy_stages),
report(log_id, section, position, text) AS (
"""
    + _FRAME_SQL
    + f"""
UNION ALL SELECT log_id, 2, first_line, concat('  - ', retry_type, ': ', retries) FROM retry_types
UNION ALL SELECT log_id, 4, stage_order, concat('- ', stage,
    repeat(' ', CAST(greatest(0, 20 - length(stage)) AS BIGINT)), ': ', status,
    CASE WHEN note <> '' THEN concat(' (', note, ')') ELSE '' END) FROM notes
UNION ALL SELECT log_id, 6, position, concat('- ', CASE WHEN {matches("text", "critical")}
    THEN concat('❌ [CRITICAL] ', ltrim(replace(text, '❌ [CRITICAL] ', ''), '- ')) ELSE text END)
  FROM legacy_top WHERE kind = 'error'
UNION ALL SELECT log_id, 8, position, concat('- ', text) FROM legacy_top WHERE kind = 'warning')""",
    """SELECT log_id, CAST(section AS BIGINT) AS section, CAST(position AS BIGINT) AS position, text
FROM report WHERE text IS NOT NULL""",
)


@query("legacy_report", _REPORT)
def _(logs):
    facts = logs.kept_legacy
    rows = legacy.legacy_stage_rows(facts)
    totals = legacy.legacy_totals(rows)
    return legacy.legacy_report(
        legacy.legacy_rollup(totals, legacy.finished_marks(facts)),
        legacy.retry_types(facts),
        legacy.legacy_stages(rows),
        legacy.legacy_top(facts, totals),
    )


_EFFECTIVE = "CASE WHEN status = 'SUCCESS' AND error_count > 0 THEN 'UNSTABLE' ELSE status END"


@query("report_headers", sql(SUMMARY, f"""SELECT log_id,
  concat(upper(platform), ' - ', coalesce(job_name, 'Unknown Job')) AS title,
  coalesce(build_number, 'N/A') AS build, {_EFFECTIVE} AS effective_status,
  CASE WHEN duration_seconds <> 0 THEN concat(format('{{:.1f}}', duration_seconds), 's') END AS duration,
  nullif(triggered_by, '') AS triggered_by, total_lines, stage_count, error_count, warning_count,
  CASE WHEN retry_count > 0 THEN retry_count END AS retries_shown FROM summary"""))
def _(logs):
    return reports.report_headers(logs.summary)


@query("summary_table", sql(SUMMARY, f"""SELECT log_id, platform, coalesce(job_name, 'Unknown') AS job_name,
  coalesce(build_number, 'N/A') AS build_number, {_EFFECTIVE} AS effective_status,
  stage_count AS stages, error_count AS errors, warning_count AS warnings,
  CASE WHEN retry_count > 0 THEN retry_count END AS retries FROM summary"""))
def _(logs):
    return reports.summary_table(logs.named_counts)


@query("report_stages", sql(STAGES, """SELECT log_id, stage_order, stage, concat(stage, ' - ', status,
    CASE WHEN note <> '' THEN concat(' (', note, ')') ELSE '' END) AS label
  FROM (SELECT *, concat_ws(', ', CASE WHEN error_count > 0 THEN concat(error_count, ' errors') END,
    CASE WHEN warning_count > 0 THEN concat(warning_count, ' warnings') END,
    CASE WHEN retry_count > 0 THEN concat(retry_count, ' retries') END) AS note FROM stages)"""))
def _(logs):
    return reports.report_stages(logs.stages)


@query("report_entries", sql(_RANKED, """SELECT log_id, kind, line_number, level,
  substring(message, 1, CASE kind WHEN 'error' THEN 120 ELSE 100 END) AS message
  FROM ranked WHERE position <= 10"""))
def _(logs):
    return reports.report_entries(logs.entries)


@query("report_entries_full", sql(FACTS, """SELECT log_id, kind, line_number, level,
  substring(message, 1, CASE kind WHEN 'error' THEN 120 ELSE 100 END) AS message FROM entries"""))
def _(logs):
    return reports.report_entries(logs.entries, show_all=True)


_MARKDOWN = [
    (1, 1, "'# Log Analysis Report'"),
    (1, 2, "''"),
    (1, 3, "concat('**Platform:** ', platform)"),
    (1, 4, "concat('**Job:** ', coalesce(job_name, 'Unknown'))"),
    (1, 5, "concat('**Status:** ', status)"),
    (1, 6, "concat('**Build Number:** ', coalesce(build_number, 'N/A'))"),
    (1, 7, "''"),
    (1, 8, "'## Statistics'"),
    (1, 9, "concat('- Total Lines: ', total_lines)"),
    (1, 10, "concat('- Errors: ', error_count)"),
    (1, 11, "concat('- Warnings: ', warning_count)"),
    (1, 12, "concat('- Retries: ', retry_count)"),
    (1, 13, "concat('- Stages: ', stage_count)"),
    (1, 14, "''"),
    (1, 15, "CASE WHEN stage_count > 0 THEN '## Stages' END"),
    (3, 1, f"CASE WHEN error_count > 0 THEN {q(chr(10) + '## Top Errors')} END"),
]
_MARKDOWN_SQL = "\nUNION ALL ".join(
    f"SELECT log_id, {s}, {p}, {text} FROM summary" for s, p, text in _MARKDOWN
)


@query("markdown_report", sql(SUMMARY + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY log_id, kind ORDER BY line_number) AS position
  FROM entries),
report(log_id, section, position, text) AS (
{_MARKDOWN_SQL}
UNION ALL SELECT log_id, 2, stage_order, concat('- **', stage, '**: ', status) FROM stages
UNION ALL SELECT log_id, 4, position, concat('- Line ', line_number, ': ', message)
  FROM ranked WHERE kind = 'error' AND position <= 5)""",
"""SELECT log_id, CAST(section AS BIGINT) AS section, CAST(position AS BIGINT) AS position, text
FROM report WHERE text IS NOT NULL"""))
def _(logs):
    logs = logs.written()
    return reports.markdown_report(logs.named_counts, logs.stages, logs.entries)


@query("parsed_json", sql(SUMMARY, """SELECT log_id, 'log' AS record, CAST(0 AS BIGINT) AS position,
  status AS name, error_count AS number FROM summary
UNION ALL SELECT log_id, 'stage', stage_order, stage, error_count FROM stages
UNION ALL SELECT log_id, 'entry', line_number, message, line_number FROM entries"""))
def _(logs):
    """The records read back: what each says of itself."""
    logs = logs.written()
    records = reports.parsed_json(logs.named_counts, logs.stages, logs.entries)
    name = {"log": "$.status", "stage": "$.stage", "entry": "$.message"}
    number = {"log": "$.error_count", "stage": "$.error_count", "entry": "$.line_number"}

    def read(paths):
        picked = None
        for kind, path in paths.items():
            hit, value = F.col("record") == kind, F.get_json_object("json", path)
            picked = F.when(hit, value) if picked is None else picked.when(hit, value)
        return picked

    return records.select(
        "log_id", "record", "position", read(name).alias("name"), read(number).cast("bigint").alias("number")
    )


@query("parsed_documents", sql(SUMMARY, """SELECT log_id, status, error_count, warning_count,
  (SELECT string_agg(concat(stage, ':', status), ',' ORDER BY stage_order) FROM stages s WHERE s.log_id = summary.log_id) AS stages,
  (SELECT string_agg(concat(line_number, ':', message), ',' ORDER BY line_number) FROM entries e
    WHERE e.log_id = summary.log_id AND kind = 'error') AS errors,
  (SELECT string_agg(concat(line_number, ':', message), ',' ORDER BY line_number) FROM entries e
    WHERE e.log_id = summary.log_id AND kind = 'warning') AS warnings FROM summary"""))
def _(logs):
    """A JSON document per log, written and read back."""
    logs = logs.written()
    path = scratch(logs.spark, "documents")
    sinks.write_documents(reports.parsed_documents(logs.named_counts, logs.stages, logs.entries), path)
    entry = "array<struct<line_number: long, message: string>>"
    read = logs.spark.read.schema(
        f"""log_id long, log struct<status: string, error_count: long, warning_count: long>,
        stages array<struct<stage: string, status: string>>, errors {entry}, warnings {entry}"""
    ).json(path)

    def spelt(items, first, second):
        told = F.transform(items, lambda x: F.concat_ws(":", x[first].cast("string"), x[second]))
        return F.nullif(F.array_join(told, ","), F.lit("")).alias(items)

    return read.select(
        "log_id",
        "log.*",
        spelt("stages", "stage", "status"),
        spelt("errors", "line_number", "message"),
        spelt("warnings", "line_number", "message"),
    )
