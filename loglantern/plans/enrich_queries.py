"""Candidates, prompts, answers, rule-based answers, chunks and the memo."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern import prompt_texts as pt
from loglantern.functions import line_rules as lr
from loglantern.operators import answers, chunks, enrich, memo, parse
from loglantern.operators.parse import neighbours, stage_context
from loglantern.plans.duck import FACTS, LINES, SUMMARY, any_of, extract, matches, q, sql, trim
from loglantern.plans.line_queries import _RANKED
from loglantern.plans.registry import Registry
from loglantern.session import keep, shared_folder
from loglantern.sources import corpus
from loglantern.sources.raw_logs import split_lines

registry = Registry()
query = registry.add
QUERIES, ORACLE = registry.queries, registry.oracle

NOW = dt.datetime(2024, 1, 31)

# --- estimates and small rules ----------------------------------------------------


@query("token_estimate", sql(LINES, """SELECT log_id, chars, chars // 4 AS tokens,
  greatest(1, (chars // 4 + 2999) // 3000) AS chunks FROM (
    SELECT log_id, CAST(sum(length(raw_line) + 1) - 1 AS BIGINT) AS chars FROM lines GROUP BY log_id)"""))
def _(logs):
    return enrich.log_sizes(logs.lines)


_TYPES = "CASE " + " ".join(
    f"WHEN {any_of('lower(message)', words)} THEN '{name}'" for name, words in fx.ERROR_TYPE_WORDS
) + f" ELSE '{fx.DEFAULT_ERROR_TYPE}' END"
_IMPACT = """CASE WHEN error_count > 10 THEN 'Critical' WHEN error_count > 5 THEN 'High'
  WHEN error_count > 0 THEN 'Medium' ELSE 'Low' END"""
_ENVIRONMENT = """CASE WHEN contains(lower(coalesce(job_name, '')), 'prod') THEN 'Production'
  ELSE 'Development' END"""


@query("error_type", sql(FACTS, f"SELECT log_id, line_number, {_TYPES} AS error_type FROM entries WHERE kind = 'error'"))
def _(logs):
    errors = logs.entries.filter("kind = 'error'")
    return errors.select("log_id", "line_number", lr.error_type(F.col("message")).alias("error_type"))


@query("impact", sql(SUMMARY, f"SELECT log_id, {_IMPACT} AS impact FROM summary"))
def _(logs):
    return logs.counts.select("log_id", lr.impact_of(F.col("error_count")).alias("impact"))


@query("environment", sql(SUMMARY, f"SELECT log_id, {_ENVIRONMENT} AS environment FROM summary"))
def _(logs):
    return logs.named_counts.select("log_id", lr.environment_of(F.col("job_name")).alias("environment"))


_FRAMES = f"""list_filter(string_split(message, chr(10)), lambda x: {matches("x", fx.STACK_FRAME, False)})"""
_STACK = f"""CASE WHEN len({_FRAMES}) > 0 THEN
  array_to_string(list_transform({_FRAMES}[:10], lambda x: {trim("x")}), chr(10)) ELSE 'Not available' END"""


@query("stack_frames", sql(FACTS, f"SELECT log_id, line_number, {_STACK} AS stack FROM entries"))
def _(logs):
    return logs.entries.select("log_id", "line_number", lr.stack_frames(F.col("message")).alias("stack"))


# --- context ------------------------------------------------------------------------

NEAR = FACTS + """,
errors AS (SELECT log_id, line_number, level, message FROM entries WHERE kind = 'error'),
pairs AS (
  SELECT e.log_id, e.line_number, n.line_number AS near_line, substring(n.message, 1, 80) AS near_message,
    row_number() OVER (PARTITION BY e.log_id, e.line_number ORDER BY n.line_number) AS place
  FROM errors e JOIN errors n ON e.log_id = n.log_id
    AND n.line_number BETWEEN e.line_number - 10 AND e.line_number + 10),
near AS (
  SELECT e.log_id, e.line_number, e.level, e.message, coalesce(string_agg(
      concat('  Line ', near_line, ': ', near_message, chr(10)), '' ORDER BY near_line)
      FILTER (place <= 3 AND near_line <> p.line_number), '') AS others
  FROM errors e JOIN pairs p USING (log_id, line_number) GROUP BY ALL)
"""


@query("neighbours", sql(NEAR, """SELECT log_id, line_number, near_line, near_message FROM pairs
  WHERE place <= 3 AND near_line <> line_number"""))
def _(logs):
    near = neighbours(logs.entries)
    return near.select("log_id", "line_number", F.inline("near"))


_CONTEXT = """,
context AS (
  SELECT log_id, coalesce(arg_min(stage, stage_order) FILTER (status = 'FAILED'), 'Unknown') AS failed_stage,
    coalesce(arg_min(stage, stage_order) FILTER (error_count > 0), 'Unknown') AS error_stage,
    coalesce(array_to_string((list(stage ORDER BY stage_order) FILTER (status = 'SUCCESS'))[:5], ', '), 'None')
      AS previous_stages
  FROM stages GROUP BY log_id)
"""


@query("stage_context", sql(SUMMARY + _CONTEXT, "SELECT * FROM context"))
def _(logs):
    return stage_context(logs.stages)


def _candidates(name, n):
    @query(name, sql(_RANKED, f"""SELECT log_id, line_number, position, message FROM ranked
      WHERE kind = 'error' AND position <= {n}"""))
    def _(logs):
        return enrich.candidates(logs.entries, n).select("log_id", "line_number", "position", "message")


_candidates("explain_candidates", fx.EXPLAIN_PER_LOG)
_candidates("fix_candidates", fx.FIX_PER_LOG)


@query("first_chars", sql(LINES, """SELECT log_id, substring(
  string_agg(raw_line, chr(10) ORDER BY line_number), 1, 5000) AS first_text FROM lines GROUP BY log_id"""))
def _(logs):
    return enrich.first_chars(logs.lines, 5000)


# --- prompts ------------------------------------------------------------------------


def _filled(template: str, places: dict[str, str]) -> str:
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [q(before), places[name]]
    return "concat(" + ", ".join([*parts, q(rest)]) + ")"


_TEXTS = """,
whole AS (SELECT log_id, string_agg(raw_line, chr(10) ORDER BY line_number) AS body FROM lines GROUP BY log_id)
"""
_SUMMARY_PROMPT = _filled(
    pt.SUMMARY_PROMPT,
    {
        "platform": "platform",
        "job_name": "coalesce(job_name, 'Unknown')",
        "status": "status",
        "error_count": "error_count",
        "warning_count": "warning_count",
        "duration": "'Unknown'",
        "log_size": "least(length(body), 5000)",
        "log_content": "substring(body, 1, 5000)",
    },
)


@query("summary_prompt", sql(SUMMARY + _TEXTS, f"""SELECT log_id, {_SUMMARY_PROMPT} AS prompt
  FROM summary JOIN whole USING (log_id)"""))
def _(logs):
    return enrich.summary_prompts(logs.named_counts, logs.kept_lines)


_RANKED_SUMMARY = SUMMARY + _CONTEXT + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY log_id, kind ORDER BY line_number) AS position
  FROM entries)
"""
_EXPLAIN_PROMPT = _filled(
    pt.EXPLAIN_PROMPT,
    {
        "platform": "s.platform",
        "error_type": _TYPES,
        "line_number": "line_number",
        "error_message": "message",
        "job_name": "coalesce(job_name, 'Unknown')",
        "stage_name": "coalesce(error_stage, 'Unknown')",
        "previous_stages": "coalesce(previous_stages, 'None')",
        "additional_context": """concat('Total errors: ', error_count, chr(10),
          CASE WHEN triggered_by <> '' THEN concat('Triggered by: ', triggered_by, chr(10)) ELSE '' END)""",
    },
)


@query("explain_prompt", sql(_RANKED_SUMMARY, f"""SELECT r.log_id, line_number, {_EXPLAIN_PROMPT} AS prompt
  FROM ranked r JOIN summary s USING (log_id) LEFT JOIN context c USING (log_id)
  WHERE kind = 'error' AND position <= 5"""))
def _(logs):
    logs = logs.written()
    chosen = enrich.candidates(logs.entries, fx.EXPLAIN_PER_LOG)
    return enrich.explain_prompts(chosen, logs.summary, logs.stages)


_FIX_PROMPT = _filled(
    pt.FIX_PROMPT,
    {
        "error_summary": "concat('[', level, '] ', message)",
        "platform": "s.platform",
        "job_name": "coalesce(job_name, 'Unknown')",
        "environment": _ENVIRONMENT,
        "failed_stage": "coalesce(failed_stage, 'Unknown')",
        "error_details": """concat('Error at line ', line_number, ':', chr(10), message, chr(10), chr(10),
          CASE WHEN others <> '' THEN concat('Related errors nearby:', chr(10), others) ELSE '' END)""",
        "stack_trace": _STACK,
    },
)


@query("fix_prompt", sql(SUMMARY + _CONTEXT + NEAR.replace(FACTS, "") + """,
chosen AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_number) AS position FROM near)
""", f"""SELECT log_id, line_number, {_FIX_PROMPT} AS prompt
  FROM chosen n JOIN summary s USING (log_id) LEFT JOIN context c USING (log_id) WHERE position <= 3"""))
def _(logs):
    logs = logs.written()
    return enrich.fix_prompts(logs.entries, logs.named_counts, logs.stages)


_RANKING_PROMPT = _filled(
    pt.RANKING_PROMPT,
    {
        "platform": "s.platform",
        "job_name": "coalesce(job_name, 'Unknown')",
        "error_count": "error_count",
        "errors_list": "errors_list",
    },
)


@query("ranking_prompt", sql(_RANKED_SUMMARY + """,
listed AS (SELECT log_id, string_agg(concat(position, '. Line ', line_number, ': ', message), chr(10)
    ORDER BY position) AS errors_list FROM ranked WHERE kind = 'error' AND position <= 10 GROUP BY log_id)
""", f"SELECT log_id, {_RANKING_PROMPT} AS prompt FROM listed JOIN summary s USING (log_id)"))
def _(logs):
    logs = logs.written()
    return enrich.ranking_prompts(logs.entries, logs.named_counts)


_COMPARISON_PROMPT = _filled(
    pt.COMPARISON_PROMPT,
    {
        "failed_build_number": "f.build",
        "failed_status": "f.status",
        "failed_errors": "coalesce(failed_errors, 'None')",
        "success_build_number": "g.build",
        "success_summary": "concat(g.error_count, ' error(s), ', g.warning_count, ' warning(s)')",
        "git_changes": "'Not available'",
    },
)


@query("comparison_prompt", sql(_RANKED_SUMMARY + """,
builds AS (SELECT log_id, log_id % 3 AS job, log_id AS build, status, error_count, warning_count FROM summary),
pairs AS (
  SELECT f.*, (SELECT max(build) FROM builds b WHERE b.job = f.job AND b.build < f.build
    AND b.status = 'SUCCESS') AS success_build FROM builds f WHERE status = 'FAILED'),
listed AS (SELECT log_id, string_agg(concat('- Line ', line_number, ': ', message), chr(10)
    ORDER BY position) AS failed_errors FROM ranked WHERE kind = 'error' AND position <= 3 GROUP BY log_id)
""", f"""SELECT f.log_id, success_build, {_COMPARISON_PROMPT} AS prompt
  FROM pairs f JOIN builds g ON g.job = f.job AND g.build = f.success_build
  LEFT JOIN listed l ON l.log_id = f.log_id"""))
def _(logs):
    logs = logs.written()
    job = (F.col("log_id") % 3).alias("job")
    builds = logs.counts.select(
        "log_id", job, F.col("log_id").alias("build"), "status", "error_count", "warning_count"
    )
    return enrich.comparison_prompts(builds, logs.entries, 1_000_000)


# --- answers without a model -----------------------------------------------------------

_POINTS = """,
points AS (SELECT log_id, string_agg(concat('Line ', line_number, ': ', substring(message, 1, 100)), ' | '
    ORDER BY position) AS points FROM ranked WHERE kind = 'error' AND position <= 3 GROUP BY log_id)
"""


@query("fallback_summary", sql(_RANKED_SUMMARY + _POINTS, f"""SELECT log_id, status,
  CASE WHEN error_count > 0 THEN concat('Build failed with ', error_count, ' error(s) and ', warning_count,
      ' warning(s)')
    WHEN warning_count > 0 THEN concat('Build completed with ', warning_count, ' warning(s)')
    ELSE 'Build completed successfully' END AS main_issue,
  coalesce(points, 'See full log for details') AS key_points, {_IMPACT} AS impact,
  CAST(50 AS BIGINT) AS confidence FROM summary LEFT JOIN points USING (log_id)"""))
def _(logs):
    logs = logs.written()
    return enrich.listed(enrich.fallback_summaries(logs.counts, logs.entries), ["key_points"])


@query("fallback_explanation", sql(_RANKED, f"""SELECT log_id, line_number, message AS error_message,
  concat('This appears to be a ', {_TYPES}, '. Review the error message for details.') AS root_cause,
  {q(" | ".join(pt.FALLBACK_SCENARIOS))} AS common_scenarios, {q(pt.FALLBACK_DETAILS)} AS technical_details,
  '' AS related_errors, CAST(40 AS BIGINT) AS confidence FROM ranked WHERE kind = 'error' AND position <= 5"""))
def _(logs):
    chosen = enrich.candidates(logs.entries, fx.EXPLAIN_PER_LOG)
    return enrich.listed(enrich.fallback_explanations(chosen), ["common_scenarios", "related_errors"])


@query("fallback_fix", sql(_RANKED, f"""SELECT log_id, line_number,
  concat('Error: ', substring(message, 1, 100)) AS diagnosis, CAST(NULL AS VARCHAR) AS quick_fix,
  {q(" | ".join(pt.FALLBACK_STEPS))} AS detailed_steps, {q(" | ".join(pt.FALLBACK_TIPS))} AS prevention_tips,
  {q(pt.FALLBACK_VERIFICATION)} AS verification, CAST(40 AS BIGINT) AS confidence
  FROM ranked WHERE kind = 'error' AND position <= 3"""))
def _(logs):
    fixes = enrich.fallback_fixes(enrich.candidates(logs.entries, fx.FIX_PER_LOG))
    return enrich.listed(fixes.drop("code_changes"), ["detailed_steps", "prevention_tips"])


# --- stored answers ------------------------------------------------------------------


def _answers(kind: str) -> str:
    return f"""
answers AS (SELECT concat(conv_id, '-', turn) AS answer_id, conv_id AS log_id,
  {corpus.ANSWER_SQL[kind]} AS answer FROM conversations)
"""


def _wide(name: str, pattern: str = answers.MANY_LINES) -> str:
    return extract("answer", "(?is)" + pattern.replace("{name}", name))


def _line(name: str) -> str:
    return f"nullif({trim(extract('answer', '(?i)' + answers.ONE_LINE.replace('{name}', name)))}, '')"


def _text_section(name: str) -> str:
    found = trim(_wide(name))
    return f"nullif({trim(f'''regexp_replace({found}, {q('(?m)' + answers.TITLE_LEFTOVER)}, '', 'g')''')}, '')"


def _confidence(default: int) -> str:
    found = extract("answer", "(?is)" + answers.CONFIDENCE)
    return f"CAST(coalesce(CAST({found} AS BIGINT), {default}) AS BIGINT)"


_BULLET = "(starts_with(x, '-') OR starts_with(x, '•') OR starts_with(x, '*'))"


def _or_default(items: str, default) -> str:
    return (
        f"CASE WHEN len({items}) > 0 THEN array_to_string({items}, ' | ')"
        f" ELSE {q(' | '.join(default))} END"
    )


def _items(name: str, scenarios: bool) -> str:
    lines = f"list_transform(string_split({_wide(name)}, chr(10)), lambda x: {trim('x')})"
    bare = trim(f"regexp_replace(x, {q(answers.ITEM_MARK)}, '')")
    scenario = f"WHEN {matches('x', answers.SCENARIO)} THEN x" if scenarios else ""
    item = f"""CASE WHEN {_BULLET} OR {matches("x", answers.NUMBERED, False)} THEN
      CASE WHEN {bare} <> '' AND NOT starts_with({bare}, '**') THEN {bare} END {scenario} END"""
    return f"list_filter(list_transform({lines}, lambda x: {item}), lambda y: y IS NOT NULL)"


_KEY_POINTS = f"""list_filter(list_transform(list_filter(list_transform(
  string_split({_wide("KEY POINTS")}, chr(10)), lambda x: {trim("x")}), lambda x: {_BULLET}),
  lambda y: {trim("ltrim(y, '-•* ')")}), lambda z: z <> '')"""


@query("answer_summary", sql(SUMMARY + ", " + _answers("summary"), f"""SELECT answer_id,
  coalesce({_line("STATUS")}, log_status) AS status,
  coalesce({_line("MAIN ISSUE")}, CASE WHEN error_count > 0 THEN
    concat('Build failed with ', error_count, ' errors') ELSE 'Build completed' END) AS main_issue,
  {_or_default(_KEY_POINTS, pt.DEFAULT_KEY_POINTS)} AS key_points,
  coalesce({_line("IMPACT")}, {_IMPACT}) AS impact, {_confidence(75)} AS confidence
  FROM (SELECT a.*, coalesce(s.status, 'UNKNOWN') AS log_status, coalesce(error_count, 0) AS error_count
    FROM answers a LEFT JOIN summary s USING (log_id))"""))
def _(logs):
    stored = corpus.stored_answers(logs.table("conversations"), "summary")
    told = stored.join(logs.counts.select("log_id", "status", "error_count"), "log_id", "left").select(
        "answer_id",
        "answer",
        F.coalesce("status", F.lit("UNKNOWN")).alias("log_status"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
    )
    return enrich.listed(answers.structure_summaries(told), ["key_points"])


@query("answer_explanation", sql(_answers("explanation"), f"""SELECT answer_id,
  coalesce({_text_section("ROOT CAUSE")}, {q(pt.DEFAULT_ROOT_CAUSE)}) AS root_cause,
  {_or_default(_items("COMMON SCENARIOS", True), pt.DEFAULT_SCENARIOS)} AS common_scenarios,
  coalesce({_text_section("TECHNICAL DETAILS")}, {q(pt.DEFAULT_DETAILS)}) AS technical_details,
  {_or_default(_items("RELATED ERRORS", True), ())} AS related_errors, {_confidence(80)} AS confidence
  FROM answers"""))
def _(logs):
    stored = corpus.stored_answers(logs.table("conversations"), "explanation")
    return enrich.listed(answers.structure_explanations(stored), ["common_scenarios", "related_errors"])


# the part of a fix answer RE2 can find: its steps need look-ahead and stand in a query of their own
_FIX_LINES = "string_split(answer, chr(10))"
_IS_TEXT = f"{trim('x')} <> '' AND NOT starts_with(x, '**')"
_CODE = extract("answer", "(?is)" + answers.CODE_SECTION)


def _changes(group: int) -> str:
    return f"""list_transform(regexp_extract_all({_CODE}, {q("(?s)" + answers.FILE_CHANGE)}, {group}),
      lambda x: {trim("x")})"""


# of several changes to a file the last stands
_LAST_CHANGES = f"""list_filter(list_zip({_changes(1)}, {_changes(2)}, generate_series(1, len({_changes(1)}))),
    lambda x: NOT list_contains(({_changes(1)})[x[3] + 1:], x[1]))"""


@query("answer_fix", sql(_answers("fix") + f""",
split AS (SELECT *, {_FIX_LINES} AS l FROM answers),
begun AS (SELECT *, list_position(list_transform(l, lambda x: {_IS_TEXT}), true) AS b FROM split),
rest AS (SELECT *, CASE WHEN b > 0 THEN l[b:] END AS r FROM begun),
ended AS (SELECT *, list_position(list_transform(r, lambda x: starts_with(x, '**')), true) AS e FROM rest),
paragraph AS (SELECT *, array_to_string(list_transform(list_filter(
    CASE WHEN e > 0 THEN r[:e - 1] ELSE r END, lambda x: {_IS_TEXT}), lambda x: {trim("x")}), ' ') AS p
  FROM ended)""", f"""SELECT answer_id,
  coalesce({trim(_wide("DIAGNOSIS"))}, nullif(p, ''), {q(pt.DEFAULT_DIAGNOSIS)}) AS diagnosis,
  {trim(extract("answer", "(?is)" + answers.QUICK_FIX))} AS quick_fix,
  coalesce(array_to_string(list_sort(list_transform({_LAST_CHANGES}, lambda x: concat(x[1], '=', x[2]))), ' | '), '')
    AS code_changes,
  {_or_default(_items("PREVENTION.*?", False), ())} AS prevention_tips,
  coalesce({_text_section("VERIFICATION")}, {q(pt.DEFAULT_VERIFICATION)}) AS verification,
  {_confidence(75)} AS confidence FROM paragraph"""))
def _(logs):
    stored = corpus.stored_answers(logs.table("conversations"), "fix")
    fixes = answers.structure_fixes(stored)
    kept = F.transform(F.map_entries("code_changes"), lambda c: F.concat(c["key"], F.lit("="), c["value"]))
    return enrich.listed(
        fixes.drop("detailed_steps").withColumn("code_changes", F.sort_array(kept)), ["prevention_tips", "code_changes"]
    )


# a step begins at a numbered line and ends before the next one or before a line of code
_STEPS_SECTION = _wide("DETAILED STEPS", answers.MANY_LINES_TO_TITLE)
_STEP_START = "\\n[0-9]+\\." + answers.BLANK + "+"
_STEPS_CUT = f"""string_split(regexp_replace(concat(chr(10), {_STEPS_SECTION}), {q(_STEP_START)}, chr(1), 'g'), chr(1))[2:]"""
_STEPS = f"""list_transform({_STEPS_CUT}, lambda x: regexp_replace({trim("regexp_replace(x, '(?s)\\n```.*$', '')")},
  {q(answers.CODE_BLOCK)}, '[See code block]', 'g'))"""


@query("answer_fix_steps", sql(_answers("fix"), f"""SELECT answer_id, CAST(len(steps) AS BIGINT) AS steps,
  array_to_string(steps, ' | ') AS detailed_steps FROM (SELECT answer_id, CASE WHEN len({_STEPS}) > 0 THEN {_STEPS}
    ELSE [{", ".join(q(x) for x in pt.DEFAULT_STEPS)}] END AS steps FROM answers)"""))
def _(logs):
    stored = corpus.stored_answers(logs.table("conversations"), "fix")
    return answers.structure_fixes(stored).select(
        "answer_id",
        F.size("detailed_steps").cast("bigint").alias("steps"),
        F.array_join("detailed_steps", " | ").alias("detailed_steps"),
    )


@query("answer_views", sql(_answers("explanation"), f"""SELECT answer_id,
  {_or_default(_items("COMMON SCENARIOS", True) + "[:3]", pt.DEFAULT_SCENARIOS)} AS common_scenarios
  FROM answers"""))
def _(logs):
    stored = corpus.stored_answers(logs.table("conversations"), "explanation")
    shown = answers.display_lists(answers.structure_explanations(stored), {"common_scenarios": 3})
    return enrich.listed(shown.select("answer_id", "common_scenarios"), ["common_scenarios"])


# --- chunks --------------------------------------------------------------------------

CHUNKS = """
pieces AS (SELECT doc_id AS log_id, string_split(text, chr(10)) AS l FROM documents
  WHERE length(text) // 4 > 3000),
body AS (SELECT log_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS i, unnest(l) AS line FROM pieces),
sums AS (SELECT *, length(line) // 4 AS t, sum(length(line) // 4) OVER (PARTITION BY log_id ORDER BY i) AS upto
  FROM body),
walk AS (
  SELECT log_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS chunk_id, CAST(1 AS BIGINT) AS begin_at
  FROM sums WHERE i = 1
  UNION ALL
  SELECT w.log_id, s.i, CASE WHEN s.upto - b.upto + b.t > 3000 THEN w.chunk_id + 1 ELSE w.chunk_id END,
    CASE WHEN s.upto - b.upto + b.t > 3000 THEN greatest(w.begin_at, s.i - 10) ELSE w.begin_at END
  FROM walk w JOIN sums s ON s.log_id = w.log_id AND s.i = w.i + 1
    JOIN sums b ON b.log_id = w.log_id AND b.i = w.begin_at),
spans AS (SELECT log_id, chunk_id, min(begin_at) AS first_line, max(i) AS last_line FROM walk GROUP BY ALL)
"""


@query("chunks", "WITH RECURSIVE " + CHUNKS + """SELECT log_id, chunk_id, first_line, last_line,
  array_to_string(l[first_line:last_line], chr(10)) AS chunk FROM spans JOIN pieces USING (log_id)""")
def _(logs):
    return chunks.body_chunks(logs.raw_documents)


@query("body_lines", sql(FACTS, """SELECT log_id, line_number, raw_line FROM lines l WHERE NOT EXISTS (
  SELECT 1 FROM entries e WHERE e.kind = 'error' AND e.log_id = l.log_id AND e.line_number = l.line_number)"""))
def _(logs):
    # the lines left for chunking; classified in place, so no join is needed
    kind = F.coalesce("kind", F.lit(""))
    return logs.facts.filter(kind != "error").select("log_id", "line_number", "raw_line")


_HEAD = f"""concat_ws(chr(10), '=== BUILD METADATA ===', concat('Platform: ', platform),
  concat('Job: ', coalesce(job_name, 'Unknown')), concat('Build: ', coalesce(build_number, 'N/A')),
  concat('Status: ', status), concat('Errors: ', error_count), concat('Warnings: ', warning_count),
  CASE WHEN triggered_by <> '' THEN concat('Triggered by: ', triggered_by) END,
  CASE WHEN stage_count > 0 THEN concat(chr(10), 'Stages: ', stage_count) END, stage_list,
  CASE WHEN stage_count > 5 THEN concat('  ... and ', stage_count - 5, ' more') END)"""
_SECTION = f"""concat_ws(chr(10), {q(chr(10) + "=== ERRORS & WARNINGS ===" + chr(10))},
  concat('Errors (', error_count, '):'), error_list,
  CASE WHEN error_count > 10 THEN concat(chr(10), '... and ', error_count - 10, ' more errors') END,
  CASE WHEN warning_count > 0 THEN concat(chr(10), 'Warnings (', warning_count, '):') END, warning_list,
  CASE WHEN warning_count > 5 THEN concat(chr(10), '... and ', warning_count - 5, ' more warnings') END)"""


@query("head_chunks", sql(_RANKED_SUMMARY + """,
error_lists AS (SELECT log_id, string_agg(concat(chr(10), position, '. [', level, '] Line ', line_number, ':',
    chr(10), '   ', message), chr(10) ORDER BY position) AS error_list
  FROM ranked WHERE kind = 'error' AND position <= 10 GROUP BY log_id),
warning_lists AS (SELECT log_id, string_agg(concat(chr(10), position, '. Line ', line_number, ':',
    chr(10), '   ', message), chr(10) ORDER BY position) AS warning_list
  FROM ranked WHERE kind = 'warning' AND position <= 5 GROUP BY log_id),
first_stages AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY stage_order) AS place FROM stages),
stage_lists AS (SELECT log_id, string_agg(concat('  ', CASE status WHEN 'SUCCESS' THEN '✅' ELSE '❌' END, ' ',
    stage, ' - ', status), chr(10) ORDER BY stage_order) AS stage_list FROM first_stages WHERE place <= 5 GROUP BY log_id)
""", f"""SELECT log_id, CASE WHEN error_count > 0 THEN concat({_HEAD}, chr(10), chr(10), {_SECTION})
  ELSE {_HEAD} END AS head FROM summary LEFT JOIN error_lists USING (log_id)
  LEFT JOIN warning_lists USING (log_id) LEFT JOIN stage_lists USING (log_id)"""))
def _(logs):
    logs = logs.written()
    return chunks.head_chunks(logs.summary, logs.entries, logs.stages)


# every chunk of every document: head, with the text where it fits, and body
_DOC_LINES = f"""
parts AS (SELECT doc_id AS log_id, string_split_regex(text, {q(fx.LINE_BREAK)}) AS p FROM documents),
kept AS (SELECT log_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM parts),
lines AS (SELECT log_id, CAST(generate_subscripts(p, 1) AS BIGINT) AS line_number, unnest(p) AS raw_line
  FROM kept)
"""


@query("assembled_chunks", "WITH RECURSIVE " + FACTS.replace(LINES, _DOC_LINES) + "," + CHUNKS + """,
heads AS (SELECT doc_id AS log_id, concat_ws(chr(10), '=== BUILD METADATA ===', concat('Platform: ',
    coalesce(platform, 'unknown')), 'Job: Unknown', 'Build: N/A', 'Status: UNKNOWN', 'Errors: 0', 'Warnings: 0')
    AS head, text FROM documents LEFT JOIN marks ON log_id = doc_id)
SELECT log_id, CAST(1 AS BIGINT) AS chunk_id, CASE WHEN length(text) // 4 <= 3000 AND text <> ''
    THEN concat(head, chr(10), chr(10), text) ELSE head END AS chunk FROM heads
UNION ALL SELECT log_id, chunk_id + 1, array_to_string(l[first_line:last_line], chr(10))
  FROM spans JOIN pieces USING (log_id)""")
def _(logs):
    facts = keep(parse.read_lines(split_lines(logs.raw_documents)))
    rolled = parse.roll_up(facts)
    nothing = F.lit(None).cast("string")
    named = parse.log_counts(rolled).withColumns(
        {"job_name": nothing, "build_number": nothing, "triggered_by": nothing}
    )
    entries = parse.entries(facts)
    heads = chunks.head_chunks(named, entries, parse.stages(rolled))
    return chunks.assemble(heads, logs.raw_documents, entries.filter("kind = 'error'"))


# --- memo ----------------------------------------------------------------------------

_TYPE = "CASE event_id % 3 WHEN 0 THEN 'summaries' WHEN 1 THEN 'explanations' ELSE 'fixes' END"
MEMO = f"""
stored_entries AS (SELECT {_TYPE} AS cache_type, sha256(concat('u', user_id, '-', event_id % 10)) AS key,
  ts AS written_at, event_id, CAST(event_id AS VARCHAR) AS value FROM events WHERE coalesce(event_type IN ('purchase', 'signup'), false)),
current AS (SELECT cache_type, key, written_at, value,
    written_at >= TIMESTAMP '2024-01-24 00:00:00' AS live FROM stored_entries
  QUALIFY row_number() OVER (PARTITION BY cache_type, key ORDER BY written_at DESC, event_id DESC) = 1),
requests AS (SELECT event_id AS request_id, {_TYPE} AS cache_type,
  sha256(concat('u', user_id, '-', event_id % 10)) AS key FROM events WHERE NOT coalesce(event_type IN ('purchase', 'signup'), false)),
looked AS (SELECT request_id, r.cache_type, r.key, CAST(c.key IS NOT NULL AS BIGINT) AS hit, c.value
  FROM requests r LEFT JOIN (SELECT * FROM current WHERE live) c USING (cache_type, key))
"""


def _memo(logs):
    events = logs.table("events")
    return corpus.memo_requests(events), memo.as_entries(corpus.memo_writes(events))


@query("memo_keys", """SELECT doc_id AS log_id, sha256(text) AS summary_key,
  sha256(concat(text, '_explain')) AS explanation_key, sha256(concat(text, '_fix')) AS fix_key FROM documents""")
def _(logs):
    text = F.col("raw_content")
    return logs.raw_documents.select(
        "log_id",
        memo.content_key(text, "summaries").alias("summary_key"),
        memo.content_key(text, "explanations").alias("explanation_key"),
        memo.content_key(text, "fixes").alias("fix_key"),
    )


@query("memo_current", sql(MEMO, "SELECT cache_type, key, value FROM current"))
def _(logs):
    return memo.current(_memo(logs)[1]).select("cache_type", "key", "value")


@query("memo_lookup", sql(MEMO, "SELECT request_id, cache_type, key, hit, value FROM looked"))
def _(logs):
    return memo.lookup(*_memo(logs), NOW)


@query("memo_missing", sql(MEMO, "SELECT DISTINCT cache_type, key FROM looked WHERE hit = 0"))
def _(logs):
    return memo.missing(*_memo(logs), NOW)


@query("memo_cleanup", sql(MEMO, """SELECT cache_type, count(*) FILTER (live) AS kept,
  count(*) FILTER (NOT live) AS removed FROM current GROUP BY cache_type"""))
def _(logs):
    return memo.cleanup_report(_memo(logs)[1], NOW)


@query("memo_kept", sql(MEMO, "SELECT cache_type, key, value FROM current WHERE live"))
def _(logs):
    return memo.cleanup(_memo(logs)[1], NOW).select("cache_type", "key", "value")


@query("memo_clear", sql(MEMO, "SELECT cache_type, key, value FROM current WHERE cache_type <> 'fixes'"))
def _(logs):
    return memo.clear(memo.current(_memo(logs)[1]), "fixes").select("cache_type", "key", "value")


@query("memo_stats", sql(MEMO, """SELECT * FROM (SELECT cache_type, CAST(sum(hit) AS BIGINT) AS hits,
    CAST(count(*) - sum(hit) AS BIGINT) AS misses, count(*) AS requests,
    round(100.0 * sum(hit) / count(*), 6) AS hit_rate FROM looked GROUP BY cache_type)
  JOIN (SELECT cache_type, count(*) AS entries FROM current GROUP BY cache_type) USING (cache_type)"""))
def _(logs):
    return memo.statistics(*_memo(logs), NOW)


def _scratch(spark):
    return f"{shared_folder(spark)}/memo-{uuid.uuid4().hex}"


@query("memo_rewritten", sql(MEMO, "SELECT cache_type, key, value FROM current WHERE live AND cache_type <> 'fixes'"))
def _(logs):
    spark, path = logs.spark, _scratch(logs.spark)
    memo.store(_memo(logs)[1], path)
    memo.rewrite(memo.cleanup(memo.read(spark, path), NOW), path)
    memo.rewrite(memo.clear(memo.read(spark, path), "fixes"), path, ["fixes"])
    memo.drop_replaced(spark, path)
    return memo.read(spark, path).select("cache_type", "key", "value")


# --- enrichment end to end -------------------------------------------------------------

# a log's text is known to the memo by a short name; its stored value is a write's number
_ENRICHED = SUMMARY + ", " + MEMO + ", " + _answers("summary") + """,
turns AS (SELECT conv_id AS log_id, max(turn) AS turn FROM conversations GROUP BY conv_id),
last_answers AS (SELECT a.* FROM answers a JOIN turns t ON a.answer_id = concat(t.log_id, '-', t.turn)),
stored AS (SELECT key, value FROM current WHERE live AND cache_type = 'summaries')
"""


_ENRICHED_ROWS = f"""SELECT log_id, platform, status, error_count,
  CASE WHEN m.key IS NOT NULL THEN 'memo' WHEN a.answer IS NOT NULL THEN 'answer' ELSE 'rule' END AS source,
  CASE WHEN m.key IS NOT NULL THEN concat('stored ', m.value)
    WHEN a.answer IS NOT NULL THEN coalesce({_line("MAIN ISSUE")}, CASE WHEN error_count > 0 THEN
      concat('Build failed with ', error_count, ' errors') ELSE 'Build completed' END)
    WHEN error_count > 0 THEN concat('Build failed with ', error_count, ' error(s) and ', warning_count, ' warning(s)')
    WHEN warning_count > 0 THEN concat('Build completed with ', warning_count, ' warning(s)')
    ELSE 'Build completed successfully' END AS main_issue,
  CASE WHEN m.key IS NOT NULL THEN 'Low' WHEN a.answer IS NOT NULL THEN coalesce({_line("IMPACT")}, {_IMPACT})
    ELSE {_IMPACT} END AS impact,
  CASE WHEN m.key IS NOT NULL THEN 90 WHEN a.answer IS NOT NULL THEN {_confidence(75)}
    ELSE {pt.FALLBACK_SUMMARY_CONFIDENCE} END AS confidence
  FROM summary LEFT JOIN stored m ON m.key = sha256(concat('u', log_id, '-0'))
  LEFT JOIN last_answers a USING (log_id)"""


@query("enriched_logs", sql(_ENRICHED, _ENRICHED_ROWS))
def _(logs):
    return _enriched(logs.written(), _live_summaries(logs)).select(*_ENRICHED_COLUMNS)


@query("enriched_again", sql(_ENRICHED, f"SELECT * REPLACE ('memo' AS source) FROM ({_ENRICHED_ROWS})"))
def _(logs):
    logs, path = logs.written(), _scratch(logs.spark)
    live = _live_summaries(logs).withColumn("write_id", F.lit(0).cast("bigint"))
    memo.store(live, path)
    first = _enriched(logs, memo.read(logs.spark, path))
    memo.store(enrich.to_store(first, F.lit(NOW).cast("timestamp_ntz")), path)
    again = memo.cleanup(memo.read(logs.spark, path), NOW)
    return _enriched(logs, again).select(*_ENRICHED_COLUMNS)


_ENRICHED_COLUMNS = ("log_id", "platform", "status", "error_count", "source", "main_issue", "impact", "confidence")


def _live_summaries(logs):
    value = F.to_json(
        F.struct(
            F.concat(F.lit("stored "), "value").alias("main_issue"),
            F.array(F.lit("as stored")).alias("key_points"),
            F.lit("Low").alias("impact"),
            F.lit(90).alias("confidence"),
        )
    )
    return memo.cleanup(_memo(logs)[1], NOW).withColumn("value", value)


def _enriched(logs, live):
    key = memo.content_key(F.concat(F.lit("u"), F.col("log_id"), F.lit("-0")))
    summary = logs.counts.withColumn("key", key)
    turns = logs.table("conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    stored = corpus.stored_answers(turns.join(last, ["conv_id", "turn"]), "summary")
    told = stored.join(logs.counts.select("log_id", "status", "error_count"), "log_id").select(
        F.col("log_id").alias("answer_id"), "answer", F.col("status").alias("log_status"), "error_count"
    )
    structured = answers.structure_summaries(told).withColumnRenamed("answer_id", "log_id")
    rules = enrich.fallback_summaries(logs.counts, logs.entries)
    return enrich.enriched_logs(summary, rules, structured, live)
