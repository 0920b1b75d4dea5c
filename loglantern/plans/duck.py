"""The same rows in DuckDB's SQL, to check results against.

Text patterns come from the fixed values; everything else is written out here on
its own, with plain windows and joins.
"""

from __future__ import annotations

from loglantern import fixed_values as fx
from loglantern.sources.corpus import EVENT_LINE_SQL


def q(text: str) -> str:
    """A string literal; characters below blank and beyond ASCII blanks as chr()."""
    if text.isprintable():
        return "'" + text.replace("'", "''") + "'"
    parts, plain = [], ""
    for c in text:
        if c.isprintable():
            plain += c
        else:
            if plain:
                parts.append(q(plain))
            parts.append(f"chr({ord(c)})")
            plain = ""
    if plain:
        parts.append(q(plain))
    return "concat(" + ", ".join(parts) + ")"


def trim(x: str) -> str:
    return f"trim({x}, {q(fx.BLANK_CHARS)})"


def matches(x: str, pattern: str, any_case: bool = True) -> str:
    return f"regexp_matches({x}, {q(pattern)}" + (", 'i')" if any_case else ")")


def extract(x: str, pattern: str, group: int = 1, any_case: bool = False) -> str:
    option = ", 'i'" if any_case else ""
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}{option}), '')"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def as_int(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


LINES = f"""
numbered AS (
  SELECT user_id, event_id, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_number,
    count(*) OVER (PARTITION BY user_id) AS log_rows
  FROM events),
lines AS (SELECT user_id AS log_id, line_number, {EVENT_LINE_SQL} AS raw_line FROM numbered)
"""

CLEAN = trim(f"regexp_replace(regexp_replace(raw_line, {q(fx.ANSI_COLOUR)}, '', 'g'), {q(fx.ECHO_PREFIX)}, '')")
IS_ECHO = f"starts_with({trim('raw_line')}, '+ echo')"
IS_ERROR = (
    f"({matches('raw_line', fx.STANDARD_ERROR)} AND NOT {matches('raw_line', fx.GIT_NOTE, False)}"
    f" AND NOT {matches('raw_line', fx.GIT_COMMAND, False)})"
)
IS_WARNING = matches("raw_line", fx.STANDARD_WARNING)
IS_RETRY = matches("raw_line", fx.STANDARD_RETRY)
NOTE_ERROR = extract("raw_line", fx.ACTIONS_ERROR_NOTE)
NOTE_WARNING = extract("raw_line", fx.ACTIONS_WARNING_NOTE)

_PIPELINE_FAIL = any_of("raw_line", fx.PIPELINE_FAIL_MARKS)
_ACTIONS_FAIL = any_of("raw_line", fx.ACTIONS_FAIL_MARKS) + " AND NOT contains(raw_line, '0')"

# every line with its platform, stage, context, kind, level and message
FACTS = (
    LINES
    + f""",
marks AS (
  SELECT log_id, CASE WHEN bool_or({any_of("raw_line", fx.PIPELINE_MARKERS)}) THEN 'jenkins'
    WHEN bool_or({any_of("raw_line", fx.ACTIONS_MARKERS)}) THEN 'github-actions'
    ELSE 'unknown' END AS platform
  FROM lines GROUP BY log_id),
opened AS (
  SELECT l.*, m.platform, {IS_ECHO} AS echo,
    {extract("raw_line", fx.PIPELINE_STAGE_OPEN)} AS stage_name,
    {trim(extract("raw_line", fx.ACTIONS_GROUP))} AS group_name,
    substring({extract("raw_line", fx.ACTIONS_COMMAND)}, 1, 50) AS command_name
  FROM lines l JOIN marks m USING (log_id)),
filled AS (
  SELECT *,
    CASE platform WHEN 'jenkins' THEN stage_name WHEN 'github-actions' THEN group_name END AS opens,
    CASE platform WHEN 'jenkins' THEN last_value(stage_name IGNORE NULLS) OVER w
      WHEN 'github-actions' THEN last_value(group_name IGNORE NULLS) OVER w END AS stage,
    CASE platform WHEN 'jenkins' THEN last_value(CASE WHEN NOT echo THEN stage_name END IGNORE NULLS) OVER w
      WHEN 'github-actions' THEN last_value(command_name IGNORE NULLS) OVER w END AS context,
    CASE WHEN platform = 'github-actions' THEN {NOTE_ERROR} END AS error_note,
    CASE WHEN platform = 'github-actions' THEN {NOTE_WARNING} END AS warning_note,
    platform = 'unknown' OR (platform = 'jenkins' AND echo) AS skipped
  FROM opened
  WINDOW w AS (PARTITION BY log_id ORDER BY line_number ROWS UNBOUNDED PRECEDING)),
kinds AS (
  SELECT *, CASE WHEN skipped THEN NULL WHEN error_note IS NOT NULL THEN 'error'
      WHEN warning_note IS NOT NULL THEN 'warning' WHEN {IS_ERROR} THEN 'error'
      WHEN {IS_WARNING} THEN 'warning' END AS kind,
    NOT skipped AND error_note IS NULL AND warning_note IS NULL AND {IS_RETRY} AS is_retry,
    stage IS NOT NULL AND stage <> '' AND CASE platform WHEN 'jenkins' THEN {_PIPELINE_FAIL}
      ELSE {_ACTIONS_FAIL} END AS fails_stage
  FROM filled),
facts AS (
  SELECT *, CASE WHEN kind = 'error' AND platform = 'jenkins' AND context IS NOT NULL
        AND contains(lower(raw_line), 'critical') THEN 'CRITICAL'
      WHEN kind = 'error' THEN 'ERROR' WHEN kind = 'warning' THEN 'WARNING' END AS level,
    CASE WHEN kind IS NOT NULL THEN coalesce(error_note, warning_note, {CLEAN}) END AS message
  FROM kinds),
entries AS (SELECT * FROM facts WHERE kind IS NOT NULL)
"""
)

STAGES = (
    FACTS
    + """,
stage_names AS (
  SELECT log_id, opens AS stage, min(line_number) AS stage_order
  FROM facts WHERE opens IS NOT NULL GROUP BY ALL),
stage_fails AS (SELECT DISTINCT log_id, stage FROM facts WHERE fails_stage),
stage_sums AS (
  SELECT log_id, context AS stage, count(*) FILTER (kind = 'error') AS error_count,
    count(*) FILTER (kind = 'warning') AS warning_count, count(*) FILTER (is_retry) AS retry_count,
    count(*) FILTER (level = 'CRITICAL') AS critical_count
  FROM facts WHERE context IS NOT NULL GROUP BY ALL),
stages AS (
  SELECT n.log_id, n.stage, n.stage_order,
    CASE WHEN f.stage IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status,
    CAST(coalesce(error_count, 0) AS BIGINT) AS error_count,
    CAST(coalesce(warning_count, 0) AS BIGINT) AS warning_count,
    CAST(coalesce(retry_count, 0) AS BIGINT) AS retry_count,
    CAST(coalesce(critical_count, 0) AS BIGINT) AS critical_count
  FROM stage_names n LEFT JOIN stage_fails f USING (log_id, stage)
  LEFT JOIN stage_sums s USING (log_id, stage))
"""
)

_FOUND = "\n".join(
    f"      WHEN platform = 'jenkins' AND bool_or({matches('raw_line', p)}) THEN '{s}'"
    for s, p in fx.BUILD_STATUS_PATTERNS
)

SUMMARY = (
    STAGES
    + f""",
line_sums AS (
  SELECT log_id, platform, CASE
{_FOUND}
      WHEN platform = 'github-actions' AND bool_or({matches("raw_line", fx.ACTIONS_SUCCESS, False)})
        THEN 'SUCCESS'
      ELSE 'UNKNOWN' END AS found_status,
    count(*) AS total_lines, count(*) FILTER (kind = 'error') AS error_count,
    count(*) FILTER (kind = 'warning') AS warning_count, count(*) FILTER (is_retry) AS retry_count,
    count(*) FILTER (level = 'CRITICAL' AND context IS NOT NULL) AS critical_count,
    arg_min(CASE WHEN {matches("raw_line", fx.PIPELINE_STARTED_BY, False)} THEN
        {trim(f"regexp_extract(raw_line, {q(fx.PIPELINE_STARTED_BY)}, 1)")} END, line_number)
      FILTER ({matches("raw_line", fx.PIPELINE_STARTED_BY, False)}) AS trigger_text,
    arg_min(TRY_CAST(regexp_extract(raw_line, {q(fx.PIPELINE_DURATION)}, 1) AS DOUBLE)
        * CASE regexp_extract(raw_line, {q(fx.PIPELINE_DURATION)}, 2)
          WHEN 'sec' THEN 1 WHEN 'min' THEN 60 WHEN 'hr' THEN 3600 END, line_number)
      FILTER ({matches("raw_line", fx.PIPELINE_DURATION, False)}) AS duration_value
  FROM facts GROUP BY log_id, platform),
stage_totals AS (
  SELECT log_id, count(*) AS stage_count, count(*) FILTER (status = 'FAILED') AS failed_stage_count
  FROM stages GROUP BY log_id),
summary AS (
  SELECT log_id, platform, found_status,
    CASE WHEN platform = 'unknown' OR found_status <> 'UNKNOWN' THEN found_status
      WHEN error_count > 0 THEN 'FAILED'
      WHEN platform = 'github-actions' AND coalesce(failed_stage_count, 0) > 0 THEN 'FAILED'
      WHEN warning_count > 0 THEN 'UNSTABLE' ELSE 'SUCCESS' END AS status,
    total_lines, coalesce(stage_count, 0) AS stage_count,
    coalesce(failed_stage_count, 0) AS failed_stage_count,
    CAST(error_count AS BIGINT) AS error_count, CAST(warning_count AS BIGINT) AS warning_count,
    CAST(retry_count AS BIGINT) AS retry_count, CAST(critical_count AS BIGINT) AS critical_count,
    CASE WHEN platform = 'jenkins' THEN trigger_text END AS triggered_by,
    CASE WHEN platform = 'jenkins' THEN duration_value END AS duration_seconds,
    CASE WHEN platform <> 'unknown' THEN
      concat(CASE WHEN log_id % 3 = 0 THEN 'prod-' ELSE 'dev-' END, log_id) END AS job_name,
    CASE WHEN platform <> 'unknown' THEN CAST(log_id AS VARCHAR) END AS build_number
  FROM line_sums LEFT JOIN stage_totals USING (log_id))
"""
)

LEGACY = (
    LINES
    + f""",
texts AS (
  SELECT log_id, line_number, {trim("raw_line")} AS text FROM lines WHERE NOT {IS_ECHO}),
legacy_opened AS (SELECT *, {extract("text", fx.LEGACY_STAGE_OPEN)} AS opens FROM texts),
legacy_facts AS (
  SELECT *, last_value(opens IGNORE NULLS) OVER (
      PARTITION BY log_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS stage,
    {matches("text", fx.LEGACY_ERROR)} AS is_error, {matches("text", fx.LEGACY_WARNING)} AS is_warning,
    {matches("text", fx.LEGACY_RETRY)} AS is_retry,
    upper({extract("text", fx.LEGACY_FINISHED, any_case=True)}) AS mark
  FROM legacy_opened),
legacy_rows AS (
  SELECT log_id, coalesce(stage, 'Unknown') AS stage,
    CAST(count(*) FILTER (is_error) AS BIGINT) AS errors, CAST(count(*) FILTER (is_warning) AS BIGINT) AS warnings,
    CAST(count(*) FILTER (is_retry AND facts.stage IS NOT NULL) AS BIGINT) AS retries,
    CAST(count(*) FILTER (is_error AND facts.stage IS NOT NULL AND {matches("text", "critical")}) AS BIGINT)
      AS criticals,
    bool_or(facts.stage IS NOT NULL AND {any_of("text", ("FAILED", "FAILURE"))}) AS failed,
    min(line_number) FILTER (opens IS NOT NULL) AS opened_at
  FROM legacy_facts AS facts GROUP BY ALL),
legacy_stages AS (
  SELECT log_id, stage, CAST(coalesce(opened_at, 0) AS BIGINT) AS stage_order,
    CASE WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END AS status, errors, warnings, retries, criticals
  FROM legacy_rows r
  WHERE opened_at IS NOT NULL OR (errors + warnings > 0 AND NOT EXISTS (
    SELECT 1 FROM legacy_rows o WHERE o.log_id = r.log_id AND o.opened_at IS NOT NULL))),
legacy_totals AS (
  SELECT log_id, CAST(count(*) FILTER (is_error) AS BIGINT) AS error_count,
    CAST(count(*) FILTER (is_warning) AS BIGINT) AS warning_count,
    CAST(count(*) FILTER (is_retry) AS BIGINT) AS retry_count, arg_max(mark, line_number) AS build_mark
  FROM legacy_facts GROUP BY log_id),
legacy_rollup AS (
  SELECT log_id, error_count, warning_count, retry_count,
    coalesce(build_mark, 'UNKNOWN') AS build_mark, own_status,
    CAST(coalesce(build_mark <> own_status, false) AS BIGINT) AS mismatch,
    CASE WHEN build_mark <> own_status THEN concat('   (⚠ Mismatch: Summary marked ', own_status, ')')
      ELSE '' END AS mismatch_note
  FROM (SELECT *, CASE WHEN error_count + warning_count > 0 THEN 'UNSTABLE' ELSE 'SUCCESS' END
    AS own_status FROM legacy_totals))
"""
)

_TOP = " UNION ALL ".join(
    f"""SELECT log_id, '{kind}' AS kind, text, line_number FROM legacy_facts
    WHERE is_{kind} AND starts_with(text, '{prefix}')"""
    for kind, prefix in (("error", "[ERROR]"), ("warning", "[WARNING]"))
)
LEGACY_TOP = (
    LEGACY
    + f""",
top_ranked AS (
  SELECT log_id, kind, text, row_number() OVER (
      PARTITION BY log_id, kind ORDER BY min(line_number)) AS position
  FROM ({_TOP}) GROUP BY log_id, kind, text),
top_shown AS (
  SELECT *, count(*) OVER (PARTITION BY log_id, kind) AS shown FROM top_ranked
  WHERE position <= CASE kind WHEN 'error' THEN 8 ELSE 7 END),
legacy_top AS (
  SELECT log_id, kind, position, text,
    CASE kind WHEN 'error' THEN error_count ELSE warning_count END - shown AS more
  FROM top_shown JOIN legacy_totals USING (log_id)),
retry_types AS (
  SELECT log_id, CASE WHEN word IS NULL THEN 'Other'
      ELSE concat(upper(substring(word, 1, 1)), lower(substring(word, 2))) END AS retry_type, count(*) AS retries, min(line_number) AS first_line
  FROM (SELECT log_id, line_number, {extract("text", fx.RETRY_TYPE, any_case=True)} AS word
    FROM legacy_facts WHERE is_retry) GROUP BY log_id, retry_type)
"""
)


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
