"""Inputs derived from the given tables: a build-log corpus, labelled metadata and answers.

Each rule is deterministic, so the same rows can be derived elsewhere for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.operators.ordered import PLACE, number_rows


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _choose(selector: Column, choices) -> Column:
    chosen = None
    for value, text in enumerate(choices):
        text = F.lit(text) if isinstance(text, str) else text
        chosen = F.when(selector == value, text) if chosen is None else chosen.when(selector == value, text)
    return chosen


# The first rule that applies gives the line.  Plain SQL that other engines read too.
EVENT_LINE_SQL = """
CASE
  WHEN user_id % 4 IN (0, 1) AND line_number = 1 THEN concat('Started by user u', user_id)
  WHEN user_id % 4 IN (0, 1) AND line_number = 2 THEN concat('Duration: ', user_id % 7 + 1,
    CASE user_id % 3 WHEN 0 THEN ' sec' WHEN 1 THEN ' min' ELSE ' hr' END)
  WHEN user_id % 4 IN (0, 1) AND line_number = log_rows THEN
    CASE user_id % 5 WHEN 0 THEN 'Finished: SUCCESS' WHEN 1 THEN 'Finished: FAILURE'
      WHEN 2 THEN 'Finished: UNSTABLE' WHEN 3 THEN 'Build ABORTED'
      ELSE '[Pipeline] End of Pipeline' END
  WHEN user_id % 4 IN (0, 1) AND event_type = 'signup' THEN
    concat('[Pipeline] { (Stage ', event_id % 6, ')')
  WHEN user_id % 4 = 2 AND line_number = 1 THEN '##[group]Step 0'
  WHEN user_id % 4 = 2 AND line_number = log_rows THEN
    concat('Process completed with exit code ', CAST(floor(user_id / 4) AS BIGINT) % 3)
  WHEN user_id % 4 = 2 AND event_type = 'signup' THEN
    concat(CASE WHEN event_id % 2 = 0 THEN '##[group]Step ' ELSE '##[command]Step ' END, event_id % 3)
  WHEN user_id % 8 = 1 AND event_type = 'error' THEN 'quiet line'
  WHEN user_id % 4 IN (0, 1) AND event_type = 'error' THEN
    CASE event_id % 6
      WHEN 0 THEN concat('[ERROR] critical failure in module ', user_id % 7)
      WHEN 1 THEN concat('Build step ', user_id % 7, ' FAILED')
      WHEN 2 THEN CASE WHEN user_id % 4 = 0 THEN '[12:00] > git fetch origin error # timeout=10'
        ELSE ' > git fetch origin error' END
      WHEN 3 THEN 'java.lang.RuntimeException: boom'
      WHEN 4 THEN concat('[ERROR] Unit test ', event_id % 4, ' failed')
      ELSE CASE WHEN user_id % 4 = 0 THEN 'Deployment failed due to timeout'
        ELSE 'Deployment failed' END END
  WHEN user_id % 4 IN (0, 1) AND event_type = 'click' THEN
    CASE event_id % 5
      WHEN 0 THEN concat('[WARNING] deprecated API in module ', event_id % 4)
      WHEN 1 THEN 'Retry: fetch dependency'
      WHEN 2 THEN '+ echo [ERROR] FAILED not real'
      WHEN 3 THEN '[WARNING] flaky test'
      ELSE 'try again: db connection' END
  WHEN user_id % 4 IN (0, 1) AND event_type = 'view' THEN
    CASE event_id % 4
      WHEN 0 THEN concat(chr(27), '[33mWARN: slow response', chr(27), '[0m')
      WHEN 1 THEN '[DEBUG] step'
      WHEN 2 THEN '[INFO] step ok'
      ELSE '   padded line  ' END
  WHEN user_id % 4 = 2 AND event_type = 'error' THEN
    CASE event_id % 5
      WHEN 0 THEN '::error::critical failure'
      WHEN 1 THEN 'Error: step broke'
      WHEN 2 THEN '::warning::low disk'
      WHEN 3 THEN 'Build FAILED'
      ELSE 'exception in module' END
  WHEN user_id % 4 = 2 AND event_type = 'click' THEN
    CASE event_id % 3
      WHEN 0 THEN 'Retry attempt'
      WHEN 1 THEN 'WARN deprecated call'
      ELSE '::error::retry exhausted' END
  WHEN user_id % 4 = 2 AND event_type = 'view' THEN
    CASE WHEN event_id % 4 = 0 THEN '2024-01-01T00:00:00 Error: masked' ELSE '[INFO] step ok' END
  WHEN user_id % 4 = 3 AND event_type = 'error' THEN 'something failed badly'
  ELSE concat('[INFO] item ', event_id)
END
"""


def event_log_lines(events: DataFrame, parts: int | None = None) -> DataFrame:
    """One log per user, one line per event: ``log_id, slice, is_cut, line_number, raw_line``."""
    rows = number_rows(
        events.select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id", parts
    )
    named = rows.withColumnRenamed("user_id", "log_id")
    return named.select(*PLACE, "line_number", F.expr(EVENT_LINE_SQL.replace("user_id", "log_id")).alias("raw_line"))


def build_names(log_id: Column) -> dict[str, Column]:
    """What the caller knows about a log of the event corpus."""
    prefix = F.when(log_id % 3 == 0, "prod-").otherwise("dev-")
    return {
        "job_name": F.concat(prefix, log_id.cast("string")),
        "build_number": log_id.cast("string"),
        "build_url": _text("https://builds.example/", log_id),
        "branch": F.when(log_id % 5 == 0, "main").otherwise(_text("topic-", log_id % 5)),
        "commit": F.substring(F.md5(log_id.cast("string")), 1, 12),
        "workflow": F.when(log_id % 4 == 2, _text("flow-", log_id % 3)),
        "run_id": F.when(log_id % 4 == 2, (log_id * 100).cast("string")),
    }


def document_logs(documents: DataFrame) -> DataFrame:
    """Documents as raw logs: one whole text per row."""
    return documents.select(F.col("doc_id").alias("log_id"), F.col("text").alias("raw_content"))


def document_metadata(documents: DataFrame, *more: str) -> DataFrame:
    """Labelled metadata, one row per document, with further columns of it."""
    doc = F.col("doc_id")
    twentieth = doc % 20
    category = (
        F.when(twentieth < 5, "dependency_error")
        .when(twentieth < 9, "syntax_error")
        .when(twentieth < 13, "test_failure")
        .when(twentieth < 16, "timeout")
        .when(twentieth < 18, "environment_error")
        .when(twentieth < 19, "network_error")
        .otherwise("permission_error")
    )
    return documents.select(
        doc.alias("log_id"),
        _text("logs/", doc, ".txt").alias("file_path"),
        _choose(doc % 3, ("jenkins", "github-actions", "gitlab-ci")).alias("platform"),
        category.alias("error_category"),
        (doc % 1000 + 1).cast("int").alias("build_number"),
        *more,
    )


def document_files(documents: DataFrame) -> DataFrame:
    """Log texts by path."""
    return documents.select(_text("logs/", F.col("doc_id"), ".txt").alias("file_path"), F.col("text"))


def labelled_files(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of labelled documents only: to the metadata of the others the file is missing."""
    return document_files(documents.join(labels.select("doc_id"), "doc_id", "left_semi"))


def _memo_fields() -> tuple[Column, Column]:
    event = F.col("event_id")
    cache_type = _choose(event % 3, ("summaries", "explanations", "fixes"))
    content = _text("u", F.col("user_id"), "-", event % 10)
    return cache_type, content


def _is_write() -> Column:
    return F.coalesce(F.col("event_type").isin("purchase", "signup"), F.lit(False))


def memo_writes(events: DataFrame) -> DataFrame:
    """Stored results: one write per purchase or signup; all other events are look-ups."""
    cache_type, content = _memo_fields()
    return events.filter(_is_write()).select(
        cache_type.alias("cache_type"),
        content.alias("content"),
        F.col("ts").alias("written_at"),
        F.col("event_id").alias("write_id"),
        F.col("event_id").cast("string").alias("value"),
    )


def memo_requests(events: DataFrame) -> DataFrame:
    """Look-ups: one per event that stores nothing."""
    cache_type, content = _memo_fields()
    return events.filter(~_is_write()).select(
        F.col("event_id").alias("request_id"),
        cache_type.alias("cache_type"),
        content.alias("content"),
    )


def score_predictions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions of three threshold models of the text length against the quality label."""
    scored = documents.select("doc_id", "n_chars").join(labels.select("doc_id", "quality"), "doc_id")
    limits = F.array(*[F.lit(t) for t in (200, 500, 1000)])
    return scored.select(
        "doc_id", F.col("quality").cast("bigint").alias("label"), F.explode(limits).alias("limit"), "n_chars"
    ).select(
        _text("limit-", F.col("limit")).alias("model"),
        "doc_id",
        "label",
        (F.col("n_chars") > F.col("limit")).cast("bigint").alias("prediction"),
    )


# Answers as a model would give them, around the whole text of a conversation turn.  One
# section is left out by conv_id % 5, and some confidences are no numbers.  Plain SQL that
# other engines read too.
_BULLETS = "replace(text, chr(10), concat(chr(10), '- '))"
_CONFIDENCE = """CASE WHEN conv_id % 5 = 4 THEN ''
  WHEN conv_id % 7 = 0 THEN '**CONFIDENCE**: high'
  ELSE concat('**CONFIDENCE**: ', (conv_id * 7 + turn) % 101, '%') END"""


def _unless(rest: int, *parts: str) -> str:
    return f"CASE WHEN conv_id % 5 = {rest} THEN '' ELSE concat({', '.join(parts)}, chr(10), chr(10)) END"


ANSWER_SQL = {
    "summary": f"""concat(
  {_unless(0, "'**STATUS**: '", "role")},
  {_unless(1, "'**Main Issue**: turn '", "turn", "' of '", "conv_id")},
  {_unless(2, "'**KEY POINTS**:'", "chr(10)", "'- '", _BULLETS, "chr(10)", "'• last  '", "chr(10)", "'no bullet'")},
  {_unless(3, "'**IMPACT**: '", "CASE turn % 2 WHEN 0 THEN 'High' ELSE 'Low' END", "' - '", "role")},
  {_CONFIDENCE})""",
    "explanation": f"""concat('Some words first.', chr(10),
  {_unless(0, "'**ROOT CAUSE**:'", "chr(10)", "text", "chr(10)", "'more words'")},
  {_unless(1, "'**COMMON SCENARIOS**:'", "chr(10)", "'- '", _BULLETS, "chr(10)",
           "'1. numbered'", "chr(10)", "'Scenario 2: named'", "chr(10)", "'plain line'")},
  {_unless(2, "'**TECHNICAL DETAILS**:'", "chr(10)", "chr(10)", "text")},
  {_unless(3, "'**RELATED ERRORS**:'", "chr(10)", "'* '", "role", "chr(10)", "'* **bold** item'")},
  {_CONFIDENCE})""",
    "fix": f"""concat(
  CASE WHEN conv_id % 3 = 0 THEN concat('**DIAGNOSIS**:', chr(10), text, chr(10), chr(10))
    WHEN conv_id % 3 = 1 THEN concat(text, chr(10), '  and more', chr(10)) ELSE '' END,
  {_unless(0, "'**QUICK FIX** (if available):'", "chr(10)", "'```bash'", "chr(10)", "'run '", "role", "chr(10)", "'```'")},
  {_unless(1, "'**DETAILED STEPS**:'", "chr(10)", "'1. first '", "role", "chr(10)", "'   then more'", "chr(10)",
           "'2. second ```x``` done'", "chr(10)", "'```bash'", "chr(10)", "'cmd'", "chr(10)", "'```'", "chr(10)",
           "'3. third'")},
  {_unless(2, "'**CODE CHANGES** (if needed):'", "chr(10)", "'File: `a/'", "role", "'.py`'", "chr(10)", "'```python'",
           "chr(10)", "'x = '", "turn", "chr(10)", "'```'", "chr(10)", "'File: b.py'", "chr(10)", "'```'", "chr(10)",
           "'y = 1'", "chr(10)", "'```'", "chr(10)", "'File: b.py'", "chr(10)", "'```'", "chr(10)", "'y = 2'",
           "chr(10)", "'```'")},
  {_unless(3, "'**PREVENTION TIPS**:'", "chr(10)", "'- '", _BULLETS, "chr(10)", "'2. numbered'")},
  {_unless(4, "'**VERIFICATION**:'", "chr(10)", "text")},
  {_CONFIDENCE})""",
}


def stored_answers(conversations: DataFrame, kind: str) -> DataFrame:
    """One stored answer per conversation turn: ``answer_id, log_id, answer``."""
    return conversations.select(
        _text(F.col("conv_id"), "-", F.col("turn")).alias("answer_id"),
        F.col("conv_id").alias("log_id"),
        F.expr(ANSWER_SQL[kind]).alias("answer"),
    )
