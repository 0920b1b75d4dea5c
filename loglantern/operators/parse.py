"""From lines to classified lines, stages and one record per log.

``read_lines`` needs one shuffle by (log, slice), which numbering the lines has
already done; the roll-up to stages adds a partially aggregated one, the roll-up to
logs another.  Line text never reaches a shuffle after that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern.functions import line_rules as lr
from loglantern.functions.text import clean_line, contains_any, first_match, strip
from loglantern.operators.ordered import LINE_KEYS, first_rows, log_context
from loglantern.rules import PLATFORM_RULES, UNKNOWN_PLATFORM, PlatformRules

LINE = "raw_line"
HEADER = ("triggered_by", "duration_seconds")  # the same on all lines of a log


def _by_platform(rules: Sequence[PlatformRules], value) -> Column:
    """The value of the rule set whose position stands in ``rule``; null for other logs."""
    chosen = None
    for position, rule in enumerate(rules):
        v = value(position, rule)
        if v is None:
            continue
        hit = F.col("rule") == position
        chosen = F.when(hit, v) if chosen is None else chosen.when(hit, v)
    return F.lit(None).cast("string") if chosen is None else chosen


def platform_name(rules: Sequence[PlatformRules] = PLATFORM_RULES) -> Column:
    name = _by_platform(rules, lambda _, rule: F.lit(rule.platform))
    return F.coalesce(name, F.lit(UNKNOWN_PLATFORM))


def _opened(rule: PlatformRules) -> Column:
    name = rule.stage_open.of(F.col(LINE))
    return strip(name) if rule.strip_stage else name


def _context(rule: PlatformRules) -> Column:
    line = F.col(LINE)
    if rule.context_open is None:
        name = _opened(rule)
    else:
        name = rule.context_open.of(line)
        if rule.context_chars is not None:
            name = F.substring(name, 1, rule.context_chars)
    return F.when(~lr.is_echo(line), name) if rule.skip_echo else name


def _first_rule(rules: Sequence[PlatformRules]) -> Column:
    chosen = None
    for position, _ in enumerate(rules):
        hit = F.col(f"marked_{position}")
        chosen = F.when(hit, position) if chosen is None else chosen.when(hit, position)
    return chosen


def read_lines(lines: DataFrame, rules: Sequence[PlatformRules] = PLATFORM_RULES) -> DataFrame:
    """Classify each line by the rules of its log's platform and tell its stage.

    Adds ``rule`` (position in ``rules``, null: unknown platform), ``opens`` (the stage
    the line opens), ``stage`` (the stage whose status it may change), ``context`` (what
    it is counted under), ``kind`` (error, warning or null), ``is_retry``, ``level``,
    ``message``, ``fails_stage`` and, on every line, the log's ``triggered_by`` and
    ``duration_seconds``.
    """
    line = F.col(LINE)
    latest = {}
    for position, rule in enumerate(rules):
        latest[f"stage_{position}"] = _opened(rule)
        latest[f"context_{position}"] = _context(rule)
    anywhere = {
        f"marked_{position}": contains_any(line, rule.markers) for position, rule in enumerate(rules)
    }
    header = {"triggered_by": started_by(line), "duration_seconds": duration_seconds(line)}
    told = log_context(lines, latest, anywhere, header).withColumn("rule", _first_rule(rules))
    has_header = F.coalesce(_by_platform(rules, lambda _, r: F.lit(r.has_header)), F.lit(False))

    known = F.col("rule").isNotNull()
    placed = told.select(
        *lines.columns,
        "rule",
        *[F.when(has_header, F.col(n)).alias(n) for n in HEADER],
        _by_platform(rules, lambda _, r: _opened(r)).alias("opens"),
        _by_platform(rules, lambda p, _: F.col(f"stage_{p}")).alias("stage"),
        _by_platform(rules, lambda p, _: F.col(f"context_{p}")).alias("context"),
        F.coalesce(
            _by_platform(rules, lambda _, r: lr.is_echo(line) if r.skip_echo else F.lit(False)),
            F.lit(True),
        ).alias("skipped"),
        _by_platform(rules, lambda _, r: r.error_note and r.error_note.of(line)).alias("error_note"),
        _by_platform(rules, lambda _, r: r.warning_note and r.warning_note.of(line)).alias(
            "warning_note"
        ),
    )
    noted = F.col("error_note").isNotNull() | F.col("warning_note").isNotNull()
    kind = (
        F.when(F.col("skipped"), F.lit(None).cast("string"))
        .when(F.col("error_note").isNotNull(), "error")
        .when(F.col("warning_note").isNotNull(), "warning")
        .when(lr.is_error(line), "error")
        .when(lr.is_warning(line), "warning")
    )
    fails = _by_platform(
        rules,
        lambda _, r: contains_any(line, r.fail_marks)
        & (~line.contains(r.fail_mask) if r.fail_mask else F.lit(True)),
    )
    may_be_critical = F.coalesce(_by_platform(rules, lambda _, r: F.lit(r.critical)), F.lit(False))
    classified = placed.withColumns(
        {
            "kind": kind,
            "is_retry": known & ~F.col("skipped") & ~noted & lr.is_retry(line),
            "in_stage": F.coalesce(F.col("stage") != "", F.lit(False)),
        }
    )
    is_critical = (
        may_be_critical & ~noted & F.col("context").isNotNull() & F.lower(line).contains("critical")
    )
    return classified.select(
        *lines.columns,
        "rule",
        *HEADER,
        "opens",
        "stage",
        "context",
        "kind",
        F.coalesce("is_retry", F.lit(False)).alias("is_retry"),
        F.when((F.col("kind") == "error") & is_critical, "CRITICAL")
        .when(F.col("kind") == "error", "ERROR")
        .when(F.col("kind") == "warning", "WARNING")
        .alias("level"),
        F.when(F.col("kind").isNotNull(), F.coalesce("error_note", "warning_note", clean_line(line)))
        .alias("message"),
        F.coalesce(F.col("in_stage") & fails, F.lit(False)).alias("fails_stage"),
    )


def entries(facts: DataFrame) -> DataFrame:
    """Error and warning lines only."""
    return facts.filter(F.col("kind").isNotNull()).select(
        *LINE_KEYS, "line_number", "kind", "level", "context", "message", "raw_line"
    )


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def roll_up(
    facts: DataFrame, rules: Sequence[PlatformRules] = PLATFORM_RULES, headers: bool = False
) -> DataFrame:
    """One row per (log, name): counts of the lines counted under the name, and its stage record.

    Rows with a null name hold the lines of a log that are counted under nothing.  All
    buffers are numbers, so Spark aggregates by hash on both sides of the shuffle; the
    log's trigger and duration, where wanted, are grouping keys.
    """
    keys = ["log_id", "rule", *(HEADER if headers else ())]
    line = F.col(LINE)
    is_line = F.col("line_number").isNotNull()
    signs = []
    for position, rule in enumerate(rules):
        here = (F.col("rule") == position) & contains_any(F.lower(line), rule.sign_hints)
        for n, (_, pattern) in enumerate(rule.status_signs):
            signs.append((f"sign_{position}_{n}", here & line.rlike(pattern)))
    counted = F.struct(
        F.col("context").alias("name"),
        _one_if(is_line).alias("lines"),
        _one_if(F.col("kind") == "error").alias("errors"),
        _one_if(F.col("kind") == "warning").alias("warnings"),
        _one_if(F.col("is_retry")).alias("retries"),
        _one_if(F.col("level") == "CRITICAL").alias("criticals"),
        F.lit(None).cast("bigint").alias("opened_at"),
        F.lit(0).alias("failed"),
        *[F.col(n) for n, _ in signs],
    )
    marked = F.struct(
        F.col("stage").alias("name"),
        *[F.lit(0).alias(n) for n in ("lines", "errors", "warnings", "retries", "criticals")],
        F.when(F.col("opens").isNotNull(), F.col("line_number")).alias("opened_at"),
        _one_if(F.col("fails_stage")).alias("failed"),
        *[F.lit(0).alias(n) for n, _ in signs],
    )
    both = F.when(
        F.col("opens").isNotNull() | F.col("fails_stage"), F.array(counted, marked)
    ).otherwise(F.array(counted))
    told = facts.withColumns({n: _one_if(flag) for n, flag in signs})
    return (
        told.select(*keys, F.inline(both))
        .groupBy(*keys, "name")
        .agg(
            *[F.sum(n).alias(n) for n in ("lines", "errors", "warnings", "retries", "criticals")],
            F.min("opened_at").alias("opened_at"),
            F.max("failed").alias("failed"),
            *[F.max(n).alias(n) for n, _ in signs],
        )
    )


def stages(rolled: DataFrame) -> DataFrame:
    """Stages in the order of ``opened_at``; a stage opened again continues its record."""
    return rolled.filter(F.col("opened_at").isNotNull()).select(
        "log_id",
        F.col("name").alias("stage"),
        F.col("opened_at").alias("stage_order"),
        F.when(F.col("failed") == 1, "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("errors").alias("error_count"),
        F.col("warnings").alias("warning_count"),
        F.col("retries").alias("retry_count"),
        F.col("criticals").alias("critical_count"),
    )


def log_counts(rolled: DataFrame, rules: Sequence[PlatformRules] = PLATFORM_RULES) -> DataFrame:
    """One row per log: platform, found and final status, counts, and headers rolled up with."""
    headers = [n for n in HEADER if n in rolled.columns]
    is_stage = F.col("opened_at").isNotNull()
    signs = [
        (position, n, status)
        for position, rule in enumerate(rules)
        for n, (status, _) in enumerate(rule.status_signs)
    ]
    totals = rolled.groupBy("log_id", "rule", *headers).agg(
        F.sum("lines").alias("total_lines"),
        F.sum(_one_if(is_stage)).cast("bigint").alias("stage_count"),
        F.sum(_one_if(is_stage & (F.col("failed") == 1))).cast("bigint").alias("failed_stage_count"),
        F.sum("errors").alias("error_count"),
        F.sum("warnings").alias("warning_count"),
        F.sum("retries").alias("retry_count"),
        F.sum("criticals").alias("critical_count"),
        *[F.max(f"sign_{p}_{n}").alias(f"sign_{p}_{n}") for p, n, _ in signs],
    )
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for p, n, status in signs:
        found = found.when(F.col(f"sign_{p}_{n}") == 1, status)
    found = found.otherwise("UNKNOWN")
    stage_fails = F.coalesce(
        _by_platform(rules, lambda _, r: F.lit(r.failed_stage_fails)), F.lit(False)
    )
    final = (
        F.when(F.col("rule").isNull() | (F.col("found_status") != "UNKNOWN"), F.col("found_status"))
        .when(F.col("error_count") > 0, "FAILED")
        .when(stage_fails & (F.col("failed_stage_count") > 0), "FAILED")
        .when(F.col("warning_count") > 0, "UNSTABLE")
        .otherwise("SUCCESS")
    )
    return (
        totals.withColumn("found_status", found)
        .withColumn("status", final)
        .select(
            "log_id",
            platform_name(rules).alias("platform"),
            "found_status",
            "status",
            "total_lines",
            "stage_count",
            "failed_stage_count",
            "error_count",
            "warning_count",
            "retry_count",
            "critical_count",
            *headers,
        )
    )


def started_by(line: Column) -> Column:
    found = line.contains("Started by ") & line.rlike(fx.PIPELINE_STARTED_BY)
    return F.when(found, strip(F.regexp_extract(line, fx.PIPELINE_STARTED_BY, 1)))


def duration_seconds(line: Column) -> Column:
    amount = first_match(line, fx.PIPELINE_DURATION, 1).cast("double")
    factors = F.create_map(*[F.lit(v) for pair in fx.DURATION_SECONDS.items() for v in pair])
    unit = F.regexp_extract(line, fx.PIPELINE_DURATION, 2)
    return F.when(line.contains("Duration: "), amount * F.try_element_at(factors, unit))


def log_headers(lines: DataFrame, strip_user_prefix: bool = False) -> DataFrame:
    """First trigger and first duration of each log that has one, whatever its platform.

    Only the few lines that hold either are grouped.
    """
    line = F.col(LINE)
    candidates = lines.filter(line.contains("Started by ") | line.contains("Duration: ")).select(
        "log_id",
        "line_number",
        started_by(line).alias("trigger"),
        duration_seconds(line).alias("duration"),
    )

    def first_of(name: str) -> Column:
        at = F.when(F.col(name).isNotNull(), F.col("line_number"))
        return F.min_by(name, at)

    trigger = F.col("triggered_by")
    if strip_user_prefix:
        trigger = F.regexp_replace(trigger, "^user ", "")
    return (
        candidates.groupBy("log_id")
        .agg(first_of("trigger").alias("triggered_by"), first_of("duration").alias("duration_seconds"))
        .withColumn("triggered_by", trigger)
    )


def named(counts: DataFrame, names: dict[str, Column]) -> DataFrame:
    """Attach what the caller knows; a log of unknown platform keeps none of it."""
    known = F.col("platform") != UNKNOWN_PLATFORM
    return counts.select("*", *[F.when(known, value).alias(n) for n, value in names.items()])


def quick_summary(summary: DataFrame) -> DataFrame:
    return summary.select(
        "log_id",
        "platform",
        "status",
        "job_name",
        "build_number",
        F.col("duration_seconds").alias("duration"),
        F.col("stage_count").alias("stages"),
        F.col("error_count").alias("errors"),
        F.col("warning_count").alias("warnings"),
        F.col("retry_count").alias("retries"),
    )


def failed_stages(stage_rows: DataFrame) -> DataFrame:
    return stage_rows.filter(F.col("status") == "FAILED")


def critical_entries(entry_rows: DataFrame) -> DataFrame:
    return entry_rows.filter(F.col("level") == "CRITICAL")


def first_entries(entry_rows: DataFrame, kind: str, n: int) -> DataFrame:
    """The first ``n`` errors or warnings of each log, in line order."""
    return first_rows(entry_rows.filter(F.col("kind") == kind), "log_id", ["line_number"], n)


def stage_context(stage_rows: DataFrame) -> DataFrame:
    """Per log: first failed stage, first stage with errors, first five successful stages."""
    good = first_rows(
        stage_rows.filter(F.col("status") == "SUCCESS"), "log_id", ["stage_order"], 5
    ).groupBy("log_id").agg(
        F.concat_ws(
            ", ",
            F.transform(
                F.sort_array(F.collect_list(F.struct("stage_order", "stage"))), lambda s: s["stage"]
            ),
        ).alias("previous_stages")
    )

    def first_where(condition: Column) -> Column:
        return F.min_by("stage", F.when(condition, F.col("stage_order")))

    firsts = stage_rows.groupBy("log_id").agg(
        first_where(F.col("status") == "FAILED").alias("failed_stage"),
        first_where(F.col("error_count") > 0).alias("error_stage"),
    )
    return firsts.join(good, "log_id", "left").select(
        "log_id",
        F.coalesce("failed_stage", F.lit("Unknown")).alias("failed_stage"),
        F.coalesce("error_stage", F.lit("Unknown")).alias("error_stage"),
        F.coalesce("previous_stages", F.lit("None")).alias("previous_stages"),
    )


def neighbours(
    entry_rows: DataFrame,
    within: int = fx.NEIGHBOUR_LINES,
    shown: int = fx.NEIGHBOURS_SHOWN,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Errors near each error: the first ``shown`` of those within some lines, itself left out.

    Lines are cut into blocks and the few errors near a block's edge are copied into
    the next block, so a window holds one block and never a whole log.
    """
    block = 50 * within
    at = F.col("line_number")
    errors = entry_rows.filter(F.col("kind") == "error").select(
        "log_id", "line_number", "message", *carry
    )
    home = F.floor(at / block)
    spread = errors.withColumn(
        "block",
        F.explode(
            F.array_distinct(F.array(F.floor((at - within) / block), home, F.floor((at + within) / block)))
        ),
    )
    near = (
        Window.partitionBy("log_id", "block").orderBy("line_number").rangeBetween(-within, within)
    )
    seen = spread.select(
        "log_id",
        "line_number",
        "message",
        *carry,
        "block",
        F.collect_list(
            F.struct(at.alias("near_line"), F.substring("message", 1, 80).alias("near_message"))
        )
        .over(near)
        .alias("around"),
    ).filter(F.col("block") == F.floor(at / block))
    # collect_list over an ordered frame keeps line order
    others = F.filter(
        F.slice("around", 1, shown), lambda e: e["near_line"] != F.col("line_number")
    )
    return seen.select("log_id", "line_number", "message", *carry, others.alias("near"))
