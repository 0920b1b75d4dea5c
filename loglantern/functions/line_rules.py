"""What one line says: level, error, warning, retry (`standard` and `legacy` rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern.functions.text import (
    any_case,
    capitalise,
    contains_any,
    first_match,
    matches_any_case,
    strip,
)


def is_echo(line: Column) -> Column:
    return line.contains(fx.ECHO_START) & strip(line).startswith(fx.ECHO_START)


def level_of(line: Column) -> Column:
    shouted = F.upper(line)
    level = None
    for name, words in fx.LEVEL_WORDS:
        hit = contains_any(shouted, words)
        level = F.when(hit, name) if level is None else level.when(hit, name)
    return level.otherwise(fx.DEFAULT_LEVEL)


def is_error(line: Column) -> Column:
    # the git tests come last: they only matter for the few lines that look like errors
    return (
        matches_any_case(line, fx.STANDARD_ERROR, fx.STANDARD_ERROR_HINTS)
        & ~line.rlike(fx.GIT_NOTE)
        & ~line.rlike(fx.GIT_COMMAND)
    )


def is_warning(line: Column) -> Column:
    return matches_any_case(line, fx.STANDARD_WARNING, fx.STANDARD_WARNING_HINTS)


def is_retry(line: Column) -> Column:
    return matches_any_case(line, fx.STANDARD_RETRY, fx.STANDARD_RETRY_HINTS)


def legacy_error(line: Column) -> Column:
    return matches_any_case(line, fx.LEGACY_ERROR, fx.LEGACY_ERROR_HINTS)


def legacy_warning(line: Column) -> Column:
    return matches_any_case(line, fx.LEGACY_WARNING, fx.LEGACY_WARNING_HINTS)


def legacy_retry(line: Column) -> Column:
    return matches_any_case(line, fx.LEGACY_RETRY, fx.LEGACY_RETRY_HINTS)


def legacy_critical(line: Column) -> Column:
    return matches_any_case(line, fx.LEGACY_CRITICAL, fx.LEGACY_CRITICAL_HINTS)


def retry_type(line: Column) -> Column:
    found = first_match(line, any_case(fx.RETRY_TYPE))
    return F.coalesce(capitalise(found), F.lit("Other"))


def error_type(message: Column) -> Column:
    lowered = F.lower(message)
    kind = None
    for name, words in fx.ERROR_TYPE_WORDS:
        hit = contains_any(lowered, words)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.otherwise(fx.DEFAULT_ERROR_TYPE)


def impact_of(error_count: Column) -> Column:
    return (
        F.when(error_count > 10, "Critical")
        .when(error_count > 5, "High")
        .when(error_count > 0, "Medium")
        .otherwise("Low")
    )


def effective_status(status: Column, error_count: Column) -> Column:
    """A build that says success in spite of errors is shown as unstable."""
    return F.when((status == "SUCCESS") & (error_count > 0), "UNSTABLE").otherwise(status)


def environment_of(job_name: Column) -> Column:
    named = F.lower(F.coalesce(job_name, F.lit("")))
    return F.when(named.contains("prod"), "Production").otherwise("Development")


def stack_frames(message: Column) -> Column:
    """Stack-frame lines of a message, or a fixed note where there are none."""
    frames = F.transform(
        F.filter(F.split(message, "\n"), lambda line: line.rlike("(?d)" + fx.STACK_FRAME)), strip
    )
    return F.when(
        F.size(frames) > 0, F.concat_ws("\n", F.slice(frames, 1, fx.STACK_FRAMES_SHOWN))
    ).otherwise("Not available")
