"""Text helpers as column expressions, with Python's idea of blanks and lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglantern.fixed_values import (
    ANSI_COLOUR,
    BLANK_CHARS,
    CHARS_PER_TOKEN,
    ECHO_PREFIX,
    LINE_BREAK,
)


def any_case(pattern: str) -> str:
    return "(?iuU)" + pattern


def one_line(pattern: str) -> str:
    """Only a line feed ends a line for ``.``, ``^`` and ``$``."""
    return "(?d)" + pattern


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, or null where the pattern is not found or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def contains_any(text: Column, words) -> Column:
    tests = [text.contains(word) for word in words]
    return reduce(or_, tests)


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def matches_any_case(text: Column, pattern: str, hints) -> Column:
    """The pattern in any case, tried only where one of its hints occurs."""
    return contains_any(F.lower(text), hints) & text.rlike(any_case(pattern))


def strip_colours(line: Column) -> Column:
    return F.when(line.contains("\x1b["), F.regexp_replace(line, ANSI_COLOUR, "")).otherwise(line)


def clean_line(line: Column) -> Column:
    return strip(F.regexp_replace(strip_colours(line), ECHO_PREFIX, ""))


def lines_of(text: Column) -> Column:
    """Lines without their breaks; a break at the very end opens no further line."""
    parts = F.split(text, LINE_BREAK)
    last = F.element_at(parts, -1) == ""
    return F.when(last, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokens_in(text: Column) -> Column:
    return (F.length(text) / CHARS_PER_TOKEN).cast("bigint")
