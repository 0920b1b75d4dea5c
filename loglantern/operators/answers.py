"""Stored model answers into columns: sections, lists and defaults, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern import prompt_texts as pt
from loglantern.fixed_values import BLANK, BLANK_RANGES, WORD
from loglantern.functions import line_rules as lr
from loglantern.functions.text import first_match, strip

# --- fixed values: how sections of an answer are found ---------------------------
ONE_LINE = r"\*\*{name}\*\*:?" + BLANK + r"*(.+)"
MANY_LINES = r"\*\*{name}\*\*:?" + BLANK + r"*\n(.+?)(?:\n\*\*|\z)"
MANY_LINES_TO_TITLE = r"\*\*{name}\*\*:?" + BLANK + r"*\n(.+?)(?:\n\*\*[A-Z]|\z)"
CODE_SECTION = r"\*\*CODE CHANGES\*\*.*?\n(.+?)(?:\n\*\*[A-Z]|\z)"
CONFIDENCE = r"\*\*CONFIDENCE\*\*:?" + BLANK + r"*(\d+)"
QUICK_FIX = r"\*\*QUICK FIX\*\*.*?```(?:bash)?" + BLANK + r"*\n(.+?)\n```"
TITLE_LEFTOVER = r"\*\*[A-Z" + BLANK_RANGES + r"]+\*\*.*$"
BULLETS = ("-", "•", "*")
NUMBERED = r"^\d+\."
ITEM_MARK = r"^[-•*\d.]" + BLANK + "*"
SCENARIO = r"^(?:Scenario|Case|Example)" + BLANK + r"+\d+:"
STEP = r"^\d+\." + BLANK + r"+(.+?)(?=\n\d+\.|\n```|\z)"
CODE_BLOCK = r"```[\s\S]*?```"
FILE_CHANGE = (
    r"File:" + BLANK + r"*`?([^`\n]+)`?" + BLANK + r"*\n```(?:" + WORD + r"+)?" + BLANK + r"*\n(.+?)\n```"
)

TEXT_WIDE = "(?ius)"  # any case, `.` also takes line feeds
LINE_WISE = "(?iud)"  # any case, `.` stops at a line feed


def _blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _line_section(answer: Column, name: str) -> Column:
    return _blank_to_null(strip(first_match(answer, LINE_WISE + ONE_LINE.replace("{name}", name))))


def _raw_section(answer: Column, name: str, pattern: str = MANY_LINES) -> Column:
    return first_match(answer, TEXT_WIDE + pattern.replace("{name}", name))


def _text_section(answer: Column, name: str) -> Column:
    found = strip(_raw_section(answer, name))
    return _blank_to_null(strip(F.regexp_replace(found, "(?dm)" + TITLE_LEFTOVER, "")))


def _confidence(answer: Column, default: int) -> Column:
    return F.coalesce(first_match(answer, TEXT_WIDE + CONFIDENCE).cast("bigint"), F.lit(default).cast("bigint"))


def _starts_with_bullet(line: Column) -> Column:
    return line.startswith(BULLETS[0]) | line.startswith(BULLETS[1]) | line.startswith(BULLETS[2])


def _key_points(answer: Column) -> Column:
    lines = F.transform(F.split(_raw_section(answer, "KEY POINTS"), "\n"), strip)
    points = F.transform(
        F.filter(lines, _starts_with_bullet), lambda line: strip(F.ltrim(line, F.lit("-•* ")))
    )
    return F.filter(points, lambda p: p != "")


def _items(answer: Column, name: str, scenarios: bool) -> Column:
    """List items; a numbered one loses only its first character."""
    lines = F.transform(F.split(_raw_section(answer, name), "\n"), strip)

    def item(line: Column) -> Column:
        listed = _starts_with_bullet(line) | line.rlike(NUMBERED)
        bare = strip(F.regexp_replace(line, ITEM_MARK, ""))
        chosen = F.when(listed, F.when((bare != "") & ~bare.startswith("**"), bare))
        if scenarios:
            chosen = chosen.when(line.rlike("(?iu)" + SCENARIO), line)
        return chosen

    return F.filter(F.transform(lines, item), lambda i: i.isNotNull())


def _or_texts(items: Column, default) -> Column:
    fallback = F.array(*[F.lit(d) for d in default]) if default else F.array().cast("array<string>")
    return F.when(F.size(items) > 0, items).otherwise(fallback)


def structure_summaries(answers: DataFrame) -> DataFrame:
    """Summary answers; ``log_status`` and ``error_count`` give what an answer leaves out."""
    answer = F.col("answer")
    errors = F.col("error_count")
    issue = F.when(
        errors > 0, F.concat(F.lit("Build failed with "), errors, F.lit(" errors"))
    ).otherwise("Build completed")
    return answers.select(
        "answer_id",
        F.coalesce(_line_section(answer, "STATUS"), "log_status").alias("status"),
        F.coalesce(_line_section(answer, "MAIN ISSUE"), issue).alias("main_issue"),
        _or_texts(_key_points(answer), pt.DEFAULT_KEY_POINTS).alias("key_points"),
        F.coalesce(_line_section(answer, "IMPACT"), lr.impact_of(errors)).alias("impact"),
        _confidence(answer, pt.DEFAULT_SUMMARY_CONFIDENCE).alias("confidence"),
    )


def structure_explanations(answers: DataFrame) -> DataFrame:
    answer = F.col("answer")
    return answers.select(
        "answer_id",
        F.coalesce(_text_section(answer, "ROOT CAUSE"), F.lit(pt.DEFAULT_ROOT_CAUSE)).alias("root_cause"),
        _or_texts(_items(answer, "COMMON SCENARIOS", True), pt.DEFAULT_SCENARIOS).alias("common_scenarios"),
        F.coalesce(_text_section(answer, "TECHNICAL DETAILS"), F.lit(pt.DEFAULT_DETAILS)).alias(
            "technical_details"
        ),
        _or_texts(_items(answer, "RELATED ERRORS", True), ()).alias("related_errors"),
        _confidence(answer, pt.DEFAULT_EXPLANATION_CONFIDENCE).alias("confidence"),
    )


def _diagnosis(answer: Column) -> Column:
    """The section of that name, else the first paragraph outside titles."""
    named = strip(_raw_section(answer, "DIAGNOSIS"))
    lines = F.split(answer, "\n")

    def is_text(line: Column) -> Column:
        return (strip(line) != "") & ~line.startswith("**")

    begin = F.array_position(F.transform(lines, is_text), True)
    rest = F.slice(lines, F.greatest(begin, F.lit(1)).cast("int"), F.size(lines))
    title = F.array_position(F.transform(rest, lambda line: line.startswith("**")), True)
    upto = F.when(title > 0, title - 1).otherwise(F.size(rest)).cast("int")
    paragraph = F.array_join(F.transform(F.filter(F.slice(rest, 1, upto), is_text), strip), " ")
    return F.coalesce(named, F.when(begin > 0, _blank_to_null(paragraph)))


def _steps(answer: Column) -> Column:
    section = _raw_section(answer, "DETAILED STEPS", MANY_LINES_TO_TITLE)
    found = F.regexp_extract_all(section, F.lit("(?dms)" + STEP), 1)
    return F.transform(
        found, lambda step: F.regexp_replace(strip(step), CODE_BLOCK, "[See code block]")
    )


def _code_changes(answer: Column) -> Column:
    """File to code; of several changes to a file the last stands."""
    section = first_match(answer, TEXT_WIDE + CODE_SECTION)

    def found(group: int) -> Column:
        return F.transform(F.regexp_extract_all(section, F.lit("(?s)" + FILE_CHANGE), group), strip)

    pairs = F.zip_with(found(1), found(2), lambda name, code: F.struct(name.alias("name"), code.alias("code")))
    names = F.transform(pairs, lambda p: p["name"])
    last = F.filter(
        pairs,
        lambda p, at: ~F.array_contains(F.slice(names, at + 2, F.size(names)), p["name"]),
    )
    return F.coalesce(
        F.map_from_entries(last),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
    )


def structure_fixes(answers: DataFrame, include_code: bool = True) -> DataFrame:
    answer = F.col("answer")
    no_code = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return answers.select(
        "answer_id",
        F.coalesce(_diagnosis(answer), F.lit(pt.DEFAULT_DIAGNOSIS)).alias("diagnosis"),
        strip(first_match(answer, TEXT_WIDE + QUICK_FIX)).alias("quick_fix"),
        _or_texts(_steps(answer), pt.DEFAULT_STEPS).alias("detailed_steps"),
        (_code_changes(answer) if include_code else no_code).alias("code_changes"),
        _or_texts(_items(answer, "PREVENTION.*?", False), ()).alias("prevention_tips"),
        F.coalesce(_text_section(answer, "VERIFICATION"), F.lit(pt.DEFAULT_VERIFICATION)).alias(
            "verification"
        ),
        _confidence(answer, pt.DEFAULT_FIX_CONFIDENCE).alias("confidence"),
    )


def display_lists(structured: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Only the first items of long lists, as shown to a reader."""
    return structured.select(
        *[F.slice(c, 1, columns[c]).alias(c) if c in columns else F.col(c) for c in structured.columns]
    )
