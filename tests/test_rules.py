"""Hand-written logs, one per rule."""

import pytest
from pyspark.sql import functions as F

from loglantern.functions import line_rules as lr
from loglantern.functions import text as tx
from loglantern.operators import features
from loglantern.operators.parse import neighbours
from loglantern.rules import ACTIONS_BY_GROUP, PIPELINE
from loglantern.sources.raw_logs import guard_size, split_lines

PIPE = "[Pipeline] Start of Pipeline\n"


def value(spark, text, expression):
    frame = spark.createDataFrame([(text,)], "t string")
    return frame.select(expression(F.col("t")).alias("v")).first().v


def test_basic_pipeline_log(read):
    record, stages, entries = read(
        "Started by user Some One\n" + PIPE + "[Pipeline] { (Build)\n[ERROR] Compilation failed\n"
        "[WARNING] Deprecated API used\n[Pipeline] }\nFinished: FAILURE\n"
    )
    assert (record.platform, record.status, record.triggered_by) == ("jenkins", "FAILED", "user Some One")
    assert (record.error_count, record.warning_count, record.total_lines) == (2, 1, 7)
    assert [(s.stage, s.status) for s in stages] == [("Build", "FAILED")]
    assert [e.message for e in entries if e.kind == "error"] == ["[ERROR] Compilation failed", "Finished: FAILURE"]


def test_lower_case_failed_does_not_fail_a_stage(read):
    _, stages, _ = read(PIPE + "[Pipeline] { (Stage 1)\n[ERROR] Stage 1 failed\n[Pipeline] { (Stage 2)\nok\n")
    assert [(s.stage, s.status, s.error_count) for s in stages] == [
        ("Stage 1", "SUCCESS", 1),
        ("Stage 2", "SUCCESS", 0),
    ]


@pytest.mark.parametrize(
    "text, platform",
    [
        ("[Pipeline] x\n##[group]y", "jenkins"),
        ("see github.com", "github-actions"),
        ("nothing [ERROR] here", "unknown"),
    ],
)
def test_platform(read, text, platform):
    record, _, _ = read(text)
    assert record.platform == platform
    if platform == "unknown":
        assert (record.status, record.error_count, record.total_lines) == ("UNKNOWN", 0, 1)


@pytest.mark.parametrize(
    "text, lines",
    [
        ("", []),
        ("a\n", ["a"]),
        ("a\r\nb", ["a", "b"]),
        ("a\x0cb", ["a", "b"]),
        ("\n", [""]),
        ("a\x1cb c\x1fd", ["a", "b", "c\x1fd"]),
        ("a\rb\n\nc", ["a", "b", "", "c"]),
    ],
)
def test_lines_are_those_of_splitlines(spark, text, lines):
    assert text.splitlines() == lines
    raw = spark.createDataFrame([(1, text)], "log_id bigint, raw_content string")
    rows = split_lines(raw).orderBy("line_number").collect()
    assert [r.raw_line for r in rows if r.line_number is not None] == lines
    assert len(rows) >= 1  # an empty log keeps a row


def test_empty_log_keeps_its_record(read, read_legacy):
    record, stages, entries = read("")
    assert (record.platform, record.total_lines, stages, entries) == ("unknown", 0, [], [])
    rollup, stages, top, report = read_legacy("")
    assert (rollup.error_count, rollup.build_mark, stages, top) == (0, "UNKNOWN", [], [])
    assert "- No stage info found." in report
    assert "Final Result: Build completed with no issues." in report


def test_echo_line_is_not_counted_but_fails_its_stage(read):
    record, stages, _ = read(PIPE + "[Pipeline] { (A)\n+ echo this FAILED\n")
    assert (record.error_count, stages[0].status, stages[0].error_count) == (0, "FAILED", 0)


def test_time_prefix_defeats_the_echo_skip(read):
    record, _, _ = read(PIPE + "[2024-01-01] + echo '[ERROR] x'\n")
    assert record.error_count == 1


def test_stage_opened_again_and_interleaved(read):
    _, stages, _ = read(
        PIPE + "[Pipeline] { (A)\nERROR 1\n[Pipeline] { (B)\nERROR 2\n[Pipeline] }\nERROR 3\n[Pipeline] { (A)\nERROR 4\n"
    )
    assert [(s.stage, s.error_count) for s in stages] == [("A", 2), ("B", 2)]


def test_critical_needs_an_open_stage(read):
    _, stages, entries = read(PIPE + "ERROR critical\n[Pipeline] { (A)\nERROR Critical\n")
    assert [e.level for e in entries] == ["ERROR", "CRITICAL"]
    assert stages[0].critical_count == 1


def test_error_beats_warning_and_retry_counts_too(read):
    record, _, _ = read(PIPE + "[WARNING] ERROR retrying\n")
    assert (record.error_count, record.warning_count, record.retry_count) == (1, 0, 1)


@pytest.mark.parametrize(
    "line, standard, legacy",
    [
        (" > git fetch error # timeout=10", False, True),
        ("[12:00] > git fetch error # timeout=10", False, True),
        ("timeout exceeded", True, True),
        ("timeout", False, True),
        ("testsfailed", True, False),
        ("a failure", True, True),
        ("failures", False, False),
        ("java.lang.Exception", True, False),
        ("ſome faıled", True, True),  # long s, dotless i
        ("all fine", False, False),
        (None, None, None),
    ],
)
def test_error_lines(spark, line, standard, legacy):
    assert value(spark, line, lr.is_error) is standard
    assert value(spark, line, lr.legacy_error) is legacy


@pytest.mark.parametrize(
    "line, level",
    [
        ("a critical failed", "CRITICAL"),
        ("Error: x", "ERROR"),
        ("warn: x", "WARNING"),
        ("debug: x", "DEBUG"),
        ("warn x", "INFO"),
    ],
)
def test_levels(spark, line, level):
    assert value(spark, line, lr.level_of) == level


def test_actions_zero_masks_a_failure(read):
    _, stages, _ = read("##[group]A\n10:00 Error: x\n##[group] B \nError: x\n")
    assert [(s.stage, s.status) for s in stages] == [("A", "SUCCESS"), ("B", "FAILED")]


def test_actions_counts_attach_to_equally_named_commands(read):
    text = "##[group]A\n##[command]A\n::error::first\n##[command]B\n::warning:: w \nretry error\n"
    record, stages, entries = read(text)
    assert (record.error_count, record.warning_count, record.retry_count) == (2, 1, 1)
    assert [(s.error_count, s.warning_count, s.retry_count) for s in stages] == [(1, 0, 0)]
    assert [(e.level, e.message) for e in entries] == [
        ("ERROR", "first"),
        ("WARNING", " w "),
        ("ERROR", "retry error"),
    ]
    _, stages, _ = read(text, rules=(PIPELINE, ACTIONS_BY_GROUP))
    assert [(s.error_count, s.warning_count, s.retry_count) for s in stages] == [(2, 1, 1)]


def test_annotated_line_counts_no_retry(read):
    record, _, _ = read("##[group]A\n::error::retry\n")
    assert (record.error_count, record.retry_count) == (1, 0)


@pytest.mark.parametrize(
    "tail, status",
    [
        ("ERROR\n", "FAILED"),
        ("deprecated\n", "UNSTABLE"),
        ("fine\n", "SUCCESS"),
        ("Finished: SUCCESS\nFinished: FAILURE\n", "SUCCESS"),
        ("build failed\nTIMEOUT\n", "FAILED"),
        ("it timed out\n", "TIMEOUT"),
        ("Cancelled\n", "ABORTED"),
    ],
)
def test_pipeline_status(read, tail, status):
    assert read(PIPE + tail)[0].status == status


@pytest.mark.parametrize(
    "text, status",
    [
        ("##[group]A\nError: x\nProcess completed with exit code 0\n", "SUCCESS"),
        ("##[group]A\nProcess completed with exit code 1\n", "FAILED"),
        ("##[group]A\nunstable\n", "UNSTABLE"),
        ("##[group]A\n", "SUCCESS"),
    ],
)
def test_actions_status(read, text, status):
    assert read(text)[0].status == status


@pytest.mark.parametrize("text, seconds", [("Duration: 3 min", 180.0), ("Duration: 2 hr", 7200.0), ("x", None)])
def test_duration(read, text, seconds):
    assert read(PIPE + text)[0].duration_seconds == seconds


def test_neighbours(spark):
    rows = [(1, n, "error", f"m{n}") for n in (1, 5, 11, 12, 30)]
    entries = spark.createDataFrame(rows, "log_id bigint, line_number bigint, kind string, message string")
    near = {r.line_number: [e.near_line for e in r.near] for r in neighbours(entries).collect()}
    assert near == {1: [5, 11], 5: [1, 11], 11: [1, 5], 12: [5, 11], 30: []}


def test_neighbours_against_brute_force(spark):
    lines = [n for n in range(1, 3000) if (n * 7919) % 5 < 2]
    rows = [(1, n, "error", f"m{n}") for n in lines]
    entries = spark.createDataFrame(rows, "log_id bigint, line_number bigint, kind string, message string")
    near = {r.line_number: [e.near_line for e in r.near] for r in neighbours(entries).collect()}
    for n in lines:
        window = [m for m in lines if abs(m - n) <= 10][:3]
        assert near[n] == [m for m in window if m != n]


def test_legacy_top_shows_once_and_counts_the_rest(read_legacy):
    rollup, _, top, report = read_legacy("[ERROR] same\n[ERROR] same\n[WARNING] w\nFAILED thing\n")
    assert (rollup.error_count, rollup.warning_count) == (3, 1)
    assert [(t.kind, t.text, t.more) for t in top] == [("error", "[ERROR] same", 2), ("warning", "[WARNING] w", 0)]
    assert "... and 2 more errors not shown" in report


def test_legacy_lines_before_any_stage(read_legacy):
    _, stages, _, report = read_legacy("FAILED\nretry\n")
    assert [(s.stage, s.errors, s.retries, s.status) for s in stages] == [("Unknown", 1, 0, "SUCCESS")]
    assert "  - Other: 1" in report
    _, stages, _, _ = read_legacy("FAILED\n[Pipeline] { (A)\nretry db\n")
    assert [(s.stage, s.errors, s.retries) for s in stages] == [("A", 0, 1)]


def test_legacy_mark_is_the_last(read_legacy):
    rollup, _, _, report = read_legacy("Finished: SUCCESS\nfinished: failure\n")
    assert (rollup.build_mark, rollup.own_status, rollup.mismatch) == ("FAILURE", "UNSTABLE", 1)
    assert report[4] == "Jenkins Mark : ❌ FAILURE   (⚠ Mismatch: Summary marked UNSTABLE)"


def test_legacy_many_repeated_lines(read_legacy):
    rollup, _, top, _ = read_legacy("[ERROR] fail FAILED\n" * 10000 + "[WARNING] warn\n" * 10000 + "Finished: SUCCESS")
    assert (rollup.error_count, rollup.warning_count, rollup.mismatch) == (10000, 10000, 1)
    assert [(t.text, t.more) for t in top] == [("[ERROR] fail FAILED", 9999), ("[WARNING] warn", 9999)]


def test_critical_tag_is_not_doubled(read_legacy):
    _, _, _, report = read_legacy("[ERROR] - critical\n")
    assert "- ❌ [CRITICAL] [ERROR] - critical" in report


def test_strip_takes_all_blanks(spark):
    text = " \t\x1f x y 　\x1c"
    assert value(spark, text, tx.strip) == text.strip() == "x y"


def test_structural_flags(spark):
    def flags(text):
        frame = spark.createDataFrame([(text,)], "t string")
        return frame.select(*features.structural_features(F.col("t"))).first().asDict()

    npm, pip = flags("npm ERR! code"), flags("ERROR: Could")
    assert npm["has_npm_error"] == 1
    assert (pip["has_pip_error"], pip["has_npm_error"], pip["has_error_keyword"]) == (0, 1, 1)
    assert flags("ERROR:x")["has_pip_error"] == 1
    trace = flags("boom\n  at f (a.js:1:2)\n")
    assert (trace["has_stack_trace"], trace["num_lines"], trace["log_length"]) == (1, 2, 23)


def test_normalise_follows_its_order(spark):
    text = "2024-01-02T03:04:05 See HTTPS://x.y/z  /usr/local/bin/tool #12 v1.2.3 10:11:12 end"
    # lower-casing first turns the T of a date-time into t, which no longer matches
    assert value(spark, text, features.normalise) == "2024-01-02t see URL tool vVERSION end"


def test_guard_size(spark):
    raw = spark.createDataFrame([(1, "abcdef"), (2, "abc")], "log_id bigint, raw_content string")
    rows = guard_size(raw, 4).orderBy("log_id").collect()
    assert [(r.raw_content, r.truncated) for r in rows] == [("abcd", 1), ("abc", 0)]
