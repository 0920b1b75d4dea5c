"""Platform rules: adding a platform means adding a record, not code on the hot path."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern.functions.text import any_case, first_match


@dataclass(frozen=True)
class Capture:
    """Text to take from a line: group 1 of the pattern, tried only where the hint occurs."""

    hint: str
    pattern: str

    def of(self, line: Column) -> Column:
        return F.when(line.contains(self.hint), first_match(line, self.pattern))


@dataclass(frozen=True)
class PlatformRules:
    """How the logs of one platform are read."""

    platform: str
    markers: tuple[str, ...]  # any of these anywhere in the log names the platform
    stage_open: Capture  # the stage a line opens
    strip_stage: bool
    context_open: Capture | None  # what lines are counted under; None: the open stage
    context_chars: int | None
    skip_echo: bool  # shell echo lines are neither classified nor counted
    error_note: Capture | None  # the message of an annotated error
    warning_note: Capture | None
    fail_marks: tuple[str, ...]  # a line of the stage that fails it (case-sensitive)
    fail_mask: str | None  # unless the line holds this
    critical: bool  # an error inside a stage that says "critical" is critical
    # status and the pattern anywhere in the log that tells it; the first status told wins
    status_signs: tuple[tuple[str, str], ...]
    sign_hints: tuple[str, ...]  # lower-case pieces, one of which any of the signs holds
    failed_stage_fails: bool  # without a sign, a failed stage fails the build
    has_header: bool  # trigger and duration are read from the text


PIPELINE = PlatformRules(
    platform="jenkins",
    markers=fx.PIPELINE_MARKERS,
    stage_open=Capture("[Pipeline] { (", fx.PIPELINE_STAGE_OPEN),
    strip_stage=False,
    context_open=None,
    context_chars=None,
    skip_echo=True,
    error_note=None,
    warning_note=None,
    fail_marks=fx.PIPELINE_FAIL_MARKS,
    fail_mask=None,
    critical=True,
    status_signs=tuple((s, any_case(p)) for s, p in fx.BUILD_STATUS_PATTERNS),
    sign_hints=fx.BUILD_STATUS_HINTS,
    failed_stage_fails=False,
    has_header=True,
)

ACTIONS = PlatformRules(
    platform="github-actions",
    markers=fx.ACTIONS_MARKERS,
    stage_open=Capture("##[group]", fx.ACTIONS_GROUP),
    strip_stage=True,
    context_open=Capture("##[command]", fx.ACTIONS_COMMAND),
    context_chars=fx.ACTIONS_COMMAND_CHARS,
    skip_echo=False,
    error_note=Capture("::error::", fx.ACTIONS_ERROR_NOTE),
    warning_note=Capture("::warning::", fx.ACTIONS_WARNING_NOTE),
    fail_marks=fx.ACTIONS_FAIL_MARKS,
    fail_mask=fx.ACTIONS_FAIL_MASK,
    critical=False,
    status_signs=(("SUCCESS", fx.ACTIONS_SUCCESS),),
    sign_hints=fx.ACTIONS_SUCCESS_HINTS,
    failed_stage_fails=True,
    has_header=False,
)

# A step's own lines counted under the step, rather than under an equally named command.
ACTIONS_BY_GROUP = replace(ACTIONS, context_open=None, context_chars=None)

PLATFORM_RULES = (PIPELINE, ACTIONS)  # in order: the first whose markers are found wins
UNKNOWN_PLATFORM = "unknown"
