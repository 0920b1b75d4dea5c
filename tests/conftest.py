import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loglantern.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", memory="4g")
    yield session
    session.stop()


@pytest.fixture
def read(spark):
    """Parse one log given as text: its record, stages and entries."""
    from loglantern.operators import parse
    from loglantern.sources.raw_logs import split_lines

    def parsed(text, **kwargs):
        raw = spark.createDataFrame([(1, text)], "log_id bigint, raw_content string")
        facts = parse.read_lines(split_lines(raw), **kwargs)
        rolled = parse.roll_up(facts, headers=True)
        record = parse.log_counts(rolled).first()
        stages = parse.stages(rolled).orderBy("stage_order").collect()
        entries = parse.entries(facts).orderBy("line_number").collect()
        return record, stages, entries

    return parsed


@pytest.fixture
def read_legacy(spark):
    """Legacy reading of one log: totals, stages, top texts and the report's lines."""
    from loglantern.operators import legacy
    from loglantern.sources.raw_logs import split_lines

    def parsed(text):
        raw = spark.createDataFrame([(1, text)], "log_id bigint, raw_content string")
        facts = legacy.legacy_lines(split_lines(raw))
        rows = legacy.legacy_stage_rows(facts)
        totals = legacy.legacy_totals(rows)
        rollup = legacy.legacy_rollup(totals, legacy.finished_marks(facts))
        stages, top = legacy.legacy_stages(rows), legacy.legacy_top(facts, totals)
        report = legacy.legacy_report(rollup, legacy.retry_types(facts), stages, top)
        return (
            rollup.first(),
            stages.orderBy("stage_order").collect(),
            top.orderBy("kind", "position").collect(),
            [r.text for r in report.orderBy("section", "position").collect()],
        )

    return parsed
