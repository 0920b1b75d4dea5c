"""Every query against its SQL in DuckDB, by value."""

import os

import duckdb
import pytest
from llm_cases import SMALL

from loglantern.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


def comparable(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    rows = sorted((tuple(comparable(r[c]) for c in columns) for r in frame.collect()), key=repr)
    cursor = duck.execute(ORACLE[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    assert rows == sorted((tuple(comparable(r[p]) for p in places) for r in cursor.fetchall()), key=repr)
    assert rows


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
