"""Every query against its SQL in DuckDB, by value, on the smallest tables."""

import os

import duckdb
import pytest
from small_tables import SMALL

from loglantern.plans import all_oracles, all_queries

#: Fits: no SQL, tested in test_io.
SLOW = {n for n in all_queries() if n not in all_oracles()}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        if file.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


def comparable(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", [n for n in all_queries() if n not in SLOW])
def test_query_matches_its_sql(spark, duck, name):
    frame = all_queries()[name](spark, SMALL)
    columns = sorted(frame.columns)
    rows = sorted((tuple(comparable(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert rows
    sql = all_oracles().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    expected = sorted((tuple(comparable(r[p]) for p in places) for r in cursor.fetchall()), key=repr)
    assert rows == expected


def test_every_oracle_has_its_query():
    assert set(all_oracles()) <= set(all_queries())
