"""Every registered query that has a DuckDB twin returns the same rows as it, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from skyledger import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
ORACLES = registry.oracle_sql()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    frame = registry.queries()[name](spark, data)
    columns = sorted(frame.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    theirs = duck.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    places = [names.index(c) for c in sorted(names)]
    assert columns == sorted(names)
    assert ours == sorted((tuple(plain(row[p]) for p in places) for row in theirs.fetchall()), key=str)


def test_queries_without_sql_have_rows(spark, data):
    for name in registry.queries().keys() - ORACLES.keys():
        rows = registry.queries()[name](spark, data).collect()
        assert rows and len(set(map(str, rows))) == len(rows)
