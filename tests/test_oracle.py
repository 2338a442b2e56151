"""Every registered query against its DuckDB twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from signalmill.plans.oracle import all_sql
from signalmill.plans.queries import all_queries

SF = os.environ.get("SIGNALMILL_TEST_SF", "/root/testdata/sf0.001")
TABLES = "events documents benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def normal(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


def test_every_query_has_a_twin():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(all_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(normal(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(normal(r[c]) for c in columns) for r in df.collect()) == expected
