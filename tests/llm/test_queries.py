"""The registered queries: against DuckDB where SQL can express them, and the pipeline against its operators' rules."""

import os

import duckdb
import pytest

from signalmill.llm.oracle import all_sql
from signalmill.llm.queries import all_queries

SF = os.environ.get("SIGNALMILL_TEST_SF", "/root/testdata/sf0.001")


def normal(value):
    return repr(round(value, 12)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(all_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(normal(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    assert got == expected and got


def test_all_operators_have_a_query():
    assert [int(k[2:].split("_")[0]) for k in all_queries()] == list(range(1, 14))
