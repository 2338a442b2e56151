"""Quantile sketches per day: merged over any days they stay within their rank error, hot phase included."""

from datetime import date, datetime, timedelta

import numpy as np

from signalmill.operators import latency
from signalmill.operators.stable import stable

SCHEMA = "phase string, call_id long, start_ts timestamp, latency_ms double, success boolean"


def samples(spark, n=30_000):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        phase = "hot" if k % 3 else f"p{k % 10}"
        value = float(np.round(rng.lognormal(3, 1), 1)) if k % 11 else 40.0  # many ties
        rows.append((phase, k, datetime(2024, 1, 1) + timedelta(days=int(k % 10), seconds=k), value, bool(k % 13)))
    rows += [("hot", n, None, 1.0, True), ("hot", n + 1, datetime(2024, 1, 2), None, True), (None, n + 2, datetime(2024, 1, 2), 5.0, True)]
    return rows


def rank_error(values, found, p):
    values = np.sort(values)
    under, upto = np.searchsorted(values, found) / len(values), np.searchsorted(values, found, "right") / len(values)
    return max(0.0, p - upto, under - p)


def test_merged_days(spark, tmp_path):
    rows = samples(spark)
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    sketches = latency.latency_sketches(table, size=200)
    sketches.write.partitionBy("day").parquet(str(tmp_path / "days"))
    sketches = spark.read.schema(sketches.schema).parquet(str(tmp_path / "days"))
    for first, last in ((None, None), ("2024-01-03", "2024-01-05"), ("2024-01-10", None)):
        part = [r for r in rows if r[4] and r[2] and r[3] is not None]
        part = [r for r in part if (first or "") <= str(r[2].date()) <= (last or "9")]
        found = stable(latency.sketch_quantiles(sketches, first, last))
        got = {r.phase: r for r in found.collect()}
        assert set(got) == {r[0] for r in part}
        own = spark.createDataFrame(part, SCHEMA)
        told = {(r.phase, r.point): r for r in latency.rank_errors(own, found.filter("phase IS NOT NULL")).collect()}
        for phase, r in got.items():
            values = [x[3] for x in part if x[0] == phase]
            assert r.n == len(values)
            for name, p in latency.POINTS.items():
                # Three times the error that holds with 99 % confidence.
                error = rank_error(values, r[name], p)
                assert error <= 3 * latency.sketch_rank_error(200)
                if phase is not None:
                    assert told[phase, name].n == len(values) and abs(told[phase, name].rank_error - error) < 1e-12


def test_few_values_are_exact_and_days_prune(spark, tmp_path):
    rows = [("a", k, datetime(2024, 1, 1 + k % 3), float(k), True) for k in range(100)]
    sketches = latency.latency_sketches(spark.createDataFrame(rows, SCHEMA))
    assert {(r.day, r.n) for r in sketches.collect()} == {(date(2024, 1, 1), 34), (date(2024, 1, 2), 33), (date(2024, 1, 3), 33)}
    only = latency.sketch_quantiles(sketches, "2024-01-02", "2024-01-02").first()
    assert only.n == 33 and only.p50_ms in {float(k) for k in range(1, 100, 3)}
    error = latency.rank_errors(spark.createDataFrame(rows, SCHEMA), latency.sketch_quantiles(sketches))
    assert [r.rank_error for r in error.collect()] == [0.0, 0.0, 0.0]


def test_empty(spark):
    sketches = latency.latency_sketches(spark.createDataFrame([], SCHEMA))
    assert sketches.count() == 0 and latency.sketch_quantiles(sketches).count() == 0
