"""The newest samples on a stream against the batch form, after every batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalmill.operators import latency
from signalmill.streaming import samples

ROWS = "phase string, start_ts timestamp, call_id bigint, latency_ms double, success boolean"


def made():
    """A phase with most samples, ties in time, a phase of one sample, failures and missing values."""
    rnd, start, out = random.Random(5), datetime(2024, 3, 1), []
    for k in range(400):
        phase = "hot" if k % 4 else rnd.choice("ab")
        at = start + timedelta(hours=rnd.choice([0, 1, 2, 30, 50, 100]))
        out.append((phase, at, k, rnd.choice([None, float(k)]) if k % 9 == 0 else k / 2, rnd.random() < 0.8))
    out += [("alone", start, 1000, 1.0, False), ("b", None, 1001, 2.0, True), ("b", start, None, 3.0, None)]
    rnd.shuffle(out)
    return out


def plain(rows, limit, keep_days):
    out = set()
    for phase in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == phase and None not in r[1:3]), key=lambda r: r[1:3], reverse=True)
        if keep_days is not None and own:
            own = [r for r in own if r[1] >= own[0][1] - timedelta(days=keep_days)]
        out |= {r[:4] for r in own[:limit]}
    return out


@pytest.mark.parametrize("limit, keep_days", [(12, None), (12, 2), (300, 1)])
def test_after_every_batch(spark, tmp_path, limit, keep_days):
    rows = made()
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    parts = [rows[:250], rows[250:260], rows[260:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, ROWS).coalesce(2).write.mode("append").parquet(source)
        samples.keep_available(spark.readStream.schema(ROWS).parquet(source), mark, limit, keep_days, 3)
        so_far = [r for p in parts[: k + 1] for r in p]
        kept = samples.last_samples(spark, mark, limit, keep_days)
        assert {tuple(r) for r in kept.collect()} == plain(so_far, limit, keep_days)
        counted = {tuple(r) for r in samples.counters(spark, mark).collect()}
        assert counted == {tuple(r) for r in latency.sample_counters(spark.createDataFrame(so_far, ROWS)).collect()}
    # No key of the state has more than the limit.
    state = samples._state(spark, mark, "kept")
    assert state.agg(F.max(F.size("calls"))).first()[0] <= limit
