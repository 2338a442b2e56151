"""The rate limit against a plain loop, with a hot session over many blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.operators import throttle
from signalmill.streaming import live


def brute(rows, gap):
    out, last = [], {}
    for name, t, k in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        kept = name not in last or t - last[name] >= gap
        if kept:
            last[name] = t
        out.append((name, t, k, kept))
    return sorted([*out, *((*r, False) for r in rows if r[0] is None or r[1] is None)], key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "session_id string, s bigint, k bigint")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def made(n, seed=1):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), rnd.randrange(6_000), k) for k in range(n)]
    return [*rows, ("one", 5, 0), (None, 7, 1), ("a", None, 2)]


@pytest.mark.parametrize("block", [7, 64, throttle.BLOCK])
def test_equals_a_plain_loop(spark, block):
    rows = made(700)
    got = throttle.throttled(frame(spark, rows), "k", 30_000, block=block).select("session_id", "s", "k", "kept")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 30)


def test_dense_rows_make_a_short_summary():
    micros = np.arange(50_000, dtype=np.int64) * 1_000
    upto, then = throttle._summary(micros, 30_000_000)
    # Every start in the first gap has an end of its own here, but no more than a gap of rows is listed.
    assert len(upto) <= 30_001
    quiet = np.arange(1_000, dtype=np.int64) * 60_000_000
    assert len(throttle._summary(quiet, 30_000_000)[0]) <= 2


def test_no_rows(spark):
    assert throttle.throttled(frame(spark, []), "k").collect() == []


def test_stream_goes_on_from_the_last_kept_row(spark, tmp_path):
    rows = [r for r in made(300, 2) if r[0] is not None and r[1] is not None]
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for low, high in ((0, 2_000), (2_000, 2_020), (2_020, 9_000)):
        frame(spark, [r for r in rows if low <= r[1] < high]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("session_id string, s bigint, k bigint, ts timestamp").parquet(source)
        live.run_available(stream, mark, throttle.throttle_writer(out, "k", 30_000), "append")
    got = spark.read.parquet(f"{out}/rows").select("session_id", "s", "k", "kept")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 30)


def test_many_short_sessions_share_the_calls_of_python(spark):
    rnd = random.Random(9)
    rows = [(f"s{k % 400}", rnd.randrange(300), k) for k in range(2_000)]
    told = throttle.throttled(frame(spark, rows), "k", 30_000)
    assert "FlatMapGroups" not in told._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, told.select("session_id", "s", "k", "kept").collect()), key=repr) == brute(rows, 30)
