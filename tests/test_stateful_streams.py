"""Chunks and gaps on streams against their batch forms, after every batch."""

import random

from pyspark.sql import functions as F

from signalmill.operators import chunks, signals
from signalmill.streaming import gaps, mining

VIEWS = "session_id string, v bigint, i bigint, role string, tool string, status string, error_code string, text string"
TEXTS = ["ok", "we should add a retry", "this is confusing", "Cron (error): gateway timed out", "", "fine"]


def made_views():
    """A session with most views, short ones, one of a single view."""
    rnd, out = random.Random(3), []
    for name, n in [("hot", 140), ("a", 23), ("b", 5), ("c", 1), ("d", 41)]:
        for v in range(n):
            role = rnd.choice(["user", "assistant", "toolCall", "toolResult"])
            failed = role == "toolResult" and rnd.random() < 0.4
            out.append((name, v, v + 10, role, "bash", "error" if failed else None, None, rnd.choice(TEXTS)))
    return out


def without_gap(rows):
    """The views of each session that come without a missing number before them."""
    have = {(r[0], r[1]) for r in rows}
    reach = {}
    for name in {r[0] for r in rows}:
        reach[name] = next(v for v in range(10**6) if (name, v) not in have)
    return [r for r in set(rows) if r[1] < reach[r[0]]]


def test_any_split_into_batches_gives_the_chunks_and_items_of_batch(spark, tmp_path):
    rows = made_views()
    order = rows[:]
    random.Random(8).shuffle(order)
    # One session in order, the others in any order, and some views twice.
    parts = [order[:60], [*order[60:130], *order[20:40]], order[130:]]
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    arrived = []
    for part in parts:
        arrived += part
        spark.createDataFrame(part, VIEWS).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(VIEWS).parquet(source)
        mining.mine_available(stream, out, mark, size=6, overlap=2)
        views = spark.createDataFrame(without_gap(arrived), VIEWS).cache()
        bounds = chunks.chunk_bounds(views, 6, 2).cache()
        got = mining.mined_chunks(spark, out).select("session_id", "chunk_idx", "start_v", "end_v")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bounds.collect()))
        expected = signals.mine(views, bounds)
        columns = expected.columns
        assert sorted(map(repr, mining.mined_items(spark, out).select(columns).collect())) == sorted(map(repr, expected.collect()))
    assert bounds.count() > 40 and expected.count() > 20


def test_sessions_of_one_group_are_put_away_and_go_on(spark, tmp_path):
    rows = made_views()
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    # Each batch has one half of the sessions, so the others rest; half of the views come before their turn.
    early = [r for r in rows if r[1] % 9 < 5]
    late = [r for r in rows if r[1] % 9 >= 5]
    for part in (early, [r for r in late if r[0] in "ab"], [r for r in late if r[0] not in "ab"]):
        spark.createDataFrame(part, VIEWS).coalesce(1).write.mode("append").parquet(source)
        mining.mine_available(spark.readStream.schema(VIEWS).parquet(source), out, mark, 6, 2, groups=1, idle=1)
    views = spark.createDataFrame(rows, VIEWS)
    bounds = chunks.chunk_bounds(views, 6, 2)
    got = mining.mined_chunks(spark, out).select("session_id", "chunk_idx", "start_v", "end_v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bounds.collect()))


def gaps_of(rows, late):
    out = []
    for name in {n for n, _ in rows}:
        own = sorted(t for n, t in rows if n == name and (n, t) not in late)
        out += [(name, t, None if k == 0 else (t - own[k - 1]) * 1000.0, False) for k, t in enumerate(own)]
    return sorted([*out, *((n, t, None, True) for n, t in late)], key=repr)


def test_gaps_of_unordered_rows_with_a_hot_session_and_late_rows(spark, tmp_path):
    rnd = random.Random(4)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    hours = [[(n, 3600 * h + rnd.randrange(3600)) for h in range(first, last) for n in "hhhha" for _ in range(6)] for first, last in ((0, 3), (2, 6), (5, 9))]
    hours = [sorted(set(x)) for x in hours]
    hours[1] = [x for x in hours[1] if x not in hours[0]]
    hours[2] = [x for x in hours[2] if x not in hours[1]]
    late = [("h", 30), ("a", 3601), ("z", 5)]
    late = [x for x in late if all(x not in h for h in hours)]
    hours[2] += late
    schema = "session_id string, ts timestamp"
    for part in hours:
        rnd.shuffle(part)
        df = spark.createDataFrame(part, "session_id string, s bigint").select("session_id", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(2).write.mode("append").parquet(source)
        gaps.release_available(spark.readStream.schema(schema).parquet(source), out, mark, "1 hour")
    rows = [x for part in hours for x in part]
    got = gaps.settled(spark, out, mark).select("session_id", F.unix_seconds("ts"), "gap_ms", "late", "rapid").collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == gaps_of(rows, set(late))
    assert all(r.rapid == (r.gap_ms is not None and r.gap_ms < 10_000) for r in got)
    # The buckets of the hot session were groups of their own, and the passed ones are written.
    written = spark.read.parquet(f"{out}/gaps")
    assert written.filter("session_id = 'h' AND NOT late").count() > 20 and written.filter("late").count() == len(late)


def test_no_rows(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([("s", 1)], "session_id string, s bigint").select("session_id", F.timestamp_seconds("s").alias("ts")).write.parquet(source)
    gaps.release_available(spark.readStream.schema("session_id string, ts timestamp").parquet(source), out, mark)
    assert [tuple(r)[2:] for r in gaps.settled(spark, out, mark).collect()] == [(None, False, False)]


def test_sessions_of_a_bucket_share_groups(spark, tmp_path):
    rows = [(f"s{k}", 1_700_000_000 + 60 * (k % 3)) for k in range(200)] * 2 + [(None, 1_700_000_000)]
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    made = spark.createDataFrame(rows, "session_id string, s bigint").select("session_id", F.timestamp_seconds("s").alias("ts"))
    made.write.parquet(source)
    gaps.release_available(spark.readStream.schema(made.schema).parquet(source), out, mark)
    state = gaps.with_rocksdb(
        spark, lambda: spark.read.format("statestore").option("path", mark).option("stateVarName", "packs").load().select("key").distinct().count()
    )
    assert 0 < state <= gaps.SHARDS
    told = gaps.settled(spark, out, mark).collect()
    assert len(told) == 401 and sorted(r.gap_ms for r in told if r.gap_ms is not None) == [0.0] * 200
