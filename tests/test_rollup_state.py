"""Daily deliveries and retractions against one full roll-up."""

import random

from pyspark.sql import functions as F

from signalmill.operators import rollup
from signalmill.operators.rollup_state import RollupState

ITEM = "item_id string, session_id string, kind string, summary string, severity string, tags array<string>, pos struct<session_id: string, chunk_idx: bigint, rank: bigint>"


def made(n, seed=2):
    """Items of which two in five share one signature."""
    rnd, out = random.Random(seed), []
    for k in range(n):
        word = "gateway" if rnd.random() < 0.4 else rnd.choice("alpha beta gamma delta omega".split())
        kind = rnd.choice(["error", "other", "user_frustration"]) if word != "gateway" else "error"
        tags = rnd.sample(["incident", "cron", "tool", "x"], rnd.randrange(4))
        session = f"s{rnd.randrange(9)}"
        severity = rnd.choice(["low", "high", "medium", "unknown"])
        out.append((f"i{k}", session, kind, f"{word} timed out", severity, tags, (session, rnd.randrange(30), k)))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, ITEM)
    source = F.struct(F.col("session_id").alias("file_hint"), F.lit("c").alias("chunk_id"))
    return df.withColumn("span", F.struct(F.lit(0).alias("start_i"), F.lit(1).alias("end_i"))).withColumn("source", source)


def rows_of(clusters):
    return sorted(repr(tuple(r)) for r in clusters.select(sorted(clusters.columns)).collect())


def test_deliveries_and_retractions_equal_a_full_run(spark, tmp_path):
    items = made(160)
    days = [items[:50], items[50:51], items[51:110], [], items[110:]]
    gone = [[], ["i3"], [i[0] for i in items[:50] if i[3].startswith("gateway")][:9], ["i3", "nothing", "i50"], ["i60", "i61"]]
    state = RollupState(spark, str(tmp_path), buckets=8)
    alive, touched = [], []
    for k, (new, lost) in enumerate(zip(days, gone, strict=True)):
        asked = spark.createDataFrame([(x,) for x in lost], "item_id string")
        touched.append(state.add(frame(spark, new), asked, k).count())
        alive = [*(i for i in alive if i[0] not in lost), *new]
        if k in (1, 4):
            assert rows_of(state.clusters(k + 1)) == rows_of(rollup.rollups(frame(spark, alive)))
    # One item touches one signature, two retractions of which one is empty touch at most two.
    assert touched[1] <= 2 and touched[3] <= 2 < touched[0]
    # A repeated batch replaces itself.
    state.add(frame(spark, days[4]), spark.createDataFrame([("i60",), ("i61",)], "item_id string"), 4)
    assert rows_of(state.clusters(5)) == rows_of(rollup.rollups(frame(spark, alive)))


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    state = RollupState(spark, str(tmp_path), buckets=8)
    state.add(frame(spark, made(80)), None, 0)
    rows = state._read("facets", "cell bigint, signature_id string", 1, [3])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r[0] for r in rows.select("bucket").distinct().collect()} <= {3}


def test_nothing_delivered(spark, tmp_path):
    state = RollupState(spark, str(tmp_path), buckets=4)
    assert state.add(frame(spark, []), None, 0).count() == 0
    assert state.clusters(1).count() == 0
    assert state.add(frame(spark, made(3)), None, 1).count() > 0


def test_labels_are_worked_out_per_text_and_not_per_item(spark):
    # 60 items of two texts, whose first ones lie in different sessions; a signature joins both texts.
    rows = [(f"i{k}", f"s{k % 7}", "error", ("gateway timed out", "Gateway timed out!")[k % 2], "low", ["x", "x"], (f"s{k % 7}", 0, k)) for k in range(60)]
    items = frame(spark, rows)
    counts = {(r.facet, r.value): (r.n, tuple(r.first_pos)) for r in rollup.facet_counts(items).collect()}
    assert counts["kind", "error"] == (60, ("s0", 0, 0))
    assert counts["summary", "Gateway timed out!"] == (30, ("s0", 0, 7))
    assert counts["session", "s3"] == (9, ("s3", 0, 3))
    assert [(r.value, r.n) for r in rollup.tag_counts(items).collect()] == [("x", 120)]
    assert [r.ref.item_id for r in rollup.first_items(items, 3).orderBy("_rank").collect()] == ["i0", "i7", "i14"]
    # The rules read rows that are already counted: below the first count there are none.
    plan = rollup.tag_counts(items)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and "sha2" not in plan.split("Aggregate")[-1].split("\n", 1)[1]
