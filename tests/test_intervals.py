"""Bootstrap intervals against a plain-Python run with the same weights."""

import random

import numpy as np
from pyspark.sql import functions as F

from signalmill.operators import evaluate, intervals

CLASSES = ("a", "b", "c")
SCHEMA = "id long, truth string, predicted string, n int, cell string"


def rows_of(n):
    rng = random.Random(8)
    names = ["a", "a", "a", "b", "x", None]
    rows = [(k, t := rng.choice(names), t if rng.random() < 0.7 else rng.choice(names), 1, "z") for k in range(n)]
    return rows + rows[:3] + [(None, "a", "b", 1, "z")]


def poisson(u):
    n, chance, upto = 0, np.exp(-1), np.exp(-1)
    while u >= upto:
        n += 1
        chance /= n
        upto += chance
    return n


def figures(cells):
    """Figures of (truth, predicted, weight) rows."""
    out = {}
    inside = [(t, p, w) for t, p, w in cells if t in CLASSES and p in CLASSES]
    for c in CLASSES:
        tp = sum(w for t, p, w in inside if t == p == c)
        fp = sum(w for t, p, w in inside if t != c and p == c)
        fn = sum(w for t, p, w in inside if t == c and p != c)
        out[c, "precision"] = tp / (tp + fp) if tp + fp else 0.0
        out[c, "recall"] = tp / (tp + fn) if tp + fn else 0.0
        out[c, "f1"] = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    total = sum(w for _, _, w in cells)
    out["all", "accuracy"] = sum(w for t, p, w in cells if t is not None and t == p) / total if total else 0.0
    return out


def test_against_plain_python(spark):
    rows, replicates = rows_of(150), 40
    table = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for parts in (1, 7):  # the same whatever the partitions
        found = intervals.class_intervals(table.repartition(parts), "truth", "predicted", "id", CLASSES, replicates, 0.9, seed=3)
        got[parts] = {(r.label, r.metric): (r.estimate, r.low, r.high) for r in found.collect()}
    assert got[1] == got[7]

    hashes = {r.id: r.h for r in table.select("id", F.xxhash64(F.lit(3), "id").alias("h")).collect()}
    mask = (1 << 64) - 1

    def weight(id, k):
        x = (hashes[id] + k * 0x9E3779B97F4A7C15) & mask
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return poisson(((x ^ (x >> 31)) >> 11) * 2.0**-53)

    plain = figures([(t, p, 1) for _, t, p, _, _ in rows])
    drawn = [figures([(t, p, weight(i, k)) for i, t, p, _, _ in rows]) for k in range(1, replicates + 1)]
    for name, (estimate, low, high) in got[1].items():
        ends = np.percentile([d[name] for d in drawn], [5, 95])
        assert np.allclose([estimate, low, high], [plain[name], *ends], atol=1e-12), name
    assert set(got[1]) == set(plain)


def test_estimates_are_the_metrics_and_weights_are_poisson(spark):
    table = spark.createDataFrame(rows_of(400), SCHEMA)
    found = {(r.label, r.metric): r for r in intervals.class_intervals(table, "truth", "predicted", "id", CLASSES, 200).collect()}
    for r in evaluate.class_metrics(table, "truth", "predicted", CLASSES).collect():
        assert [round(found[r.label, m].estimate, 3) for m in ("precision", "recall")] == [r.precision, r.recall]
        assert found[r.label, "precision"].n == r.tp + r.fp and found[r.label, "recall"].n == r.tp + r.fn
    assert round(found["all", "accuracy"].estimate, 3) == evaluate.accuracy(table, "truth", "predicted").first().accuracy
    assert found["c", "f1"].low == found["c", "f1"].high == 0.0
    drawn = intervals.weights(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 2000), 100)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02


def test_empty(spark):
    found = intervals.class_intervals(spark.createDataFrame([], SCHEMA), "truth", "predicted", "id", CLASSES, 10).collect()
    assert {(r.label, r.metric, r.n, r.estimate, r.low, r.high) for r in found} == {
        (c, m, 0, 0.0, 0.0, 0.0) for c in CLASSES for m in ("precision", "recall", "f1")
    }
