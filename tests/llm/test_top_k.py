import math
import random

import pytest

from signalmill.llm import top_k

SCHEMA = "vec_id bigint, embedding array<float>, id string, v string, block int, score double"


def brute(rows, every, k, scale):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(scale * x) for x in v]
        best[i] = min(best.get(i, whole), whole)
    out = []
    for q in (i for i in best if i % every == 0):
        found = sorted((-sum(a * b for a, b in zip(best[q], v)), i) for i, v in best.items() if i != q)[:k]  # noqa: B905
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def check(spark, rows, every=5, k=5, scale=256, cells=top_k.CELLS, **sizes):
    df = spark.createDataFrame([(i, v, "x", "y", 1, 0.5) for i, v in rows], SCHEMA)
    numbers = top_k.quantised(df, "vec_id", "embedding", scale)
    found = top_k.nearest(top_k.index(numbers, cells), numbers.filter(f"id % {every} = 0"), k, **sizes)
    assert found.columns == ["query_id", "rank", "id", "score"]
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute(rows, every, k, scale)
    return got


def vectors(n, width, seed, spread=1.0):
    rnd = random.Random(seed)
    return [(i, [float(round(rnd.gauss(0, spread), 3)) for _ in range(width)]) for i in range(n)]


def as_float(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_many_blocks_and_lanes(spark):
    rows = as_float(vectors(700, 6, 1))
    check(spark, rows, every=50, cells=6 * 64, query_block=4, lane=3)


def test_one_block(spark):
    check(spark, as_float(vectors(300, 16, 2, 0.2)), every=50)


def test_odd_vectors(spark):
    odd = [
        (0, [1.0, -2.0]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (None, [1.0, 1.0]),
        (5, []), (6, [1.0]), (7, [1.0, -2.0, 3.0]), (8, [0.0, 0.0]), (10, [1.0, -2.0]), (10, [0.5, -2.0]), (11, [1.0, -2.0]),
        (11, [1.0, -2.0]), (15, [1e6, -1e6]), (-5, [-0.001, 0.001]),
    ]
    check(spark, as_float(odd))
    check(spark, as_float(odd), k=100, cells=1)


def test_ties_and_a_hot_vector(spark):
    rows = [(i, [0.5, 0.25, -0.125] if i % 3 else [0.01 * (i % 7), 0.0, 1.0]) for i in range(400)]
    check(spark, as_float(rows), every=50, cells=64 * 3, query_block=3)
    check(spark, as_float(rows), every=50)


def test_empty_and_lonely(spark):
    assert check(spark, []) == []
    assert check(spark, [(5, [1.0])]) == []
    assert check(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_values_beyond_the_range_end_in_an_error(spark):
    df = spark.createDataFrame([(1, [3e38], "", "", 1, 0.5)], SCHEMA)
    with pytest.raises(Exception, match="beyond 2"):
        top_k.quantised(df, "vec_id", "embedding", 256)
    df = spark.createDataFrame([(0, [1e13], "", "", 1, 0.5), (1, [1e13], "", "", 1, 0.5)], SCHEMA)
    rows = top_k.quantised(df, "vec_id", "embedding", 256)
    with pytest.raises(Exception, match="do not fit a long"):
        top_k.nearest(top_k.index(rows), rows, 1).collect()
