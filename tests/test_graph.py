"""Connected components: hubs, long paths, dense groups, and growth by batches."""

import random

import numpy as np
import pytest

from signalmill.operators import graph


def brute(edges):
    low = {}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        if a == b or a is None or b is None:
            continue
        low.setdefault(a, a)
        low.setdefault(b, b)
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {x: root(x) for x in low}


def made(seed=1):
    rnd = random.Random(seed)
    star = [(5_000, x) for x in range(1_000, 1_600)]
    low_star = [(0, x) for x in range(2_000, 2_300)]
    path = [(x, x + 1) for x in range(100, 220)]
    dense = [(a, b) for a in range(300, 325) for b in range(300, 325)]
    loose = [(rnd.randrange(6_000, 9_000), rnd.randrange(6_000, 9_000)) for _ in range(900)]
    edges = [*star, *low_star, *path, *dense, *loose, (7, 7), (8, None)]
    rnd.shuffle(edges)
    return edges


def rows(spark, edges, kind="bigint"):
    return spark.createDataFrame(edges, f"a {kind}, b {kind}")


def test_components(spark):
    edges = made()
    got = {r.id: r.component for r in graph.components(rows(spark, edges).repartition(6)).collect()}
    assert got == brute(edges)


def test_strings_and_no_edges(spark):
    edges = [(f"n{a:05d}", f"n{b:05d}") for a, b in made(2) if b is not None][:700]
    got = {r.id: r.component for r in graph.components(rows(spark, edges, "string")).collect()}
    assert got == brute(edges)
    assert graph.components(rows(spark, [])).collect() == []


def test_a_hub_is_dealt_to_many_tasks(spark):
    """The join of a hub's neighbours with their minimum has no group of more than a few hundredths of them."""
    from pyspark.sql import functions as F

    star = spark.range(1, 20_001).select(F.lit(0).cast("bigint").alias("x"), F.col("id").alias("y"))
    dealt = star.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(graph.SALTS)))
    assert max(r["count"] for r in dealt.groupBy("x", "salt").count().collect()) < 20_000 / graph.SALTS * 1.5
    told = graph._with_least(star, graph.SALTS)
    assert told.count() == 20_000 and told.filter("m <> 0").isEmpty()


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_growth_by_batches_equals_a_full_run(spark, tmp_path, kind):
    edges = made(3)
    if kind == "string":
        edges = [(f"n{a:05d}", f"n{b:05d}") for a, b in edges if b is not None]
    edges = [e for e in edges if e[0] != e[1]]
    parts = [edges[:300], edges[300:1100], [], edges[1100:], edges[:50]]
    path = str(tmp_path)
    for k, part in enumerate(parts):
        graph.add_batch(rows(spark, part, kind), path, k)
        now = graph.read_grouping(spark, path, k + 1, kind)
        assert {r.id: r.component for r in now.current().collect()} == brute([e for p in parts[: k + 1] for e in p])
    nodes = now.members.count()
    assert nodes == len(brute(edges))
    # A repeated batch replaces itself.
    graph.add_batch(rows(spark, parts[4], kind), path, 4)
    assert graph.read_grouping(spark, path, 5, kind).members.count() == nodes


def test_a_small_batch_touches_little(spark, tmp_path):
    path = str(tmp_path)
    graph.add_batch(rows(spark, [(10, x) for x in range(11, 3_000)]), path, 0)
    change = graph.add_batch(rows(spark, [(2_000, 5), (4_000, 4_001)]), path, 1)
    # The large component gets a smaller name by one alias; none of its members is rewritten.
    assert sorted(map(tuple, change.members.collect())) == [(5, 5), (4_000, 4_000), (4_001, 4_000)]
    assert sorted(map(tuple, change.aliases.collect())) == [(10, 5)]
    assert graph.read_grouping(spark, path, 2).current().filter("component = 5").count() == 2_991


def test_stars_hold_on_to_what_they_contracted(monkeypatch):
    monkeypatch.setattr(graph, "CONTRACTED", 300)
    rng = np.random.default_rng(4)
    # The same dense group of 50 nodes again and again leaves one edge per node but the smallest, not one set per piece.
    pieces = [tuple(rng.integers(100, 150, (2, 200))) for _ in range(20)]
    found = [x for u, v in graph.stars(iter(pieces)) for x in zip(u.tolist(), v.tolist(), strict=True)]
    assert sorted(found) == [(k, 100) for k in range(101, 150)]


def test_a_node_joined_in_many_tasks_has_one_edge_before_the_rounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "_state", lambda edges, f=graph._state: seen.append(f(edges)[0]) or f(edges))
    # Three neighbours for each of 100 nodes, each in a task of its own.
    edges = spark.range(300, numPartitions=3).selectExpr("id % 100 + 10 AS a", "id div 100 AS b")
    found = {r.id: r.component for r in graph.components(edges).collect()}
    assert found == {k: 0 for k in [0, 1, 2, *range(10, 110)]}
    assert seen[0] <= 100 + 2 * 4
