"""Merging and components against all-pairs loops, hot groups included."""

import random

import pytest
from pyspark.sql import functions as F

from signalmill.operators import merge
from signalmill.operators.graph import components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    expected = union_find({n for e in edges if e[0] != e[1] for n in e}, edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == expected


@pytest.fixture(scope="module")
def clusters(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for n in range(240):
        if n % 3 == 0:  # one template holds a third of all clusters
            summary = f"gateway restart failed while syncing shard{n} node{n % 7}"
        else:
            summary = " ".join(rng.sample(words, rng.randint(1, 7)))
        rows.append((f"id{n:03d}", rng.choice(["defect", "ux_friction"]), summary))
    rows += [("id900", "defect", "the of"), ("id901", "defect", ""), ("id902", "defect", "")]
    return rows, spark.createDataFrame(rows, "signature_id string, kind_v2_primary string, canonical_summary string").cache()


def similar(rows, threshold):
    sets = {i: (k, frozenset(s.split())) for i, k, s in rows}
    out = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a][0] == sets[b][0] and sets[a][1] and sets[b][1]:
                x, y = sets[a][1], sets[b][1]
                sim = len(x & y) / len(x | y)
                if sim >= threshold:
                    out[a, b] = sim
    return out


@pytest.mark.parametrize("threshold", [0.62, 0.5])
def test_pairs_are_complete(clusters, threshold):
    rows, df = clusters
    got = {(r.a, r.b): r.sim for r in merge.similar_pairs(df, threshold, nearest=1000).collect()}
    copies = {}
    for i, k, s in sorted(rows):
        copies.setdefault((k, frozenset(s.split())), i)
    kept = [r for r in rows if r[0] in copies.values()]
    assert got == pytest.approx(similar(kept, threshold))


@pytest.mark.parametrize("nearest", [1, 3])
def test_nearest_pairs(clusters, nearest):
    rows, df = clusters
    copies = {}
    for i, k, s in sorted(rows):
        copies.setdefault((k, frozenset(s.split())), i)
    pairs = similar([r for r in rows if r[0] in copies.values()], 0.5)
    wanted = set()
    for x in {i for p in pairs for i in p}:
        partners = sorted((-s, a if b == x else b) for (a, b), s in pairs.items() if x in (a, b))
        wanted |= {tuple(sorted((x, y))) for _, y in partners[:nearest]}
    assert {(r.a, r.b) for r in merge.similar_pairs(df, 0.5, nearest).collect()} == wanted


@pytest.mark.parametrize("block", [5, 400])
def test_edges_give_the_components_of_all_pairs(clusters, block):
    rows, df = clusters
    pairs = similar(rows, 0.62)
    expected = {n: c for n, c in union_find({n for p in pairs for n in p}, pairs).items()}
    got = {r.signature_id: r.component for r in merge.merge_components(df, block=block).collect()}
    assert got == expected


def test_a_template_of_long_summaries_stays_linear(spark):
    """A third of the clusters share a template of 30 words; edges do not grow with its pairs."""
    long = " ".join(f"w{i}" for i in range(28))
    rows = [(f"id{n:05d}", "defect", f"{long} a{n} b{n % 50}" if n % 3 == 0 else f"x{n} y{n} z{n}") for n in range(6000)]
    df = spark.createDataFrame(rows, "signature_id string, kind_v2_primary string, canonical_summary string")
    edges = merge.merge_edges(df).cache()
    # 12 prefix words, 5 blocks a word: a set is compared in 5 groups of each word.
    assert edges.count() < 2000 * 12 * 5
    got = components(edges)
    assert got.count() == 2000 and got.select("component").distinct().count() == 1


def test_decisions(spark):
    answers = [
        ("a", "b", 'ok {"decision": "MERGE", "confidence": 0.7}'), ("a", "c", '{"decision": "merge", "confidence": 0.69}'),
        ("a", "d", '{"decision": "separate", "confidence": 1}'), ("a", "e", "no json"), ("a", "f", None),
    ]
    got = merge.merge_decisions(spark.createDataFrame(answers, "a string, b string, answer string")).collect()
    assert [(r.a, r.b) for r in got] == [("a", "b")]


def test_incident_flag_survives_the_cut_of_tags(spark):
    """A member whose incident tag is no top tag still makes the merged cluster an incident."""
    from signalmill.operators import rollup

    def item(n, summary, tags):
        return (f"i{n}", f"s{n}", "error", summary, "low", tags, n)

    many = [f"t{k}" for k in range(9)]
    rows = [item(n, f"gateway timeout seen in node cluster {w}", many) for n, w in enumerate(["alpha", "beta", "alpha", "beta"])]
    rows.append(item(9, "gateway timeout seen in node cluster beta", [*many, "incident"]))
    items = spark.createDataFrame(rows, "item_id string, session_id string, kind string, summary string, severity string, tags array<string>, pos int")
    clusters = rollup.rollups(
        items.withColumn("span", F.expr("named_struct('start_i', 0L, 'end_i', 1L)")).withColumn(
            "source", F.expr("named_struct('file_hint', 's', 'chunk_id', 'c')")
        )
    ).cache()
    members = merge.merge_components(clusters)
    merged = merge.merged_rollups(clusters, members).collect()
    assert [(r.merged, r.incident, r.tier) for r in merged] == [(clusters.count(), True, 1)]
    assert not any(t.value == "incident" for t in merged[0].tags_top)
    assert not merge.merged_rollups(clusters, members, compat=True).first().incident


def test_hot_partners_are_all_listed_and_asked(spark):
    """Pairs beyond the 20 nearest are listed, counted and put to the model."""
    from signalmill.operators import requests

    # A template of 30 clusters: equal similarity (4 of 6 words) for all pairs.
    hot = [(f"id{n:02d}", "defect", f"alpha beta gamma delta x{n}") for n in range(30)]
    df = spark.createDataFrame([*hot, ("id99", "defect", "alpha beta gamma delta x0")], "signature_id string, kind_v2_primary string, canonical_summary string").cache()
    pairs = {(r.a, r.b) for r in merge.similar_pairs(df).collect()}
    assert pairs == {(f"id{a:02d}", f"id{b:02d}") for b in range(30) for a in range(b)}
    members = {r.signature_id: (r.component, r.rep, r.n_links) for r in merge.similar_members(df, block=7).collect()}
    assert members == {f"id{n:02d}": ("id00", f"id{n:02d}", 29) for n in range(30)} | {"id99": ("id00", "id00", 29)}

    facts = df.withColumn("kind_v2_counts", F.lit("{}")).withColumn("tags_top", F.lit("[]"))
    band = (0.6, 0.7)
    assert {(r.a, r.b) for r in merge.merge_requests(facts, *band).collect()} == pairs

    def only_last(system, user):
        """Merge nothing but the pair that is last in every order."""
        return '{"decision": "%s", "confidence": 1}' % ("merge" if "x28" in user and "x29" in user else "separate")

    seen = spark.sparkContext.accumulator(0)

    def ask(asked, complete):
        seen.add(asked.count())
        return requests.ask(asked, complete)

    added = merge.asked_edges(facts, lambda asked: ask(asked, only_last), *band, nearest=3, block=7)
    assert [(r.a, r.b) for r in added.collect()] == [("id28", "id29")]
    assert 435 - 28 <= seen.value <= 435  # each pair once; less those that the merge settles
    seen.value = 0
    added = merge.asked_edges(facts, lambda asked: ask(asked, lambda *_: '{"decision": "merge", "confidence": 1}'), *band, nearest=3)
    assert {c.component for c in components(added).collect()} == {"id00"} and seen.value < 435
