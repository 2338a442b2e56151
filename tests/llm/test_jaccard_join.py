import random
from collections import defaultdict

import numpy as np
import pytest

from signalmill.llm import jaccard_join
from signalmill.llm.common import words

from .cases import ODD, table


def grams(text, n=5):
    w = words(text)
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows, threshold=0.8):
    """(id, class, links, copies) per row."""
    sets = [grams(t) for _, t in rows]
    ids = [i for i, _ in rows]
    lowest, count = {}, defaultdict(int)
    for i, s in zip(ids, sets, strict=True):
        if s and i is not None:
            lowest[s] = min(i, lowest.get(s, i))
            count[s] += 1
    distinct = list(lowest)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    links = defaultdict(int)
    for x in range(len(distinct)):
        for y in range(x):
            a, b = distinct[x], distinct[y]
            if 5 * len(a & b) >= 4 * len(a | b):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for s in distinct:
        low[find(s)] = min(lowest[s], low.get(find(s), lowest[s]))
    out = []
    for i, s in zip(ids, sets, strict=True):
        out.append((i, low[find(s)], links[s], count[s]) if s and i is not None else (i, i, 0, 1))
    return sorted(map(repr, out))


def near_copies(seed, groups, most, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    shared = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(*length))]
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" " + shared if rng.random() < 0.3 else ""))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [400, 7])
def test_against_brute_force(spark, block):
    rows = near_copies(1, 40, 12, (3, 150)) + [(1000 + i if i is not None else None, t) for i, t in ODD] + [(5000, "a b")] * 2
    found = jaccard_join.classes(table(spark, rows), block=block)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    rows = near_copies(2, 1, 1, (200, 200))
    base = rows[0][1].split(" ")
    rng = random.Random(3)
    for i in range(1, 600):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    found = jaccard_join.classes(table(spark, rows).repartition(4), block=90)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)


def test_rows_that_stay(spark):
    rows = near_copies(4, 10, 6, (20, 80)) + [(1000 + i if i is not None else None, t) for i, t in ODD]
    left = jaccard_join.one_of_each_class(table(spark, rows))
    assert left.columns == table(spark, rows).columns
    wanted = {eval(r)[0] for r in brute(rows) if eval(r)[0] == eval(r)[1]}
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(wanted - {None})
    assert left.filter("doc_id IS NULL").count() == 2


def test_same_id_with_two_texts_and_empty_table(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w"), (3, None)]
    found = jaccard_join.classes(table(spark, rows)).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 0, 1), (1, 1, 0, 2), (2, 1, 0, 2), (3, 3, 0, 1)]
    assert jaccard_join.classes(table(spark, [])).count() == 0


def test_posterior_and_minhash():
    rng = np.random.default_rng(0)
    close = []
    for _ in range(200):
        whole = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.unique(whole[:270]), np.unique(whole[30:])
        close.append(np.mean(jaccard_join.signature(a) == jaccard_join.signature(b)))
    assert abs(np.mean(close) - 0.8) < 0.01
    # The posterior by numerical integration of the likelihood.
    s = np.linspace(0, 1, 200_001)
    for n, least in jaccard_join.least_matches():
        for m in (least - 1, least):
            if m >= 0:
                like = s**m * (1 - s) ** (n - m)
                posterior = like[s >= 0.8].sum() / like.sum()
                assert (posterior >= 1e-6 * 1.01) == (m == least) or abs(posterior / 1e-6 - 1) < 0.02


def test_near_copies_that_meet_in_many_bands_leave_one_edge_a_task(spark):
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join([*base[:i], "other", *base[i + 1 :]])) for i in range(40)]
    found = jaccard_join.sketches(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    reps = found.selectExpr("id AS node", "digest", "size", "values", "bands").repartition(3)
    edges = [tuple(r) for r in jaccard_join._candidates(reps, 0.8, 1e-6, 400).collect()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(b < a for a, b in edges) and {x for e in edges for x in e} == set(range(40))
    assert len(edges) <= tasks * 39
