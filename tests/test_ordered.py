"""Ordered operators against plain loops, with a hot key and tiny blocks."""

import random

import pytest
from pyspark.sql import functions as F

from signalmill.operators import chunks, ordered, workflow


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(8)}", rng.randrange(40), i, rng.choice([None, 1, 2, 3])) for i in range(900)]
    return data, spark.createDataFrame(data, "k string, t int, id int, x int").repartition(7).cache()


def by_key(data):
    out = {}
    for k, t, i, x in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(k, []).append((i, x))
    return out


def test_ranked_and_running_total(rows):
    data, df = rows
    got = {r.id: (r.i, r.total) for r in ordered.running_total(
        ordered.ranked(df, ["k"], ["t", "id"]), ["k"], ["t", "id"], F.coalesce("x", F.lit(0)), "total").collect()}
    for seq in by_key(data).values():
        total = 0
        for n, (i, x) in enumerate(seq):
            assert got[i] == (n, total)
            total += x or 0


def test_block_operators(rows):
    data, df = rows
    dense = ordered.ranked(df, ["k"], ["t", "id"]).cache()
    for block in (4, 64, 1 << 16):
        kept = ordered.renumbered(dense.filter("x IS NOT NULL"), ["k"], "i", "v", block)
        last = ordered.last_before(dense, ["k"], "i", F.col("x"), "prev", block)
        nxt = ordered.with_following(dense.select("k", "i", "id"), ["k"], "i", "id", 3, block)
        v = {r.id: r.v for r in kept.collect()}
        prev = {r.id: r.prev for r in last.collect()}
        follow = {r.id: (r._next1, r._next2, r._next3) for r in nxt.collect()}
        assert len(follow) == len(data)
        for seq in by_key(data).values():
            ids, n, before = [i for i, _ in seq] + [None] * 3, 0, None
            for at, (i, x) in enumerate(seq):
                assert prev[i] == before and follow[i] == tuple(ids[at + 1 : at + 4])
                if x is not None:
                    assert v[i] == n
                    n, before = n + 1, x


ROLES = ["user", "assistant", "toolCall", "toolResult"]


def plain_chunks(roles, size, overlap, compat):
    overlap = max(0, min(overlap, size - 1))
    out, start, n = [], 0, len(roles)
    while start < n:
        end = min(n, start + size)
        if end < n and (roles[end - 1], roles[end]) in {("toolCall", "toolResult"), ("toolResult", "assistant"), ("user", "assistant")}:
            end += 1
        out.append((start, end))
        if end >= n:
            break
        start = end - overlap
        if compat and overlap == 0:
            start = end + size
    return out


@pytest.mark.parametrize("size,overlap,block,compat", [
    (20, 4, 64, False), (20, 4, 1 << 16, False), (4, 1, 16, False), (5, 4, 16, False), (3, 0, 16, False), (3, 0, 32, True)
])
def test_chunks_match_a_loop(spark, size, overlap, block, compat):
    rng = random.Random(size * 10 + overlap)
    sessions = {f"s{n}": [rng.choice(ROLES) for _ in range(n)] for n in [1, 2, size, size + 1, 15, 16, 17, 63, 64, 65, 128, 300, 451]}
    views = spark.createDataFrame([(s, v, r) for s, seq in sessions.items() for v, r in enumerate(seq)], "session_id string, v bigint, role string")
    got = {}
    for r in chunks.chunk_bounds(views, size, overlap, block, compat).collect():
        got.setdefault(r.session_id, {})[r.chunk_idx] = (r.start_v, r.end_v)
    for s, seq in sessions.items():
        expected = plain_chunks(seq, size, overlap, compat)
        assert [got[s][k] for k in range(len(got[s]))] == expected, s


def test_ngrams_match_a_loop(spark):
    rng = random.Random(3)
    sessions = {f"s{n}": [rng.choice("abc") for _ in range(n)] for n in (1, 2, 9, 40)}
    calls = spark.createDataFrame([(s, 2 * i, t) for s, seq in sessions.items() for i, t in enumerate(seq)], "session_id string, i bigint, tool string")
    expected = {}
    for seq in sessions.values():
        for n in range(2, 6):
            for k in range(len(seq) - n + 1):
                gram = tuple(seq[k : k + n])
                expected[gram] = expected.get(gram, 0) + 1
    for block in (8, 1 << 16):
        got = workflow.ngrams(workflow.numbered_calls(calls, block), block).collect()
        assert {tuple(r.pattern): r["count"] for r in got} == expected
