"""Gapped patterns, closed ones and clusters of sessions against plain enumeration."""

import random
from itertools import product

import pytest

from signalmill.operators import patterns

TOOLS = "abcd"


def follows(sequence, pattern):
    """Where the earliest occurrence of the pattern ends, or None."""
    at = -1
    for tool in pattern:
        at = next((t for t in range(at + 1, len(sequence)) if sequence[t] == tool), None)
        if at is None:
            return None
    return at


def plain(sessions, least, longest):
    places = {}
    for n in range(1, longest + 1):
        for p in product(TOOLS + "e", repeat=n):
            ends = {s: end for s, x in sessions.items() if (end := follows(x, p)) is not None}
            if len(ends) >= least:
                places[p] = ends
    closed = {p for p in places if not any(
        len(q) > len(p) and len(places[q]) == len(places[p]) and follows(q, p) is not None for q in places)}
    return places, closed


def rows(spark, sessions):
    calls = [(s, t, tool) for s, x in sessions.items() for t, tool in enumerate(x)]
    return spark.createDataFrame(calls, "session_id string, t bigint, tool string").repartition(5)


def made(seed):
    rng = random.Random(seed)
    sessions = {f"s{k}": [rng.choice(TOOLS[: rng.randint(1, 4)]) for _ in range(rng.choice([1, 2, 5, 9, 14]))] for k in range(18)}
    # A hot session whose rare tool comes late, and a tool of one session only.
    sessions["hot"] = ["a"] * 150 + ["b", "e"] + ["a"] * 90 + ["d", "c"]
    return sessions


@pytest.mark.parametrize("lookup, block", [(64, 1 << 16), (3, 4)])
def test_against_enumeration(spark, lookup, block):
    sessions = made(lookup)
    places, closed = plain(sessions, 4, 4)
    found, ends = patterns.gapped_patterns(rows(spark, sessions), 4, 4, lookup, block)
    assert {tuple(r["pattern"]): r["support"] for r in found.collect()} == {p: len(x) for p, x in places.items()}
    assert {(tuple(r["pattern"]), r["session_id"]): r["at"] for r in ends.collect()} == {
        (p, s): end for p, x in places.items() for s, end in x.items()
    }
    got = {tuple(r["pattern"]) for r in patterns.closed_patterns(found).collect()}
    assert got == closed and len(closed) < len(places)


def test_clusters_of_sessions(spark):
    sessions = made(7)
    places, closed = plain(sessions, 4, 3)
    best = {}
    for s in sessions:
        own = [p for p in closed if s in places[p] and len(set(p)) >= 2]
        best[s] = min(own, key=lambda p: (-len(p), len(places[p]), p), default=None)
    calls = rows(spark, sessions)
    found, ends = patterns.gapped_patterns(calls, 4, 3)
    got = patterns.session_clusters(calls, patterns.closed_patterns(found), ends).collect()
    assert {r["session_id"]: r["pattern"] and tuple(r["pattern"]) for r in got} == best and len(got) == len(best)
    for r in got:
        assert r["members"] == list(best.values()).count(best[r["session_id"]])
        assert r["support"] == (len(places[best[r["session_id"]]]) if r["pattern"] else None)


def test_nothing_to_find(spark):
    none = rows(spark, {"x": "ab"}).filter("t < 0")
    found, ends = patterns.gapped_patterns(none, 1)
    assert found.count() == ends.count() == 0
    calls = rows(spark, {"x": "ab", "y": "c"}).unionByName(
        spark.createDataFrame([("x", 5, None), (None, 0, "a")], "session_id string, t bigint, tool string"))
    found, ends = patterns.gapped_patterns(calls, 2)
    assert found.count() == ends.count() == 0
    alone = patterns.session_clusters(calls, patterns.closed_patterns(found), ends).collect()
    assert sorted((r["session_id"], r["pattern"], r["members"]) for r in alone) == [("x", None, 2), ("y", None, 2)]


def test_a_hot_session_is_no_group(spark):
    """No group of the lookup table is larger than its block and the tools."""
    calls = rows(spark, {"hot": ["a", "b", "c"] * 400, "x": ["a", "b"]})
    reach = patterns._reach(calls, 16, 8)
    sizes = [r["count"] for r in reach.groupBy("session_id", "home").count().collect()]
    assert max(sizes) <= 16 + 3 and len(sizes) == 1200 // 16 + 1
