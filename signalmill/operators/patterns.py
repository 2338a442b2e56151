"""Sequences of tools that many sessions share, with gaps: growth, closed patterns, clusters of sessions.

A session supports a pattern if it has the tools in this order, with any calls
between them. Patterns grow by one tool at a time. What a pattern needs from a
session is one number, the place where its earliest occurrence ends: a session
that supports the longer pattern calls the next tool after that place. So the
state is one row per (pattern, session), also for a session that holds a third
of all calls, and no session is ever one row or one group.

The next call of a tool after a place is looked up in the blocks of a session:
each block holds its own calls and, for every tool, the first call in a later
block. Only patterns with enough support grow, since no longer pattern has more
support than the ones inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.operators.ordered import BLOCK, first_per_key, last_before
from signalmill.operators.stable import stable

# Calls of a block, which bounds the rows that a place is compared with.
LOOKUP = 64
MAX_LENGTH = 4


def _reach(calls: DataFrame, lookup: int, block: int) -> DataFrame:
    """(session_id, home, tool, at): per block its calls, and the first call of each tool in any later block."""
    own = calls.select("session_id", F.expr(f"t div {lookup}").alias("home"), "tool", F.col("t").alias("at"))
    firsts = own.groupBy("session_id", "tool", "home").agg(F.min("at").alias("at"))
    # A call serves the blocks from the tool's block before it to the block before its own.
    before = last_before(firsts, ["session_id", "tool"], "home", F.col("home"), "before", block)
    served = before.withColumn("from", F.coalesce("before", F.lit(0))).filter(F.col("from") < F.col("home"))
    later = served.select("session_id", F.explode(F.sequence("from", F.col("home") - 1)).alias("home"), "tool", "at")
    return own.unionByName(later)


def _frequent(states: DataFrame, least: int) -> DataFrame:
    """(pattern, support) of the patterns with enough support; a session has one state per pattern."""
    return states.groupBy("pattern").agg(F.count("*").alias("support")).filter(F.col("support") >= least)


def gapped_patterns(
    calls: DataFrame, min_support: int, max_length: int = MAX_LENGTH, lookup: int = LOOKUP, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Patterns of 1 to `max_length` tools that at least `min_support` sessions call in this order.

    Returns (pattern, support) and (pattern, session_id, at): where the earliest
    occurrence of each of these patterns ends in each session that supports it.
    Needs session_id, a dense `t` from 0, and tool. Calls without a tool or a
    session are left out, and take up their place. An empty table gives none.
    """
    calls = calls.select("session_id", "t", "tool").filter("session_id IS NOT NULL AND tool IS NOT NULL")
    states = calls.groupBy("session_id", "tool").agg(F.min("t").alias("at"))
    states = stable(states.select(F.array("tool").alias("pattern"), "session_id", "at"))
    found = stable(_frequent(states, min_support))
    states = stable(states.join(found.select("pattern"), "pattern"))
    # A tool that few sessions call is in no pattern.
    useful = found.select(F.col("pattern")[0].alias("tool"))
    reach = stable(_reach(calls.join(useful, "tool"), lookup, block))
    all_found, all_states = [found], [states]
    for _ in range(1, max_length):
        if found.isEmpty():
            break
        here = states.withColumn("home", F.expr(f"at div {lookup}")).withColumnRenamed("at", "end")
        next_calls = here.join(reach, ["session_id", "home"]).filter(F.col("at") > F.col("end"))
        grown = next_calls.groupBy("session_id", "home", "pattern", "tool").agg(F.min("at").alias("at"))
        grown = stable(grown.select(F.concat("pattern", F.array("tool")).alias("pattern"), "session_id", "at"))
        found = stable(_frequent(grown, min_support))
        states = stable(grown.join(found.select("pattern"), "pattern"))
        all_found.append(found)
        all_states.append(states)
    patterns, places = all_found[0], all_states[0]
    for more, rows in zip(all_found[1:], all_states[1:], strict=True):
        patterns, places = patterns.unionByName(more), places.unionByName(rows)
    return patterns, places


def closed_patterns(patterns: DataFrame) -> DataFrame:
    """The (pattern, support) rows that no longer pattern of the table contains with the same support.

    A longer pattern with the same support implies one that is longer by a single
    tool, so leaving out one tool of each pattern finds all that are not closed.
    Patterns of the greatest length have nothing above them and count as closed.
    """
    shorter = patterns.filter(F.size("pattern") > 1).select("pattern", "support", F.explode(F.sequence(F.lit(1), F.size("pattern"))).alias("k"))
    inside = shorter.select(
        F.filter("pattern", lambda x, i: i + 1 != F.col("k")).alias("pattern"), "support"
    ).distinct()
    return patterns.join(inside, ["pattern", "support"], "left_anti")


def session_clusters(calls: DataFrame, closed: DataFrame, places: DataFrame) -> DataFrame:
    """(session_id, pattern, support, members): each session under the most specific workflow that it follows.

    That is the longest closed pattern of two or more different tools, of these
    the one that fewest sessions support, then the first in order of its tools.
    Sessions with the same pattern are a cluster of `members`; sessions with none
    of them form the cluster whose pattern is NULL.
    """
    workflows = closed.filter(F.size(F.array_distinct("pattern")) >= 2)
    order = [F.size("pattern").desc(), F.col("support"), F.col("pattern")]
    best = first_per_key(places.join(workflows, "pattern"), ["session_id"], order, 1)
    best = best.select("session_id", "pattern", "support")
    every = calls.filter("session_id IS NOT NULL").select("session_id").distinct()
    placed = every.join(best, "session_id", "left")
    sizes = placed.groupBy("pattern").agg(F.count("*").alias("members"))
    sizes = sizes.withColumnRenamed("pattern", "_pattern")
    return placed.join(sizes, F.col("pattern").eqNullSafe(F.col("_pattern"))).drop("_pattern")
