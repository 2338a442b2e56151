"""Tool-call sequences: n-grams, skill candidates, concrete examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import fixed, ragged
from signalmill.functions.sql import Sql
from signalmill.operators.ordered import BLOCK, first_per_key, ranked, renumbered, with_following

MIN_N, MAX_N = 2, 5


def tool_blocks(events: DataFrame) -> DataFrame:
    """Tool calls inside message content: session_id, i, at, tool, args (VARIANT)."""
    content = F.try_variant_get("event", "$.message.content", "array<variant>")
    calls = events.select("session_id", "i", F.posexplode(content).alias("at", "block"))
    return calls.filter(F.expr(ragged.text_at("block", "$.type")) == "toolCall").select(
        "session_id",
        "i",
        "at",
        F.expr(f"coalesce({ragged.plain_text(ragged.child('block', '$.name'))}, 'unknown')").alias("tool"),
        F.expr(ragged.child("block", "$.arguments")).alias("args"),
    )


def numbered_calls(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add `t`: the dense position of a call in its session. Needs session_id, i, tool.

    Several calls of one event are told apart by `at`, if there is one.
    """
    if "at" not in calls.columns:
        return renumbered(calls, ["session_id"], "i", "t", block)
    return ranked(calls, ["session_id"], ["i", "at"], "t")


def ngrams(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """(n, pattern, count, first_pos): all runs of 2 to 5 calls, counted over sessions.

    Needs session_id, a dense `t` and tool.
    """
    ahead = with_following(calls.select("session_id", "t", "tool"), ["session_id"], "t", "tool", MAX_N - 1, block)
    grams = []
    for n in range(MIN_N, MAX_N + 1):
        tools = F.array("tool", *[f"_next{k}" for k in range(1, n)])
        grams.append(F.when(F.col(f"_next{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), tools.alias("pattern"))))
    rows = ahead.select("session_id", "t", F.explode(F.array_compact(F.array(*grams))).alias("g"))
    return rows.groupBy("g.n", "g.pattern").agg(
        F.count("*").alias("count"), F.min(F.struct("session_id", "t")).alias("first_pos")
    )


def top_ngrams(counted: DataFrame, limit: int = 20) -> DataFrame:
    return first_per_key(counted, ["n"], [F.desc("count"), F.col("first_pos")], limit)


def skill_label(pattern: Column) -> Column:
    out = None
    for tools, label in fixed.SKILL_LABELS:
        hit = F.lit(False)
        for tool in tools:
            hit = hit | F.array_contains(pattern, tool)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    both, label = fixed.FILE_SKILL
    return out.when(F.array_contains(pattern, both[0]) & F.array_contains(pattern, both[1]), label)


def skill_candidates(counted: DataFrame, min_count: int = 3, limit: int = 15) -> DataFrame:
    """Frequent patterns of several tools, longest first, without patterns inside a longer one.

    A pattern goes when all its tools occur in an earlier candidate. `top_ngrams`
    leaves at most 200 candidates, which are compared inside one array.
    """
    frequent = top_ngrams(counted, 50).filter(
        (F.col("count") >= min_count) & (F.size(F.array_distinct("pattern")) >= 2)
    )
    place = F.struct((-F.col("n")).alias("order"), F.col("_rank").alias("rank"))
    listed = frequent.agg(
        F.sort_array(F.collect_list(F.struct(place.alias("place"), "pattern", "count", "n"))).alias("all")
    )
    kept = F.filter(
        "all",
        lambda c: ~F.exists(
            F.filter("all", lambda e: e["place"] < c["place"]),
            lambda e: F.size(F.array_except(c["pattern"], e["pattern"])) == 0,
        ),
    )
    return (
        listed.select(F.posexplode(F.slice(kept, 1, limit)).alias("at", "c"))
        .select((F.col("at") + 1).alias("place"), "c.pattern", "c.count", F.col("c.n").alias("length"))
        .withColumn("skill", skill_label(F.col("pattern")))
    )


def tool_summary(tool: Sql, args: Sql) -> Sql:
    """Short text of what a call does, by tool name."""

    def given(*keys: str) -> Sql:
        return f"coalesce({', '.join(ragged.plain_text(ragged.child(args, f'$.{k}')) for k in keys)}, '')"

    path, action = given("path", "file_path"), given("action")
    cases = [f"WHEN {tool} IN ('bash', 'exec', 'Bash') THEN concat('`', left({given('command')}, 80), '`')"]
    for verb in ("read", "write", "edit"):
        cases.append(f"WHEN {tool} IN ('{verb}', '{verb.capitalize()}') THEN concat('{verb}: ', {path})")
    cases.append(f"WHEN {tool} = 'memory_search' THEN concat('memory: \\'', left({given('query')}, 50), '\\'')")
    target = f"left({given('to', 'target')}, 30)"
    cases.append(f"WHEN {tool} = 'message' THEN concat('message.', {action}, ' → ', {target})")
    for name in ("cron", "gateway", "process"):
        cases.append(f"WHEN {tool} = '{name}' THEN concat('{name}.', {action})")
    return f"CASE {' '.join(cases)} ELSE {tool} END"


def workflow_matches(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pattern, session_id, t, tool, next_tool) for the three known adjacent patterns.

    Sessions with a single call are left out. Needs session_id, a dense `t` and tool.
    """
    ahead = with_following(calls, ["session_id"], "t", "tool", 1, block)
    tool, following = F.lower("tool"), F.lower("_next1")
    shell = F.coalesce(following.isin("bash", "exec"), F.lit(False))
    # A call without a follower that is also the first one is alone in its session.
    alone = (F.col("t") == 0) & F.col("_next1").isNull()
    found = (
        F.when((tool == "memory_search") & shell, "recall-then-execute")
        .when((tool == "read") & shell, "file-driven-cli")
        .when((tool == "cron") & ~alone, "scheduling")
    )
    return (
        ahead.withColumn("pattern", found)
        .filter("pattern IS NOT NULL")
        .withColumn("next_tool", F.when(F.col("pattern") != "scheduling", F.col("_next1")))
        .drop("_next1")
    )


def workflow_examples(matches: DataFrame, limit: int = 5) -> DataFrame:
    """Count per pattern, with its first examples."""
    counts = matches.groupBy("pattern").agg(F.count("*").alias("instances"))
    first = first_per_key(matches, ["pattern"], [F.col("session_id"), F.col("t")], limit)
    return first.join(counts, "pattern").withColumnRenamed("_rank", "example")
