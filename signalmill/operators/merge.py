"""Merge clusters of the same finer kind whose summaries share most words.

Clusters are similar when the Jaccard similarity of their word sets reaches the
threshold; connected clusters become one. No step compares all clusters of a
block:

* Equal word sets are linked to one representative first.
* A set of n words is listed under its first n - ceil(t * n) + 1 words, rarest
  first; two sets that reach the threshold t share one of them.
* The sets listed under a word are compared inside tasks, in pairs of blocks.
  Merging hands on one edge per set and task, never the pairs themselves. The
  exact linear report of all pairs is `similar_members`; lists of pairs are
  whole as well, unless they are asked to keep the nearest partners only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions.text import severity_rank, tokens
from signalmill.operators.graph import components
from signalmill.operators.ordered import first_per_key
from signalmill.operators.pairing import deal_out, groups_of, roots, shared_counts, sort_by_group, starts_of
from signalmill.operators.rollup import MAX_TAGS, scored, top_values
from signalmill.operators.stable import stable

AUTO_JACCARD = 0.62
ASK_JACCARD = 0.5
ASK_CONFIDENCE = 0.7
# Partners of a cluster in the reports of nearest pairs, and in the first round of questions.
NEAREST = 20
BLOCK = 400
_SLACK = 1e-9


def word_sets(clusters: DataFrame) -> DataFrame:
    """(id, block, words): distinct words of the summary, rarest of the block first."""
    base = clusters.select(
        F.col("signature_id").alias("id"),
        F.col("kind_v2_primary").alias("block"),
        F.array_distinct(F.expr(tokens("canonical_summary"))).alias("words"),
    ).filter(F.size("words") > 0)
    exploded = base.select("id", "block", F.explode("words").alias("word"))
    rarity = exploded.groupBy("block", "word").agg(F.count("*").alias("df"))
    return (
        exploded.join(rarity, ["block", "word"])
        .groupBy("id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))
        .select("id", "block", F.col("w.word").alias("words"))
    )


def representatives(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One id per distinct word set, and links of the other ids to it."""
    smallest = sets.groupBy("block", "words").agg(F.min("id").alias("rep"))
    links = (
        sets.join(smallest, ["block", "words"])
        .filter("id <> rep")
        .select(F.col("rep").alias("a"), F.col("id").alias("b"))
    )
    return smallest.select(F.col("rep").alias("id"), "block", "words"), links


def prefix_keys(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """The sets under each of their prefix words, dealt into pairs of blocks: key, first, second, side, id, kind, words, at.

    `at` is the place of the prefix word; columns besides id, block and words stay.
    """
    n = F.size("words")
    length = n - F.ceil(n * threshold - _SLACK).cast("int") + 1
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    listed = sets.select(
        "id",
        F.xxhash64("block").alias("kind"),
        *[c for c in sets.columns if c not in ("id", "block", "words")],
        hashed.alias("words"),
        F.posexplode(F.slice("words", F.lit(1), length)).alias("at", "word"),
    ).withColumn("key", F.xxhash64("kind", "word"))
    often = listed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    return sort_by_group(deal_out(listed.drop("word").join(often, "key"), "key", "id", block), "key")


_GROUP = ["key", "first", "second"]


def _similarities(group: pa.Table) -> np.ndarray:
    """Jaccard similarity of the rows of a group that the group compares; 0 elsewhere."""
    offsets = group.column("words").combine_chunks()
    sets = [x.values.to_numpy() for x in offsets]
    common = shared_counts(sets).astype(np.float64)
    sizes = np.array([len(x) for x in sets], np.float64)
    out = common / np.maximum(1, sizes[:, None] + sizes[None, :] - common)
    kind, side = group.column("kind").to_numpy(), group.column("side").to_numpy()
    out[kind[:, None] != kind[None, :]] = 0
    if not group.column("first")[0].equals(group.column("second")[0]):
        out[side[:, None] == side[None, :]] = 0
    np.fill_diagonal(out, 0)
    return out


def _each_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    for rows in groups_of(batches, _GROUP):
        starts = [*starts_of(rows, _GROUP), rows.num_rows]
        for at, end in zip(starts, starts[1:], strict=False):
            # Sorted by id, so that ties go to the smaller one.
            group = rows.slice(at, end - at).sort_by("id")
            yield group, _similarities(group)


def _first_here(group: pa.Table) -> np.ndarray:
    """Whether the word of the group is the first that two rows share; each similar pair has one such group."""
    words, at = group.column("words").combine_chunks(), group.column("at").to_pylist()
    return shared_counts([x.values.to_numpy()[:n] for x, n in zip(words, at, strict=True)]) == 0


def all_pairs(sets: DataFrame, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """Every pair (a, b, sim), a < b, with low <= sim < high, once."""
    kind = dict(sets.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, sim in _each_group(batches):
            a, b = np.nonzero(np.triu((sim >= low) & (sim < high) & _first_here(group)))
            ids = group.column("id")
            yield from pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "sim": sim[a, b]}).to_batches()

    return prefix_keys(sets, low, block).mapInArrow(run, f"a {kind}, b {kind}, sim double")


def link_counts(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, n_links): how many sets are similar to a set, of those that have any; pairs are counted in place."""
    kind = dict(sets.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, sim in _each_group(batches):
            n = ((sim >= threshold) & _first_here(group)).sum(axis=1)
            some = np.flatnonzero(n)
            yield from pa.table({"id": group.column("id").take(pa.array(some)), "n": n[some].astype(np.int64)}).to_batches()

    counts = prefix_keys(sets, threshold, block).mapInArrow(run, f"id {kind}, n bigint")
    return counts.groupBy("id").agg(F.sum("n").alias("n_links"))


def nearest_partners(sets: DataFrame, low: float, high: float, nearest: int, block: int = BLOCK) -> DataFrame:
    """(x, y, sim) with low <= sim < high: the `nearest` partners of each set, most similar first, then smallest id.

    With a column `component`, sets of one component are no partners. With
    `past_sim` and `past_id`, a set takes the partners that come after that one.
    """
    kind = dict(sets.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, sim in _each_group(batches):
            ids = group.column("id")
            sim[(sim < low) | (sim >= high)] = 0
            if "component" in group.column_names:
                own = group.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
                sim[own[:, None] == own[None, :]] = 0
            if "past_sim" in group.column_names:
                order = ids.to_pylist()
                for x, (last, y) in enumerate(zip(group.column("past_sim").to_pylist(), group.column("past_id").to_pylist(), strict=True)):
                    if last is not None:
                        sim[x, sim[x] > last] = 0
                        sim[x, : bisect_right(order, y)][sim[x, : bisect_right(order, y)] == last] = 0
            best = np.argsort(-sim, axis=1, kind="stable")[:, :nearest]
            x = np.repeat(np.arange(len(sim)), best.shape[1])
            y = best.ravel()
            true = sim[x, y] > 0
            columns = {"x": ids.take(pa.array(x[true])), "y": ids.take(pa.array(y[true])), "sim": sim[x[true], y[true]]}
            yield from pa.table(columns).to_batches()

    rows = prefix_keys(sets, low, block).mapInArrow(run, f"x {kind}, y {kind}, sim double")
    once = rows.groupBy("x", "y").agg(F.first("sim").alias("sim"))
    return first_per_key(once, ["x"], [F.desc("sim"), F.col("y")], nearest)


def _as_pairs(partners: DataFrame) -> DataFrame:
    pairs = partners.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")
    return pairs.groupBy("a", "b").agg(F.first("sim").alias("sim"))


def nearest_pairs(sets: DataFrame, low: float, high: float, nearest: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, sim), a < b, with low <= sim < high, where one is among the `nearest` of the other.

    Nearest means most similar, then smallest id.
    """
    return _as_pairs(nearest_partners(sets, low, high, nearest, block))


def similar_pairs(clusters: DataFrame, threshold: float = AUTO_JACCARD, nearest: int | None = None) -> DataFrame:
    """Similar pairs (a, b, sim), a < b, of clusters with different word sets.

    Clusters with the same words stand behind the smallest id among them. All
    pairs are listed, which grows with the square of a group of similar
    clusters; `similar_members` says the same in rows per cluster. With
    `nearest`, a pair is listed if one of the two is among the `nearest`
    partners of the other. Merging uses neither list; see `merge_edges`.
    """
    reps, _ = representatives(word_sets(clusters))
    return all_pairs(reps, threshold, 2.0) if nearest is None else nearest_pairs(reps, threshold, 2.0, nearest)


def similar_members(clusters: DataFrame, threshold: float = AUTO_JACCARD, block: int = BLOCK) -> DataFrame:
    """(signature_id, component, rep, n_links) of clusters that are similar to another one.

    `rep` is the smallest id with the same words, `n_links` the exact number of
    other word sets that are similar to it.
    """
    reps, links = representatives(word_sets(clusters))
    links = links.select(F.col("b").alias("signature_id"), F.col("a").alias("rep"))
    found = merge_components(clusters, threshold=threshold, block=block).join(links, "signature_id", "left")
    found = found.withColumn("rep", F.coalesce("rep", "signature_id"))
    counts = link_counts(reps, threshold, block).withColumnRenamed("id", "rep")
    return found.join(counts, "rep", "left").select(
        "signature_id", "component", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def merge_edges(clusters: DataFrame, threshold: float = AUTO_JACCARD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) with the same components as all similar pairs."""
    reps, links = representatives(word_sets(clusters))
    kind = dict(reps.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, sim in _each_group(batches):
            a, b = np.nonzero(np.triu(sim >= threshold))
            root = roots(len(sim), a, b)
            other = np.flatnonzero(root != np.arange(len(sim)))
            ids = group.column("id")
            yield from pa.table({"a": ids.take(pa.array(root[other])), "b": ids.take(pa.array(other))}).to_batches()

    edges = prefix_keys(reps, threshold, block).mapInArrow(run, f"a {kind}, b {kind}").distinct()
    return links.unionByName(edges)


def merge_requests(
    clusters: DataFrame, low: float = ASK_JACCARD, high: float = AUTO_JACCARD, nearest: int | None = None
) -> DataFrame:
    """Pairs in the band below the automatic threshold, with the facts a model decides on.

    Clusters with the same words merge anyway, so one of them is asked about.
    All pairs of the band are, or with `nearest` each with so many partners;
    `asked_edges` asks in rounds and leaves out what earlier answers settle.
    """
    reps, _ = representatives(word_sets(clusters))
    return _with_facts(all_pairs(reps, low, high) if nearest is None else nearest_pairs(reps, low, high, nearest), clusters)


def _with_facts(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    facts = clusters.select(
        F.col("signature_id").alias("id"),
        F.to_json(
            F.struct(F.col("canonical_summary").alias("summary"), F.col("kind_v2_counts").alias("kind_v2"), "tags_top")
        ).alias("facts"),
    )
    one = facts.select(F.col("id").alias("a"), F.col("facts").alias("fa"))
    two = facts.select(F.col("id").alias("b"), F.col("facts").alias("fb"))
    payload = F.concat(F.lit('{"a": '), "fa", F.lit(', "b": '), "fb", F.lit("}"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sim", payload.alias("user"))


def asked_edges(
    clusters: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    low: float = ASK_JACCARD,
    high: float = AUTO_JACCARD,
    nearest: int = NEAREST,
    block: int = BLOCK,
) -> DataFrame:
    """Edges (a, b) that a model adds; at the end no pair of the band between two components is unasked.

    `ask` adds `answer` to requests (a, b, sim, user). Each round asks about the
    next partners of every cluster that are still in another component, first
    `nearest` and twice as many each time; a cluster only keeps the last partner
    it was asked about. No pair is asked about twice.
    """
    reps, _ = representatives(word_sets(clusters))
    reps, sure = stable(reps), stable(merge_edges(clusters, high, block))
    kind = dict(reps.dtypes)["id"]
    spark = clusters.sparkSession
    asked = spark.createDataFrame([], f"a {kind}, b {kind}")
    added = asked
    past = spark.createDataFrame([], f"id {kind}, past_sim double, past_id {kind}")
    while True:
        members = components(sure.unionByName(added))
        sets = reps.join(members, "id", "left").withColumn("component", F.coalesce("component", "id")).join(past, "id", "left")
        partners = stable(nearest_partners(sets, low, high, nearest, block))
        if partners.isEmpty():
            return added
        last = partners.groupBy(F.col("x").alias("id")).agg(F.max(F.struct(-F.col("sim"), "y")).alias("e"))
        last = last.select("id", (-F.col("e.col1")).alias("past_sim"), F.col("e.y").alias("past_id"))
        past = stable(past.join(last, "id", "left_anti").unionByName(last))
        pairs = _as_pairs(partners).join(asked, ["a", "b"], "left_anti")
        answers = stable(ask(_with_facts(pairs, clusters)))
        asked = stable(asked.unionByName(answers.select("a", "b")))
        added = stable(added.unionByName(merge_decisions(answers)))
        nearest *= 2


def merge_decisions(answers: DataFrame) -> DataFrame:
    """Edges from answers (a, b, answer) that say `merge` with enough confidence."""
    body = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.nullif(body, F.lit("")), "struct<decision:string,confidence:double>")
    return (
        answers.withColumn("p", parsed)
        .filter((F.lower("p.decision") == "merge") & (F.col("p.confidence") >= ASK_CONFIDENCE))
        .select("a", "b")
    )


def merge_components(clusters: DataFrame, extra_edges: DataFrame | None = None, **options) -> DataFrame:
    """(signature_id, component) of clusters that merge with another one."""
    edges = merge_edges(clusters, **options)
    if extra_edges is not None:
        edges = edges.unionByName(extra_edges)
    return components(edges).withColumnRenamed("id", "signature_id")


def merged_from(clusters: DataFrame, membership: DataFrame) -> DataFrame:
    """Long form of the member list: (component, signature_id, tier, score, first_pos)."""
    return clusters.join(membership, "signature_id").select("component", "signature_id", "tier", "score", "first_pos")


def merged_rollups(
    clusters: DataFrame,
    membership: DataFrame,
    items: DataFrame | None = None,
    max_tags: int = MAX_TAGS,
    compat: bool = False,
) -> DataFrame:
    """Clusters with merged ones folded together; single ones pass unchanged.

    A merged cluster is an incident if a member is one. `compat` asks for the tag
    among the members' top tags instead, as does a cluster file without the flag.

    Given the items (with `signature_id`), sessions are counted once per merged
    cluster; without them the members' counts are added up. Member lists stay
    in `merged_from`, since a component has no size limit.
    """
    clusters = clusters.join(membership, "signature_id", "left")
    single = clusters.filter("component IS NULL").drop("component").withColumn("merged", F.lit(1).cast("bigint"))
    members = clusters.filter("component IS NOT NULL")
    member_order = F.struct(F.col("tier"), -F.col("score"), F.col("first_pos"))
    sums = members.groupBy("component").agg(
        F.sum("count_items").alias("count_items"),
        F.sum("count_sessions").alias("count_sessions"),
        F.count("*").alias("merged"),
        F.min_by("max_severity", F.struct(-F.expr(severity_rank("max_severity")), member_order)).alias("max_severity"),
        F.min_by(
            F.struct(
                "signature_id", "signature_text", "first_pos", "canonical_summary", "kind_v2_reason_top", "sample_refs"
            ),
            F.struct(-F.col("count_items"), member_order),
        ).alias("best"),
    )
    if items is not None:
        sessions = (
            items.join(membership, "signature_id")
            .groupBy("component")
            .agg(F.count_distinct("session_id").alias("count_sessions"))
        )
        sums = sums.drop("count_sessions").join(sessions, "component")

    def summed(place: Column) -> DataFrame:
        """Counter of a map or list column over the members."""
        return (
            members.select("component", member_order.alias("o"), F.posexplode(place).alias("at", "e"))
            .select("component", "o", "at", F.col("e.value").alias("value"), F.col("e.n").alias("n"))
            .groupBy("component", "value")
            .agg(F.sum("n").alias("n"), F.min(F.struct("o", "at")).alias("first_pos"))
        )

    def entries(column: str) -> Column:
        return F.transform(
            F.map_entries(column), lambda e: F.struct(e["key"].alias("value"), e["value"].alias("n"))
        )

    def as_map(counts: DataFrame, out: str) -> DataFrame:
        return counts.groupBy("component").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(out),
            F.min_by("value", F.struct(-F.col("n"), F.col("first_pos"))).alias(f"{out}_mode"),
        )

    kinds = as_map(summed(entries("kind_counts")), "kind_counts").drop("kind_counts_mode")
    fine = as_map(summed(entries("kind_v2_counts")), "kind_v2_counts").withColumnRenamed(
        "kind_v2_counts_mode", "kind_v2_primary"
    )
    one = F.array(F.struct(F.col("sentiment").alias("value"), F.lit(1).cast("bigint").alias("n")))
    mood = as_map(summed(one), "sentiment").select("component", F.col("sentiment_mode").alias("sentiment"))
    tag_counts = summed(F.col("tags_top"))
    tags = top_values(tag_counts, ["component"], max_tags, "tags_top")
    if compat or "incident" not in clusters.columns:
        incident = tag_counts.groupBy("component").agg(F.bool_or(F.col("value") == "incident").alias("incident"))
    else:
        incident = members.groupBy("component").agg(F.bool_or("incident").alias("incident"))
    folded = (
        sums.join(kinds, "component")
        .join(fine, "component")
        .join(mood, "component")
        .join(tags, "component", "left")
        .join(incident, "component", "left")
        .withColumn("tags_top", F.coalesce("tags_top", F.array().cast("array<struct<value:string,n:bigint>>")))
        .withColumn("incident", F.coalesce("incident", F.lit(False)))
        .withColumn("error", F.map_contains_key("kind_counts", F.lit("error")))
        .withColumn("frustration", F.map_contains_key("kind_counts", F.lit("user_frustration")))
        .select("*", "best.*")
        .drop("best", "component")
    )
    return scored(folded).select(*single.columns).unionByName(single)
