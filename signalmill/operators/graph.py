"""Connected components of an edge table, at once or batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators.pairing import roots
from signalmill.operators.stable import stable

MAX_ROUNDS = 60
# Tasks that the neighbours of one node are dealt to.
SALTS = 64
# Edges that a task contracts at once.
CONTRACTED = 1 << 18


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _with_least(pairs: DataFrame, salts: int) -> DataFrame:
    """(x, y, m): the smallest of x and all its neighbours, for pairs in both directions.

    A node's neighbours are dealt by their own hash, so a hub's rows meet its
    minimum in up to `salts` tasks. The minimum travels as one row per part of
    the neighbours that there is, never more rows than pairs.
    """
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(salts)).cast("int"))
    parts = dealt.groupBy("x", "salt").agg(F.min("y").alias("low"))
    least = parts.groupBy("x").agg(F.min("low").alias("low"), F.collect_list("salt").alias("salts"))
    told = least.select("x", F.least("x", "low").alias("m"), F.explode("salts").alias("salt"))
    return dealt.join(told, ["x", "salt"]).select("x", "y", "m")


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))
    return edges.select(F.inline(ends))


def stars(pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (u, v), v < u, that connect the same nodes as the edges that come in `pieces`.

    Every node keeps one edge, to its smallest root. What is contracted is held
    on to, so many dense groups of the same nodes leave one edge per node.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def contract() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = roots(len(nodes), place[: len(a)], place[len(a) :])
        leaf = root != np.arange(len(nodes))
        return nodes[leaf], nodes[root[leaf]]

    for piece in pieces:
        held.append(piece)
        count += len(piece[0])
        if count >= CONTRACTED:
            held = [contract()]
            count = len(held[0][0])
            if 2 * count > CONTRACTED:
                yield held.pop()
                count = 0
    if held:
        yield contract()


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, that connect the same nodes: in each task every node keeps one edge, to its smallest root.

    A star of any size thus leaves a task with one edge per leaf, a dense group
    with one per node. Only integer ids are contracted.
    """
    if dict(edges.dtypes)["u"] != "bigint":
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in stars((batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS, salts: int = SALTS) -> DataFrame:
    """(id, component) for every node of `edges(a, b)`; the component is its smallest node.

    Edges are first contracted inside the tasks that hold them, and once more
    where all that is left of a node meets, so a node that many tasks joined to
    different neighbours has one edge again. Then two star steps alternate until nothing changes: link larger neighbours to the
    smallest neighbour, then smaller ones. Edges only move towards the minimum,
    so their number does not grow; the neighbours of a hub are spread over
    `salts` tasks. Every round is written out, so lost executors do not replay
    the rounds before.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if dict(pairs.dtypes)["u"] == "bigint":
        # A task leaves a node one edge, so all edges of a node meet in one task as at most one row per task before.
        pairs = _contracted(pairs).repartition("u")
    current = stable(_contracted(pairs).distinct())
    state = _state(current)
    for _ in range(max_rounds):
        large = (
            _with_least(_both_ways(current), salts)
            .filter("y > x AND y <> m")
            .select(F.col("y").alias("x"), F.col("m").alias("y"))
            .distinct()
        )
        step = F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("y").alias("u"), F.col("m").alias("v")))
        current = stable(_with_least(large, salts).select(F.inline(step)).filter("u <> v").distinct())
        after = _state(current)
        if after == state:
            tops = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)
        state = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


class Grouping(NamedTuple):
    """Components that grow by batches of edges.

    `members` (id, root) has one row per node, which never changes; `aliases`
    (root, component) has one row per root that was merged into another
    component. A node's component is its root's alias, or else its root.
    """

    members: DataFrame
    aliases: DataFrame

    def current(self) -> DataFrame:
        """(id, component) of all nodes; the component is the smallest root in it."""
        joined = self.members.join(self.aliases, "root", "left")
        return joined.select("id", F.coalesce("component", "root").alias("component"))


def no_grouping(spark: SparkSession, kind: str = "bigint") -> Grouping:
    return Grouping(
        spark.createDataFrame([], f"id {kind}, root {kind}"), spark.createDataFrame([], f"root {kind}, component {kind}")
    )


class Change(NamedTuple):
    """What a batch of edges adds: new members, and the new aliases of roots, which replace older ones."""

    members: DataFrame
    aliases: DataFrame


def new_edges(known: Grouping, edges: DataFrame) -> Change:
    """What `edges(a, b)` change in `known`.

    The ends of the edges are looked up, and edges between components become
    edges between their roots; only this small graph is labelled. Of the stored
    nodes only the ends of new edges are touched, and of the aliases those of
    components that are merged; members of a large component are not rewritten.
    """
    pairs = edges.filter("a <> b").select("a", "b").distinct()
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id"))))).distinct()
    # The new ends are the small side: stored members are scanned, not moved.
    found = known.members.join(ends, "id").join(known.aliases, "root", "left")
    found = found.select("id", F.coalesce("component", "root").alias("component"))
    placed = stable(ends.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.col("component").isNull().alias("fresh")))
    side = placed.select("id", "component")
    between = (
        pairs.join(side.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a")
        .join(side.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    )
    merged = stable(components(between).filter("id <> component"))
    fresh = placed.filter("fresh").select("id", F.col("id").alias("root"))
    # A fresh node that joins others is stored under its new component at once.
    joined = merged.select(F.col("id").alias("root"), "component")
    members = fresh.join(joined, "root", "left").select("id", F.coalesce("component", "root").alias("root"))
    moved = known.aliases.withColumnRenamed("component", "id").join(merged, "id").select("root", "component")
    old = joined.join(fresh.select("root"), "root", "left_anti")
    # A component may be named by a fresh, smaller node: then it is a root of its own and needs no alias.
    return Change(stable(members), stable(moved.unionByName(old)))


def grown(known: Grouping, change: Change) -> Grouping:
    kept = known.aliases.join(change.aliases.select("root"), "root", "left_anti")
    return Grouping(known.members.unionByName(change.members), kept.unionByName(change.aliases))


def read_grouping(spark: SparkSession, path: str, batch: int, kind: str = "bigint") -> Grouping:
    """The grouping that `add_batch` stored below `path` after the batches before `batch`, numbered from 0."""
    if batch == 0:
        return no_grouping(spark, kind)
    members = spark.read.schema(f"id {kind}, root {kind}, batch_id bigint").parquet(f"{path}/members")
    aliases = spark.read.schema(f"root {kind}, component {kind}").parquet(f"{path}/aliases/batch_id={batch - 1}")
    return Grouping(members.filter(F.col("batch_id") < batch).select("id", "root"), aliases)


def add_batch(edges: DataFrame, path: str, batch: int) -> Change:
    """Add one batch of edges to the grouping below `path`. A repeated batch replaces itself.

    Members are only ever added to; the aliases, one row per root that is no
    component any more, are written anew.
    """
    kind = dict(edges.dtypes)["a"]
    known = read_grouping(edges.sparkSession, path, batch, kind)
    change = new_edges(known, edges)
    change.members.write.mode("overwrite").parquet(f"{path}/members/batch_id={batch}")
    grown(known, change).aliases.write.mode("overwrite").parquet(f"{path}/aliases/batch_id={batch}")
    return change
