"""A Merkle manifest of a dataset, stored in the van Emde Boas layout.

Every row is a leaf. The leaves of a group, in the order of their ids, are the
bottom level of a tree: while a level has several nodes, each run of three (the
last may be shorter) becomes the SHA-256 of their hex digests. The roots of the
groups, in the order of the groups, are the leaves of one more tree.

A tree is cut into aligned subtrees of `LEVELS` levels. Subtrees at the bottom
are built first, each by one group of at most 729 rows; their roots are the
leaves of the next tier, and so on. Groups of any size therefore spread over
tasks, and a tier is smaller than the one below by a factor of 729.

Inside, a subtree is split at half of its height: the top part comes first,
then the lower parts one after the other, each laid out in the same way. So a
path from leaf to root touches few neighbourhoods at any block size, and the
place of a node follows from its depth and number alone (`address`). Building
recurses over the roots of the lower parts; sibling retrieval reads the places
that `address` gives.

Defined cases. A NULL field is `-` in a leaf, which tells it from an empty one.
Rows without an id come first, rows without a group form a group that comes
before all others. Rows that repeat an id are ordered by their leaf digests;
rows that are equal are leaves of their own. An empty table has no tree, and no
rows. Other columns are never looked at. Ids keep their type and order by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import kept
from signalmill.operators.ordered import ranked

FAN_OUT = 3
# Node levels of a stored subtree; 3^6 = 729 leaves and 1,093 nodes of 32 bytes at most.
LEVELS = 7
_EMPTY = bytes(32)
_BLOCKS = "tree string, block bigint, leaves int, nodes binary, digest binary, done boolean"
_KNOWN = "path array<string>, subroot string, root string"


def nodes_in(levels: int) -> int:
    return (FAN_OUT**levels - 1) // (FAN_OUT - 1)


def levels_over(leaves: int) -> int:
    """Levels of the lowest tree over so many leaves."""
    levels = 1
    while FAN_OUT ** (levels - 1) < leaves:
        levels += 1
    return levels


def address(levels: int, depth: int, number: int) -> int:
    """The place of a node in a subtree of `levels` levels, from its depth and its number there."""
    at = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        part, number = divmod(number, FAN_OUT**depth)
        at += nodes_in(top) + part * nodes_in(levels)
    return at


def parent(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def lay_out(places: list[bytes], at: int, levels: int, leaves: Sequence[bytes]) -> bytes:
    """Puts the subtree over `leaves` at place `at` and returns its root: lower parts first, the top over their roots."""
    if levels == 1:
        places[at] = leaves[0]
        return leaves[0]
    top = levels // 2
    low = levels - top
    width, start = FAN_OUT ** (low - 1), at + nodes_in(top)
    roots = [
        lay_out(places, start + part * nodes_in(low), low, leaves[first : first + width])
        for part, first in enumerate(range(0, len(leaves), width))
    ]
    return lay_out(places, at, top, [parent(roots[k : k + FAN_OUT]) for k in range(0, len(roots), FAN_OUT)])


def _levels(block: int, leaves: int, levels: int) -> int:
    """A tree's first block may be all of it and then ends at one node; all others have their full height."""
    return min(levels, levels_over(leaves)) if block == 0 else levels


class _Paths:
    """The siblings of the leaves of a stored subtree, as hex text left and right of the way up."""

    def __init__(self, block: int, leaves: int, nodes: bytes, full: int):
        self.levels = _levels(block, leaves, full)
        self.text, self.up = nodes.hex(), {}
        self.counts = [-(-leaves // FAN_OUT ** (self.levels - 1 - d)) for d in range(self.levels)]

    def _between(self, depth: int, first: int, end: int) -> str:
        places = (64 * address(self.levels, depth, k) for k in range(first, min(end, self.counts[depth])))
        return "".join([self.text[p : p + 64] for p in places])

    def of(self, leaf: int, depth: int | None = None) -> list[str]:
        depth = self.levels - 1 if depth is None else depth
        if depth == 0:
            return []
        first = leaf - leaf % FAN_OUT
        # Nodes of a run share all that lies above their parent.
        key = (depth - 1, leaf // FAN_OUT)
        if key not in self.up:
            self.up[key] = self.of(leaf // FAN_OUT, depth - 1)
        return [self._between(depth, first, leaf), self._between(depth, leaf + 1, first + FAN_OUT), *self.up[key]]


def folded(digest: str, path: Sequence[str]) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


class Manifest(NamedTuple):
    """Tiers of stored subtrees, from the leaves up: of the groups' trees, and of the tree over their numbered roots."""

    groups: list[DataFrame]
    roots: DataFrame
    top: list[DataFrame]
    levels: int


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each as its length in UTF-8 bytes, a colon and its text, or `-` for NULL."""
    told = []
    for field in fields:
        text = field.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*told), 256))


def leaves(
    docs: DataFrame, id: str, group: str, fields: Sequence[Column], claimed: Sequence[Column] | None = None
) -> DataFrame:
    """Numbered leaves: id, tree, i, leaf and `claim`, the leaf of the `claimed` fields that is to be verified."""
    group_text = F.col(group).cast("string")
    own = leaf_digest(fields)
    rows = kept(
        docs.select(
            F.col(id).alias("id"),
            # Sorts like the group's bytes, with NULL first.
            F.when(group_text.isNull(), "").otherwise(F.concat(F.lit("="), group_text)).alias("tree"),
            own.alias("leaf"),
            (own if claimed is None else leaf_digest(claimed)).alias("claim"),
        )
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return ranked(rows, ["tree"], ["id", "leaf", "row"], "i").drop("row")


def _grown(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Tiers of subtrees over rows (tree, i, digest)."""
    width, height = FAN_OUT ** (levels - 1), levels

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        digests = rows.sort_by("i").column("digest").to_pylist()
        own = _levels(block, len(digests), height)
        places = [_EMPTY] * nodes_in(own)
        root = lay_out(places, 0, own, digests)
        done = block == 0 and len(digests) < width
        return pa.table(
            {
                "tree": pa.array([tree], pa.string()),
                "block": pa.array([block], pa.int64()),
                "leaves": pa.array([len(digests)], pa.int32()),
                "nodes": pa.array([b"".join(places)], pa.binary()),
                "digest": pa.array([root], pa.binary()),
                "done": pa.array([done], pa.bool_()),
            }
        )

    tiers = []
    while True:
        cut = rows.select("tree", "i", "digest", F.expr(f"i div {width}").alias("block"))
        tier = kept(cut.groupBy("tree", "block").applyInArrow(build, _BLOCKS))
        tiers.append(tier)
        rows = tier.filter("NOT done").select("tree", F.col("block").alias("i"), "digest")
        if rows.isEmpty():
            return tiers


def _roots(tiers: Sequence[DataFrame]) -> DataFrame:
    found = [t.filter("done").select("tree", "digest") for t in tiers]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _numbered(groups: Sequence[DataFrame]) -> DataFrame:
    return ranked(_roots(groups), [], ["tree"], "i")


def manifest(rows: DataFrame, levels: int = LEVELS) -> Manifest:
    """The trees over numbered leaves (tree, i, leaf), every tier written out."""
    groups = _grown(rows.select("tree", "i", F.col("leaf").alias("digest")), levels)
    roots = kept(_numbered(groups))
    top = _grown(roots.select(F.lit("").alias("tree"), "i", "digest"), levels)
    return Manifest(groups, roots, top, levels)


def as_table(made: Manifest) -> DataFrame:
    """All stored subtrees as one table, to be kept beside the data: part, tier and the columns of a subtree."""
    out = None
    for part, tiers in (("groups", made.groups), ("top", made.top)):
        for k, tier in enumerate(tiers):
            rows = tier.select(F.lit(part).alias("part"), F.lit(k).alias("tier"), F.lit(made.levels).alias("levels"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out


def from_table(stored: DataFrame) -> Manifest:
    """The manifest that `as_table` gave; one of no rows has one empty tier."""
    seen = stored.groupBy("part", "levels").agg(F.max("tier").alias("tier")).collect()
    depth = {r["part"]: r["tier"] for r in seen}
    tiers = {
        part: [
            stored.filter((F.col("part") == part) & (F.col("tier") == k)).drop("part", "tier", "levels")
            for k in range(depth.get(part, 0) + 1)
        ]
        for part in ("groups", "top")
    }
    return Manifest(tiers["groups"], _numbered(tiers["groups"]), tiers["top"], seen[0]["levels"] if seen else LEVELS)


def _placed(tiers: Sequence[DataFrame], known: DataFrame, levels: int) -> DataFrame:
    """The subtrees at the bottom with the way from their root to the end: path, subroot, root.

    `known` has these for every tree. Each tier tells the one below, one row per subtree.
    """
    told = None
    for k in range(len(tiers) - 1, -1, -1):
        placed = tiers[k].filter("done").join(known, "tree")
        if told is not None:
            placed = placed.unionByName(tiers[k].filter("NOT done").join(told, ["tree", "block"]))
        if k:
            told = _slots(placed, levels)
    return placed


def _slots(placed: DataFrame, levels: int) -> DataFrame:
    """What the leaves of placed subtrees know: (tree, block, path, subroot, root), where block is the leaf's number."""
    width = FAN_OUT ** (levels - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                paths = _Paths(row["block"], row["leaves"], row["nodes"], levels)
                n, first = row["leaves"], row["block"] * width
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array([row["tree"]] * n, pa.string()),
                        "block": pa.array(range(first, first + n), pa.int64()),
                        "path": pa.array([paths.of(k) + row["path"] for k in range(n)], pa.list_(pa.string())),
                        "subroot": pa.array([row["subroot"]] * n, pa.string()),
                        "root": pa.array([row["root"]] * n, pa.string()),
                    }
                )

    return placed.select("tree", "block", "leaves", "nodes", "path", "subroot", "root").mapInArrow(
        run, f"tree string, block bigint, {_KNOWN}"
    )


def _hex(name: str) -> Column:
    return F.lower(F.hex(name))


def _known_groups(made: Manifest) -> DataFrame:
    """Per group's tree: the path from its root to the root of all, subroot and root."""
    start = _roots(made.top).select(
        "tree", F.expr("CAST(array() AS array<string>)").alias("path"), F.lit(None).cast("string").alias("subroot"), _hex("digest").alias("root")
    )
    ways = _slots(_placed(made.top, start, made.levels), made.levels).select(F.col("block").alias("i"), "path", "root")
    return made.roots.join(ways, "i").select("tree", "path", _hex("digest").alias("subroot"), "root")


def proofs(made: Manifest, rows: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row per leaf of `rows` (id, tree, i, leaf, claim, as from `leaves`; any part of all leaves will do).

    `id`, number in the group, leaf, subroot, root, siblings (left and right of
    the way up, level by level, as hex text) and folded_root, which is what the
    claimed leaf and these siblings amount to. A leaf that the manifest does not
    hold has NULL for all that comes from there.
    """
    levels, width = made.levels, FAN_OUT ** (made.levels - 1)
    names = [id, "number", "leaf", "subroot", "root", "siblings", "folded_root"]
    kinds = [rows.schema["id"].dataType.simpleString(), "bigint", "string", "string", "string", "array<string>", "string"]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))

    def prove(key: tuple, rows: pa.Table, blocks: pa.Table) -> pa.Table:
        n, numbers = rows.num_rows, rows.column("i").to_pylist()
        known, ways = {}, [None] * n
        if n and blocks.num_rows:
            known = blocks.to_pylist()[0]
            paths = _Paths(known["block"], known["leaves"], known["nodes"], levels)
            ways = [paths.of(i % width) + known["path"] if i % width < known["leaves"] else None for i in numbers]
        claims = [c.hex() for c in rows.column("claim").to_pylist()]
        return pa.table(
            [
                rows.column("id"),
                rows.column("i"),
                pa.array([x.hex() for x in rows.column("leaf").to_pylist()], pa.string()),
                pa.array([known.get("subroot")] * n, pa.string()),
                pa.array([known.get("root")] * n, pa.string()),
                pa.array(ways, pa.list_(pa.string())),
                pa.array([None if w is None else folded(c, w) for c, w in zip(claims, ways, strict=True)], pa.string()),
            ],
            names=names,
        )

    keys = ["tree", "block"]
    cut = rows.select("tree", F.expr(f"i div {width}").alias("block"), "id", "i", "leaf", "claim")
    stored = _placed(made.groups, _known_groups(made), levels).select(*keys, "leaves", "nodes", "path", "subroot", "root")
    return cut.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(prove, schema)
