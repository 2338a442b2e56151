"""Overlapping chunks over the ordered views of a session.

A chunk starts where the previous one ended minus the overlap, and its end moves
by one view when it would cut a pair that belongs together. The start of a chunk
thus depends on the one before it. To run this in parallel, each block of views
works out, for every offset at which a chunk could enter it, where the next
block would be entered. A session that spans several blocks chains these small
tables; most sessions fit one block and skip that step.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.functions.sql import Sql, each, let
from signalmill.operators.ordered import BLOCK

CHUNK_EVENTS = 20
CHUNK_OVERLAP = 4


def keeps_together(previous_role: Sql, role: Sql) -> Sql:
    return (
        f"(({previous_role} = 'toolCall' AND {role} = 'toolResult') OR ({previous_role} = 'toolResult' AND {role} = 'assistant') "
        f"OR ({previous_role} = 'user' AND {role} = 'assistant'))"
    )


def _block_roles(views: DataFrame, block: int, size: int) -> DataFrame:
    """One row per (session, block): `joined[k]` tells if view k belongs with view k-1.

    The array runs `size + 1` views into the next block, as far as a chunk can reach.
    """
    home = F.expr(f"v div {block}")
    early = (F.col("v") % block <= size) & (F.col("v") >= block)
    spread = views.select("session_id", "v", "role").withColumn(
        "block", F.explode(F.when(early, F.array(home, home - 1)).otherwise(F.array(home)))
    )
    rows = spread.groupBy("session_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("v", "role"))).alias("rows")
    )
    # Bound by `let`: as plain columns these arrays could be rebuilt for every element.
    joined = let(
        each("rows", lambda r: f"{r}.role"),
        lambda roles: f"transform({roles}, (role, k) -> coalesce({keeps_together(f'get({roles}, k - 1)', 'role')}, false))",
    )
    return rows.select("session_id", "block", F.size("rows").alias("n"), F.expr(joined).alias("joined"))


def _end(joined: Sql, start: Sql, size: int) -> Sql:
    """End of the chunk that begins at `start`; positions are relative to the block of `n` views."""
    plain = f"({start} + {size})"
    return f"IF({plain} >= n, n, {plain} + CAST(get({joined}, {plain}) AS INT))"


def _onward(joined: Sql, start: Sql, size: int, gap: int, block: int) -> Sql:
    """Next start after the chunk at `start`, or NULL when that chunk is the last."""

    def after(end: Sql) -> Sql:
        nxt = f"({end} + {gap})"
        return f"IF({end} < n AND ({nxt} < n OR {nxt} >= {block}), {nxt}, NULL)"

    return let(_end(joined, start, size), after)


def chunk_bounds(
    views: DataFrame,
    size: int = CHUNK_EVENTS,
    overlap: int = CHUNK_OVERLAP,
    block: int = BLOCK,
    compat: bool = False,
) -> DataFrame:
    """(session_id, chunk_idx, start_v, end_v) with `end_v` exclusive.

    `views` has `session_id`, a dense 0-based `v` and `role`. `compat` keeps the
    known gap of the case without overlap, where the next chunk starts a full
    step behind the end of the last one.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    overlap = max(0, min(overlap, size - 1))
    gap = size if compat and overlap == 0 else -overlap
    lanes = size + gap + 2  # entries 0 .. largest possible stride
    if block < 2 * lanes:
        raise ValueError("block is too small for this chunk size")
    blocks = _block_roles(views, block, size)

    stride = max(1, size + gap)
    entries = _entries(blocks, block, lanes, size, gap)

    def walk(joined: Sql) -> Sql:
        """All chunks that begin in the block, from its entry on."""
        turns = f"sequence(1, least({block // stride}, CAST(n div {stride} AS INT)) + 1)"
        nxt = _onward(joined, "element_at(starts, -1)", size, gap, block)
        step = let(nxt, lambda x: f"IF({x} < {block}, array_append(starts, {x}), starts)")
        starts = f"aggregate({turns}, array(entry), (starts, turn) -> {step})"
        return f"transform({starts}, (s, k) -> named_struct('k', k, 's', s, 'e', {_end(joined, 's', size)}))"

    base = f"block * {block}L"
    placed = (
        blocks.join(entries, ["session_id", "block"], "left")
        .withColumn("entry", F.expr("IF(block = 0, 0, entry)"))
        .filter("entry < n")
        .select(
            "session_id",
            "block",
            F.expr("coalesce(first_idx, 0L)").alias("first_idx"),
            F.expr(f"explode({let('joined', walk)})").alias("c"),
        )
    )
    return placed.selectExpr(
        "session_id", "first_idx + c.k AS chunk_idx", f"{base} + c.s AS start_v", f"{base} + c.e AS end_v"
    )


def _entries(blocks: DataFrame, block: int, lanes: int, size: int, gap: int) -> DataFrame:
    """(session_id, block, entry, first_idx) for every block but the first of a session."""
    turns = block // max(1, size + gap) + 1

    def exits(joined: Sql) -> Sql:
        """Per possible entry: struct<at, chunks>, the entry into the next block and chunks begun in this one."""
        moved = _onward(joined, "state.at", size, gap, block)
        step = f"IF(state.at IS NULL OR state.at >= {block}, state, named_struct('at', {moved}, 'chunks', state.chunks + 1))"
        walked = f"aggregate(sequence(1, {turns}), named_struct('at', entry, 'chunks', 0), (state, turn) -> {step})"
        return f"transform(sequence(0, {lanes - 1}), entry -> {walked})"

    # A block that others follow is full; the last block of a session needs no exit.
    compact = (
        blocks.filter(F.col("n") > block)
        .select("session_id", "block", F.expr(let("joined", exits)).alias("exits"))
        .select(
            "session_id",
            "block",
            F.expr(f"transform(exits, x -> coalesce(x.at - {block}, -1))").alias("at"),
            F.expr("transform(exits, x -> x.chunks)").alias("chunks"),
        )
    )

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        # One short row per `block` views of a session.
        part = part.sort_values("block")
        rows, entry, begun = [], 0, 0
        for name, number, at, chunks in part.itertuples(index=False):
            begun += int(chunks[entry])
            entry = int(at[entry])
            if entry < 0:
                break
            rows.append((name, number + 1, entry, begun))
        return pd.DataFrame(rows, columns=["session_id", "block", "entry", "first_idx"])

    kind = dict(blocks.dtypes)["session_id"]
    return compact.groupBy("session_id").applyInPandas(
        chain, schema=f"session_id {kind}, block bigint, entry int, first_idx bigint"
    )


def chunk_members(bounds: DataFrame) -> DataFrame:
    """(session_id, chunk_idx, v): one row per view and chunk that holds it."""
    return bounds.select(
        "session_id", "chunk_idx", F.explode(F.sequence("start_v", F.col("end_v") - 1)).alias("v")
    )


def chunk_views(views: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every view with the chunks that hold it; the join key splits long sessions."""
    return views.join(chunk_members(bounds), ["session_id", "v"])


def chunk_spans(views: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bounds in raw event numbers, with the public chunk id."""
    first = views.select("session_id", F.col("v").alias("start_v"), F.col("i").alias("start_i"))
    last = views.select("session_id", (F.col("v") + 1).alias("end_v"), F.col("i").alias("end_i"))
    return (
        bounds.join(first, ["session_id", "start_v"])
        .join(last, ["session_id", "end_v"])
        .select(
            "session_id",
            "chunk_idx",
            F.concat(F.lit("chunk:"), F.col("chunk_idx").cast("string")).alias("chunk_id"),
            "start_i",
            "end_i",
            (F.col("end_v") - F.col("start_v")).alias("views"),
        )
    )
