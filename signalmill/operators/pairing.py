"""Comparing the rows of groups of any size inside tasks, without making pairs of rows.

A large group is dealt into blocks and each pair of blocks is a group of its
own, so a task holds two blocks at most. Tasks compare with numpy and hand on
what is linear in the rows: counts, spanning stars, nearest partners.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs compared at once, and columns of a 0/1 matrix; both bound memory.
PAIRS = 1 << 18
COLUMNS = 1 << 13


def deal_out(rows: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """Rows once per pair of blocks of their group: first, second and, for two different blocks, side.

    `members` holds the size of the group and goes; `member` tells rows apart.
    """
    own = rows.withColumn("_blocks", F.ceil(F.col("members") / block).cast("int")).withColumn(
        "_own", F.pmod(F.xxhash64(group, member, F.lit(17)), F.col("_blocks")).cast("int")
    )
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return own.select(
        *[c for c in rows.columns if c != "members"],
        F.least("_own", "_other").alias("first"),
        F.greatest("_own", "_other").alias("second"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"),
    )


def sort_by_group(rows: DataFrame, group: str, *order: str) -> DataFrame:
    keys = [group, "first", "second"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def starts_of(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First row of each group of a sorted table."""
    changed = np.zeros(rows.num_rows, bool)
    changed[:1] = True
    for k in keys:
        values = rows.column(k).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def groups_of(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by `keys`; a group may reach over several batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = starts_of(pa.Table.from_batches([batch]), keys)
        if rest and not all(rest[-1][k][-1].equals(batch[k][0]) for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        if len(starts) > 1:
            yield pa.Table.from_batches([*rest, batch.slice(0, starts[-1])])
            rest = [batch.slice(starts[-1])]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def row_pairs(sides: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a group, some at a time: all pairs, or those between side 0 and side 1."""
    first = np.arange(len(sides)) if same else np.flatnonzero(sides == 0)
    second = first if same else np.flatnonzero(sides == 1)
    at_once = max(1, PAIRS // max(1, len(second)))
    for at in range(0, len(first), at_once):
        a = np.repeat(first[at : at + at_once], len(second))
        b = np.tile(second, len(first[at : at + at_once]))
        yield (a[a < b], b[a < b]) if same else (a, b)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common, by products of 0/1 matrices."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    if len(sets) < 2 or not any(map(len, sets)):
        return out
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(whole := np.concatenate(sets), kind="stable")
    whole, rows = whole[order], rows[order]
    fresh = np.concatenate(([True], whole[1:] != whole[:-1]))
    column = np.cumsum(fresh) - 1
    often = np.bincount(column)[column] > 1
    rows, column = rows[often], column[often]
    column = np.cumsum(np.concatenate(([0], np.diff(column) != 0))) if len(column) else column
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        inside = slice(np.searchsorted(column, low), np.searchsorted(column, low + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        part[rows[inside], column[inside] - low] = 1
        out += part @ part.T
    return out
