"""Ordered operators that survive one key holding most of the rows.

A plain window over a session runs in one task. The functions here cut the
order of a key into blocks, work inside each (key, block) and carry a small
summary per block into the next one, so a hot key spreads over many tasks.

`ranked` starts from any order: the range exchange samples the data and cuts a
hot key where needed. The others start from a dense or sparse integer index, as
`ranked` yields, and use `index div block`, so no group exceeds `block` rows.
Their keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.operators.stable import stable

BLOCK = 1 << 16


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    on = F.lit(True)
    for name in names:
        on = on & left[name].eqNullSafe(right[name])
    return on


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Add `out`: the sum of `value` over earlier rows of the key. `order` must be unique in a key."""
    keys, order = list(keys), list(order)
    ranged = df.repartitionByRange(*keys, *order).withColumn("_value", value)
    # Part numbers must not change between the two uses below.
    ranged = stable(ranged.withColumn("_part", F.spark_partition_id()))
    earlier_parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a part can continue from an earlier part, so this
    # table has at most one row per part and is safe to broadcast.
    carried = (
        ranged.groupBy(*keys, "_part")
        .agg(F.sum("_value").alias("_subtotal"))
        .withColumn("_carry", F.sum("_subtotal").over(earlier_parts))
        .filter("_carry IS NOT NULL")
        .drop("_subtotal")
    )
    earlier_rows = (
        Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = ranged.withColumn(out, F.coalesce(F.sum("_value").over(earlier_rows), F.lit(0)))
    joined = inside.join(F.broadcast(carried), _same(inside, carried, [*keys, "_part"]), "left")
    total = inside[out] + F.coalesce(carried["_carry"], F.lit(0))
    return joined.select(*[inside[c] for c in df.columns if c != out], total.alias(out))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "i") -> DataFrame:
    """Add `out`: the 0-based rank of the row in its key."""
    counted = running_total(df, keys, order, F.lit(1).cast("bigint"), out)
    return counted.withColumn(out, F.col(out).cast("bigint"))


def _blocked(df: DataFrame, index: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.expr(f"`{index}` div {block}"))


def renumbered(
    df: DataFrame, keys: Sequence[str], index: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Add `out`: a dense 0-based rank by an existing integer index, e.g. after a filter."""
    keys = list(keys)
    blocked = _blocked(df, index, block)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_carry", F.sum("_rows").over(earlier))
        .filter("_carry IS NOT NULL")
        .drop("_rows")
    )
    inside = blocked.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(index)) - 1
    )
    # The join runs on the partitioning of the window; only the small side moves.
    joined = inside.join(carried, [*keys, "_block"], "left")
    total = (F.col("_rank") + F.coalesce("_carry", F.lit(0))).cast("bigint")
    return joined.select(*[c for c in df.columns if c != out], total.alias(out))


def last_before(
    df: DataFrame, keys: Sequence[str], index: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Add `out`: the last non-null `value` among earlier rows of the key."""
    keys = list(keys)
    blocked = _blocked(df.withColumn("_value", value), index, block)
    by_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # A block without a value still passes on the one before it.
    place = F.when(F.col("_value").isNotNull(), F.col(index))
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max_by("_value", place).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(by_block))
        .filter("_carry IS NOT NULL")
        .drop("_last")
    )
    earlier = (
        Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = blocked.withColumn("_inside", F.last("_value", ignorenulls=True).over(earlier))
    joined = inside.join(carried, [*keys, "_block"], "left")
    return joined.select(*[c for c in df.columns if c != out], F.coalesce("_inside", "_carry").alias(out))


def with_following(
    df: DataFrame, keys: Sequence[str], index: str, value: str, reach: int, block: int = BLOCK
) -> DataFrame:
    """Add `_next1` .. `_next<reach>`: `value` of the following rows. `index` must be dense.

    The first `reach` rows of a block are also sent to the block before it.
    """
    home = F.expr(f"`{index}` div {block}")
    early = (F.col(index) % block < reach) & (F.col(index) >= block)
    spread = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(early, F.array(home, home - 1)).otherwise(F.array(home)))
    )
    order = Window.partitionBy(*keys, "_block").orderBy(index)
    nexts = {f"_next{k}": F.lead(value, k).over(order) for k in range(1, reach + 1)}
    return spread.withColumns(nexts).filter("_block = _home").drop("_block", "_home")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each key, with their 1-based `_rank`.

    The rank filter is pushed below the shuffle, so a map task sends at most `limit` rows per key.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit)
