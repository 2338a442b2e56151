"""Intervals of evaluation figures by a Poisson bootstrap in one pass over the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import fixed
from signalmill.operators.stable import stable

REPLICATES = 1000
LEVEL = 0.95
# Rows that are weighted at once; bounds the memory of a task to this many times the replicates.
ROWS_AT_ONCE = 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Chances of up to 0, 1, 2 ... occurrences of a row in a replicate; the last one is 1 in double precision.
_UP_TO = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])


def weights(rows: np.ndarray, replicates: int) -> np.ndarray:
    """How often each row, given by its hash, occurs in replicates 1 to `replicates`: Poisson numbers of mean 1."""
    x = rows.view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_UP_TO, (x >> np.uint64(11)) * 2.0**-53, "right")


def cell_counts(rows: DataFrame, cell: str, key: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(cell, replicate, n): how many rows each cell has; replicate 0 has every row once.

    `cell` is an integer with a bounded number of values. Weights come from a
    hash of (seed, key, replicate) alone, so they do not depend on the order of
    the rows, their partitions or retries. Every task sums its own rows, so no
    replicate is made of rows, and a cell of any size is a few rows per task.
    `key` tells rows apart; rows of equal keys, NULL included, share their weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            cells, rows_of = (c.to_numpy() for c in batch.columns)
            for at in range(0, len(cells), ROWS_AT_ONCE):
                own = cells[at : at + ROWS_AT_ONCE]
                order = np.argsort(own, kind="stable")
                own = own[order]
                found = weights(rows_of[at : at + ROWS_AT_ONCE][order], replicates)
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                sums = np.add.reduceat(found, starts, axis=0)
                ones = np.diff(np.append(starts, len(own)))
                for c, one, more in zip(own[starts].tolist(), ones, sums, strict=True):
                    total = totals.setdefault(c, np.zeros(replicates + 1, np.int64))
                    total[0] += one
                    total[1:] += more
        for c, total in totals.items():
            yield pa.RecordBatch.from_pydict(
                {"cell": pa.array([c] * len(total), pa.int32()), "replicate": pa.array(np.arange(len(total), dtype=np.int32)), "n": pa.array(total)}
            )

    named = rows.select(F.col(cell).cast("int").alias("cell"), F.xxhash64(F.lit(seed), F.col(key)).alias("hash"))
    counted = named.mapInArrow(run, "cell int, replicate int, n bigint")
    return counted.groupBy("cell", "replicate").agg(F.sum("n").alias("n"))


def class_intervals(
    labels: DataFrame,
    truth: str,
    predicted: str,
    key: str,
    classes: Sequence[str] = fixed.EVAL_CLASSES,
    replicates: int = REPLICATES,
    level: float = LEVEL,
    seed: int = 0,
) -> DataFrame:
    """(label, metric, n, estimate, low, high): precision, recall and f1 per listed class, and accuracy as label `all`.

    The estimates are those of `class_metrics` and `accuracy`, unrounded; `low`
    and `high` bound the middle `level` of the replicates. `n` is the number of
    rows that the figure divides by: predicted, true, either, all. A figure that
    would divide by nothing is 0, in replicates as well. Without rows there is
    no accuracy, and every other figure is 0.
    """
    listed = F.array(*[F.lit(c) for c in classes])

    def place(column: str) -> Column:
        return F.coalesce(F.array_position(listed, F.col(column)), F.lit(0)).cast("int")

    # Labels outside the list share place 0, where only their equality matters.
    size = len(classes) + 1
    same = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False)).cast("int")
    cells = labels.withColumn("_cell", (place(truth) * size + place(predicted)) * 2 + same)
    # Written out, as both parts below read it: a bounded number of rows, dear to make.
    counts = stable(cell_counts(cells, "_cell", key, replicates, seed)).select(
        "replicate", "n", F.expr(f"int(cell div {2 * size})").alias("t"), F.expr(f"int(cell div 2 % {size})").alias("p"), (F.col("cell") % 2).alias("same")
    )
    # An empty cell per class and replicate, so that every class has a row.
    spark = labels.sparkSession
    empty = spark.range(replicates + 1).select(F.col("id").cast("int").alias("replicate"), F.lit(0).cast("bigint").alias("n"))
    empty = empty.select("*", F.explode(F.sequence(F.lit(1), F.lit(size - 1))).alias("t")).selectExpr("replicate", "n", "t", "t AS p", "1 AS same")
    inside = counts.filter("t > 0 AND p > 0").unionByName(empty)
    inside = inside.select("*", F.explode(F.array_distinct(F.array("t", "p"))).alias("c"))

    def total(condition: str) -> Column:
        return F.sum(F.when(F.expr(condition), F.col("n")).otherwise(0))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    def figure(name: str, n: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), n.alias("n"), value.alias("value"))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    summed = inside.groupBy("c", "replicate").agg(
        total("t = c AND p = c").alias("tp"), total("t <> c AND p = c").alias("fp"), total("t = c AND p <> c").alias("fn")
    )
    by_class = summed.select(
        F.element_at(listed, F.col("c")).alias("label"),
        "replicate",
        F.inline(
            F.array(
                figure("precision", tp + fp, ratio(tp, tp + fp)),
                figure("recall", tp + fn, ratio(tp, tp + fn)),
                figure("f1", tp + fp + fn, ratio(2 * tp, 2 * tp + fp + fn)),
            )
        ),
    )
    whole = counts.groupBy("replicate").agg(total("same = 1").alias("right"), F.sum("n").alias("n")).select(
        F.lit("all").alias("label"), "replicate", F.lit("accuracy").alias("metric"), "n", ratio(F.col("right"), F.col("n")).alias("value")
    )
    drawn, given = F.col("replicate") > 0, F.col("replicate") == 0
    tail = (1 - level) / 2
    found = by_class.unionByName(whole).groupBy("label", "metric").agg(
        F.max(F.when(given, F.col("n"))).alias("n"),
        F.max(F.when(given, F.col("value"))).alias("estimate"),
        F.percentile(F.when(drawn, F.col("value")), F.array(F.lit(tail), F.lit(1 - tail))).alias("ends"),
    )
    return found.select("label", "metric", "n", "estimate", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))
