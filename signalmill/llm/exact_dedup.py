"""Exact deduplication by a tree merge of sorted digest runs.

Every partition of the scan is a run. Runs are sorted by digest and merged in
rounds: round k brings runs together in groups of `FAN_IN`, so a run number
loses one digit per round. Inside a group the digests decide the task, which
means that partitions exchange slices of their runs and no task ever holds a
whole run of a later round. A merge keeps, per digest, the smallest identifier
and the number of rows. Digests are verified at every level: SHA-256, a second
64-bit hash and the length must all agree.

The result goes back down the same tree, from the root to the rows. A group of
copies of any size therefore meets the join in as many keys as there are
groups of runs, and no key of a join has more rows than a few partitions hold.
Only identifiers and digests travel; texts stay in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.llm.common import kept

FAN_IN = 8
_DIGEST = ["digest", "check", "chars"]


def normalised(text: str) -> Column:
    """The text with each run of white space as one space; NULL as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digests(text: str) -> list[Column]:
    whole = normalised(text)
    return [
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.xxhash64(whole).alias("check"),
        F.length(whole).alias("chars"),
    ]


def _merged(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: runs of a group of `fan_in` become one, with one row per digest."""
    return runs.groupBy(F.expr(f"run div {fan_in}").alias("run"), *_DIGEST).agg(
        F.min("first").alias("first"), F.sum("n").alias("n")
    )


def copies(docs: DataFrame, id: str = "doc_id", text: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after `normalised`. The row with the
    smallest id of a group is kept; of rows that repeat id and text, one. A row
    without an id is kept alone: keep_id NULL, group_size 1.
    """
    rows = docs.select(F.col(id).alias("id"), *_digests(text)).select(
        "*",
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().cast("bigint").alias("run"),
    )
    rows = kept(rows)
    named = rows.filter("id IS NOT NULL")
    levels = [named.select("run", *_DIGEST, F.struct("id", "row").alias("first"), F.lit(1).cast("bigint").alias("n"))]
    runs = max(1, rows.rdd.getNumPartitions())
    while True:
        levels.append(kept(_merged(levels[-1], fan_in)))
        runs = -(-runs // fan_in)
        if runs == 1:
            break
    told = levels[-1].select("run", *_DIGEST, F.col("first").alias("keep"), F.col("n").alias("size"))
    for level in reversed(levels[1:-1]):
        told = _told(level.select("run", *_DIGEST), told, fan_in)
    found = _told(named, told, fan_in).select(
        F.col("id").alias(id),
        F.col("keep.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    alone = rows.filter("id IS NULL").select(
        F.col("id").alias(id),
        F.col("id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return found.unionByName(alone)


def _told(rows: DataFrame, parents: DataFrame, fan_in: int) -> DataFrame:
    """Rows of a level with what their parent run knows about their digest."""
    parents = parents.withColumnRenamed("run", "parent")
    return rows.withColumn("parent", F.expr(f"run div {fan_in}")).join(parents, ["parent", *_DIGEST]).drop("parent")


def without_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that `copies` keeps, with all their columns."""
    found = copies(docs, id, text).filter("kept").select(F.col(id).alias("_id"), F.unhex("text_sha256").alias("_digest"))
    rows = docs.select(F.col(id).alias("_id"), _digests(text)[0].alias("_digest"), F.struct("*").alias("_row"))
    named = rows.filter("_id IS NOT NULL").join(found.filter("_id IS NOT NULL"), ["_id", "_digest"], "left_semi")
    # Rows that repeat id and text are already together and sorted.
    place = Window.partitionBy("_id", "_digest").orderBy("_id", "_digest")
    once = named.withColumn("_n", F.row_number().over(place)).filter("_n = 1")
    return once.select("_row.*").unionByName(docs.filter(F.col(id).isNull()))
