"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Tasks encode whole texts and hand on only (length, documents) pairs, so what is
shuffled depends on the number of different lengths. Suffix sums over the
histogram then answer any limit. They are taken in blocks of `BLOCK` lengths:
sums inside a block, plus the totals of the blocks above it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.llm.common import kept, texts_of
from signalmill.llm.tokens import worker_encoder

BLOCK = 1024


def lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs): how many documents have how many tokens. NULL and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = worker_encoder(path), Counter()
        for batch in batches:
            found.update(len(ids) // 4 for ids in encoder.encode(texts_of(batch, text)))
        yield pa.RecordBatch.from_pydict(
            {"length": pa.array(found.keys(), pa.int64()), "n_docs": pa.array(found.values(), pa.int64())}
        )

    counted = docs.select(F.col(text)).mapInArrow(run, "length bigint, n_docs bigint")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def answers(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per length, taken as the context limit.

    docs_at_least and tokens_at_least count documents of this length or more;
    docs_up_to those of this length or less, and `quantile` is their share;
    truncated_tokens is the total if every document is cut to this length.
    Between two lengths the truncated total grows by docs_at_least of the
    higher one per token. No rows for an empty table.
    """
    # Used twice below; the texts are encoded once.
    histogram = kept(histogram)
    rows = histogram.select(
        "length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.expr(f"length div {block}").alias("block")
    )
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per block: as many as the longest document has blocks of tokens.
    blocks = (
        rows.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
            F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
            F.sum("d").over(Window.partitionBy()).alias("all_docs"),
            F.sum("t").over(Window.partitionBy()).alias("all_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    docs_from = F.sum("n_docs").over(inside) + F.col("docs_above")
    tokens_from = F.sum("n_tokens").over(inside) + F.col("tokens_above")
    summed = rows.join(blocks, "block").select(
        "length", "n_docs", "n_tokens", docs_from.alias("docs_at_least"), tokens_from.alias("tokens_at_least"), "all_docs", "all_tokens"
    )
    up_to = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return summed.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_at_least",
        "tokens_at_least",
        up_to.alias("docs_up_to"),
        (up_to / F.col("all_docs")).alias("quantile"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        F.col("all_tokens").alias("total_tokens"),
    )

