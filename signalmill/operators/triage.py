"""Triage of single items, before any roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.functions.classify import item_score, item_tier
from signalmill.functions.text import redacted_if_needed
from signalmill.operators.ordered import first_per_key


def triaged(items: DataFrame) -> DataFrame:
    """Add tier, tier_reasons and triage_score. Row-local."""
    tier = F.expr(item_tier("kind", "severity", "tags"))
    return (
        items.withColumn("_t", tier)
        .withColumn("tier", F.col("_t.tier"))
        .withColumn("tier_reasons", F.col("_t.reasons"))
        .withColumn("triage_score", F.expr(item_score("kind", "severity", "tags")))
        .drop("_t")
    )


def triage_top(items: DataFrame, limit: int = 10) -> DataFrame:
    """The best items of each tier, with their rank and a report line."""
    best = first_per_key(triaged(items), ["tier"], [F.desc("triage_score"), F.col("pos")], limit)
    line = F.concat(
        F.lit("- ["), "kind", F.lit("] sev="), "severity",
        F.lit(" score="), F.format_string("%.2f", "triage_score"),
        F.lit(" tags="), F.array_join("tags", ","), F.lit(" id="), "item_id",
        F.lit(" summary="), F.expr(redacted_if_needed("summary")),
    )
    return best.withColumnRenamed("_rank", "rank_in_tier").withColumn("line", line)


def triage_summary(items: DataFrame) -> DataFrame:
    """(facet, value, n): items by tier, kind and severity, from one pass."""
    rows = triaged(items).select(F.col("tier").cast("string").alias("tier"), "kind", "severity")
    cube = rows.groupingSets([["tier"], ["kind"], ["severity"], []], "tier", "kind", "severity")
    counted = cube.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = (
        F.when(F.col("g") == 3, "tier").when(F.col("g") == 5, "kind").when(F.col("g") == 6, "severity").otherwise("items")
    )
    return counted.select(
        facet.alias("facet"), F.coalesce("tier", "kind", "severity", F.lit("all")).alias("value"), "n"
    )


def top_tags(items: DataFrame, limit: int = 15) -> DataFrame:
    """The most frequent tags, first seen on ties."""
    counts = (
        items.select("pos", F.posexplode("tags").alias("at", "tag"))
        .groupBy("tag")
        .agg(F.count("*").alias("n"), F.min(F.struct("pos", "at")).alias("first_pos"))
    )
    return counts.orderBy(F.desc("n"), "first_pos").limit(limit).select("tag", "n")
