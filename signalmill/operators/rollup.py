"""Roll items up into ranked clusters.

All counters of a cluster come from one long table of (signature, facet, value)
rows. Items of one text, that is of equal kind, summary, severity and tags, are
counted together first, which partial aggregation does before the shuffle; the
rules that label a text then run once per text, and their rows are added up. A
hot signature thus never collects its items anywhere; lists that reach a row are
bounded (8 tags, 3 samples, the fixed kinds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions.classify import group_score, group_tier, kind_v2, sentiment
from signalmill.functions.sql import Sql
from signalmill.functions.text import (
    fingerprint_text,
    hashed,
    redacted_if_needed,
    severity_rank,
    signature_text,
)
from signalmill.operators.ordered import first_per_key

MAX_SAMPLES = 3
MAX_TAGS = 8


# What the signature of an item depends on, once it is worked out and before.
_SIGNATURE = ["signature_text", "signature_id"]
_SIGNED = ["kind", "summary", "tags"]


def with_signature(items: DataFrame) -> DataFrame:
    """Items with signature_text and signature_id, those that they carry or new ones."""
    if set(_SIGNATURE) <= set(items.columns):
        return items
    text = F.expr(signature_text("kind", "summary", "tags"))
    return items.withColumn("signature_text", text).withColumn(
        "signature_id", F.expr(hashed("sig1:", "signature_text"))
    )


def _alike(items: DataFrame, *keys: str) -> DataFrame:
    """Items that agree in what their signature depends on and in `keys`, as one row with n and first_pos."""
    carried = [c for c in _SIGNATURE if c in items.columns]
    alike = items.groupBy(*dict.fromkeys([*keys, *_SIGNED, *carried]))
    return with_signature(alike.agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")))


def _facet(name: str, value: Sql) -> Sql:
    return f"named_struct('facet', '{name}', 'value', {value})"


def facet_counts(items: DataFrame, *keys: str) -> DataFrame:
    """(signature_id, facet, value, n, first_pos) over items with `pos`, also by `keys`.

    Of the tags only `incident` is among the facets; `tag_counts` has them all.
    """
    one = [
        _facet("signature", "signature_text"),
        _facet("kind", "coalesce(nullif(kind, ''), 'unknown')"),
        _facet("kind_v2", "fine.label"),
        _facet("reason", "fine.reason"),
        _facet("severity", "lower(coalesce(nullif(severity, ''), 'unknown'))"),
        _facet("sentiment", sentiment("kind", "summary")),
        _facet("summary", f"IF(summary <> '', {redacted_if_needed('summary')}, NULL)"),
    ]
    flag = f"IF(array_contains(tags, 'incident'), array({_facet('tag', chr(39) + 'incident' + chr(39))}), array())"
    facets = f"concat(array({', '.join(one)}), {flag})"
    columns = [*keys, "signature_id", "n", "first_pos"]
    labelled = _alike(items, *keys, "severity").withColumn("fine", F.expr(kind_v2("kind", "summary", "tags")))
    rows = labelled.select(*columns, F.explode(F.expr(facets)).alias("f")).select(*columns, "f.facet", "f.value")
    in_sessions = _alike(items, *keys, "session_id").select(
        *columns, F.lit("session").alias("facet"), F.expr("nullif(session_id, '')").alias("value")
    )
    return (
        rows.unionByName(in_sessions)
        .filter("value IS NOT NULL")
        .groupBy(*keys, "signature_id", "facet", "value")
        .agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    )


def tag_counts(items: DataFrame, *keys: str) -> DataFrame:
    """(signature_id, value, n, first_pos) of tags; `first_pos` also tells tags of one item apart."""
    alike = _alike(items, *keys, "severity")
    tags = alike.select(*keys, "signature_id", "n", F.col("first_pos").alias("pos"), F.posexplode("tags").alias("at", "value"))
    return (
        tags.filter("value IS NOT NULL")
        .groupBy(*keys, "signature_id", "value")
        .agg(F.sum("n").alias("n"), F.min(F.struct("pos", "at")).alias("first_pos"))
    )


def _counter(facet: str) -> Column:
    """Map value -> n of a facet with few values."""
    entry = F.when(F.col("facet") == facet, F.struct("value", "n"))
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def _mode(facet: str) -> Column:
    """Most frequent value, first seen on ties."""
    order = F.when(F.col("facet") == facet, F.struct(-F.col("n"), F.col("first_pos")))
    return F.min_by("value", order)


def _has(facet: str, value: str) -> Column:
    return F.coalesce(F.bool_or((F.col("facet") == facet) & (F.col("value") == value)), F.lit(False))


def top_values(counts: DataFrame, keys, limit: int, out: str) -> DataFrame:
    """The `limit` most frequent values per key as array<struct<value, n>>, first seen on ties."""
    best = first_per_key(counts, keys, [F.desc("n"), F.col("first_pos")], limit)
    return (
        best.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "value", "n"))).alias("_best"))
        .select(*keys, F.transform("_best", lambda b: F.struct(b["value"].alias("value"), b["n"].alias("n"))).alias(out))
    )


def _no_tags() -> Column:
    return F.array().cast("array<struct<value:string,n:bigint>>")


def rollups(items: DataFrame, max_samples: int = MAX_SAMPLES, max_tags: int = MAX_TAGS) -> DataFrame:
    """Clusters of items with the same signature. Sort with `in_rank_order`."""
    return from_counts(facet_counts(items), tag_counts(items), first_items(items, max_samples), max_tags)


def from_counts(counts: DataFrame, tag_rows: DataFrame, first: DataFrame, max_tags: int = MAX_TAGS) -> DataFrame:
    """Clusters from `facet_counts`, `tag_counts` and `first_items`."""
    is_severity = F.col("facet") == "severity"
    worst = F.when(is_severity, F.struct(-F.expr(severity_rank("value")), F.col("first_pos")))
    reasons = F.sort_array(
        F.collect_list(F.when(F.col("facet") == "reason", F.struct(-F.col("n"), "first_pos", "value", "n")))
    )
    base = counts.groupBy("signature_id").agg(
        F.max(F.when(F.col("facet") == "signature", F.col("value"))).alias("signature_text"),
        F.sum(F.when(F.col("facet") == "kind", F.col("n"))).alias("count_items"),
        F.count_if(F.col("facet") == "session").alias("count_sessions"),
        F.min("first_pos").alias("first_pos"),
        _counter("kind").alias("kind_counts"),
        _counter("kind_v2").alias("kind_v2_counts"),
        _mode("kind_v2").alias("kind_v2_primary"),
        _mode("sentiment").alias("sentiment"),
        F.coalesce(_mode("summary"), F.lit("")).alias("canonical_summary"),
        F.min_by("value", worst).alias("max_severity"),
        F.transform(
            F.slice(reasons, 1, 2), lambda r: F.struct(r["value"].alias("value"), r["n"].alias("n"))
        ).alias("kind_v2_reason_top"),
        _has("tag", "incident").alias("incident"),
        _has("kind", "error").alias("error"),
        _has("kind", "user_frustration").alias("frustration"),
    )
    tags = top_values(tag_rows, ["signature_id"], max_tags, "tags_top")
    clusters = (
        base.withColumn("signature_text", F.expr(redacted_if_needed("signature_text")))
        .join(tags, "signature_id", "left")
        .withColumn("tags_top", F.coalesce("tags_top", _no_tags()))
    )
    return scored(clusters).join(samples(first), "signature_id", "left")


def first_items(items: DataFrame, limit: int = MAX_SAMPLES, *keys: str) -> DataFrame:
    """(signature_id, pos, ref, _rank): references to the first items of each signature, also by `keys`."""
    wanted = [c for c in ("item_id", "session_id", "span", "source") if c in items.columns]
    by = [c for c in _SIGNATURE if c in items.columns]
    refs = items.select(*keys, *_SIGNED, *by, "pos", F.struct(*wanted).alias("ref"))
    if len(by) < len(_SIGNATURE):
        # The first items of a signature are among the first of their kind, summary and tags.
        refs = with_signature(first_per_key(refs, [*keys, *_SIGNED], [F.col("pos")], limit).drop("_rank"))
    refs = refs.select(*keys, "signature_id", "pos", "ref")
    return first_per_key(refs, [*keys, "signature_id"], [F.col("pos")], limit)


def samples(first: DataFrame) -> DataFrame:
    """The references of `first_items` as one list per signature."""
    listed = F.sort_array(F.collect_list(F.struct("_rank", "ref")))
    return first.groupBy("signature_id").agg(F.transform(listed, lambda s: s["ref"]).alias("sample_refs"))


def scored(clusters: DataFrame) -> DataFrame:
    """Add tier, reasons, score and fingerprint to clusters with counters and flags; `incident` stays."""
    flags = ("incident", "error", "frustration")
    text = fingerprint_text("kind_v2_primary", "canonical_summary", "tags_top.value")
    return (
        clusters.withColumn("_tier", F.expr(group_tier("max_severity", *flags)))
        .withColumn("tier", F.col("_tier.tier"))
        .withColumn("tier_reasons", F.col("_tier.reasons"))
        .withColumn("score", F.expr(group_score("count_items", "max_severity", *flags)))
        .withColumn("fingerprint_text", F.expr(text))
        .withColumn("fingerprint_id", F.expr(hashed("fp1:", "fingerprint_text")))
        .withColumn("fingerprint_text", F.expr(redacted_if_needed("fingerprint_text")))
        .drop("_tier", "error", "frustration")
    )


def rank_order() -> list[Column]:
    return [F.col("tier"), F.desc("score"), F.col("first_pos")]


def in_rank_order(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(*rank_order())


def rollup_summary(clusters: DataFrame) -> DataFrame:
    """(items, groups, tier1, tier2, tier3)."""
    return clusters.agg(
        F.coalesce(F.sum("count_items"), F.lit(0)).alias("items"),
        F.count("*").alias("groups"),
        *[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in (1, 2, 3)],
    )


def browse(clusters: DataFrame, kind_v2=None, tier=None, tag=None) -> DataFrame:
    """Clusters by finer kind, tier and tag, best score first."""
    out = clusters
    if kind_v2 is not None:
        out = out.filter(F.col("kind_v2_primary") == kind_v2)
    if tier is not None:
        out = out.filter(F.col("tier") == tier)
    if tag is not None:
        out = out.filter(F.array_contains("tags_top.value", tag))
    return out.orderBy(F.desc("score"), "first_pos")


def one_per_kind(clusters: DataFrame) -> DataFrame:
    """The best cluster of each finer kind."""
    return first_per_key(clusters, ["kind_v2_primary"], rank_order(), 1).drop("_rank")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Clusters of two runs side by side, by fingerprint: new, gone, changed or same."""

    def totals(clusters: DataFrame, name: str) -> DataFrame:
        return clusters.groupBy("fingerprint_id").agg(
            F.sum("count_items").alias(f"items_{name}"), F.max("score").alias(f"score_{name}")
        )

    joined = totals(before, "before").join(totals(after, "after"), "fingerprint_id", "full_outer")
    state = (
        F.when(F.col("items_before").isNull(), F.lit("new"))
        .when(F.col("items_after").isNull(), F.lit("gone"))
        .when(F.col("items_before") != F.col("items_after"), F.lit("changed"))
        .otherwise(F.lit("same"))
    )
    return joined.withColumn("state", state)
