"""Tickets from clusters: projection, upsert against existing tickets, spoken lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import fixed
from signalmill.operators.ordered import first_per_key
from signalmill.operators.rollup import rank_order


def ticketable(clusters: DataFrame, max_tier: int = 3, min_sessions: int = 1, min_items: int = 1) -> DataFrame:
    enough = (
        (F.col("max_severity") == "critical")
        | (F.col("count_sessions") >= min_sessions)
        | (F.col("count_items") >= min_items)
    )
    return clusters.filter((F.col("tier") <= max_tier) & enough)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def _number_map(column: str) -> Column:
    pair = F.transform(
        F.map_entries(column), lambda e: F.concat(_quoted(e["key"]), F.lit(": "), e["value"].cast("string"))
    )
    return F.concat(F.lit("{"), F.array_join(pair, ", "), F.lit("}"))


def _sample_line(ref: Column) -> Column:
    span = F.concat(
        F.lit("{'start_i': "), ref["span"]["start_i"].cast("string"),
        F.lit(", 'end_i': "), ref["span"]["end_i"].cast("string"), F.lit("}"),
    )
    source = F.concat(
        F.lit("{'file_hint': "), _quoted(ref["source"]["file_hint"]),
        F.lit(", 'chunk_id': "), _quoted(ref["source"]["chunk_id"]), F.lit("}"),
    )
    return F.concat(
        F.lit("- item_id="), ref["item_id"], F.lit(" session_id="), ref["session_id"],
        F.lit(" span="), span, F.lit(" source="), source,
    )


def ticket_body() -> Column:
    """Multi-line description of a cluster; absent parts read `None`."""

    def text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("None"))

    tags = F.array_join(
        F.transform("tags_top", lambda t: F.concat(t["value"], F.lit(":"), t["n"].cast("string"))), ", "
    )
    reasons = F.concat(F.lit("["), F.array_join(F.transform("tier_reasons", _quoted), ", "), F.lit("]"))
    lines = F.array_join(F.transform("sample_refs", _sample_line), "\n")
    return F.concat(
        F.lit("Fingerprint: "), text("fingerprint_id"),
        F.lit("\nCanonical summary: "), text("canonical_summary"),
        F.lit("\nkind_v2: "), _number_map("kind_v2_counts"),
        F.lit("\nmax_severity: "), text("max_severity"),
        F.lit("\ntier: "), text("tier"), F.lit(" reasons="), reasons,
        F.lit("\nscore: "), text("score"),
        F.lit("\ncount_items: "), text("count_items"),
        F.lit(" count_sessions: "), text("count_sessions"),
        F.lit("\ntags_top: "), tags,
        F.lit("\nsamples:\n"), F.coalesce(F.nullif(lines, F.lit("")), F.lit("(none)")), F.lit("\n"),
    )


def ticket_ir(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        F.lit(1).alias("schema_version"),
        "fingerprint_id",
        F.concat(F.lit("Signal: "), "canonical_summary").alias("title"),
        ticket_body().alias("body"),
        F.lit(80).alias("priority"),
        "kind_v2_primary",
        "kind_v2_counts",
        "max_severity",
        "tier",
        "score",
        "count_items",
        "count_sessions",
        "tags_top",
        "canonical_summary",
        "sample_refs",
        "first_pos",
    )


def ticket_summary(tickets: DataFrame) -> DataFrame:
    """(facet, value, tickets): total, by tier, by finer kind, from one pass."""
    cube = tickets.select(F.col("tier").cast("string").alias("tier"), "kind_v2_primary").groupingSets(
        [["tier"], ["kind_v2_primary"], []], "tier", "kind_v2_primary"
    )
    level = F.grouping_id()
    return cube.agg(F.count("*").alias("tickets"), level.alias("g")).select(
        F.when(F.col("g") == 1, "tier").when(F.col("g") == 2, "kind_v2_primary").otherwise("total").alias("facet"),
        F.coalesce("tier", "kind_v2_primary", F.lit("all")).alias("value"),
        "tickets",
    )


def existing_fingerprints(tickets: DataFrame) -> DataFrame:
    """(fingerprint_id, id, phid, name) from tickets(id, phid, name, description, pos).

    The last ticket that names a fingerprint wins.
    """
    text = F.concat_ws("\n", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.FINGERPRINT), 1))
    return (
        tickets.select("id", "phid", "name", "pos", F.explode(found).alias("fingerprint_id"))
        .groupBy("fingerprint_id")
        .agg(F.max_by(F.struct("id", "phid", "name"), "pos").alias("t"))
        .select("fingerprint_id", "t.*")
    )


def ticket_updates(clusters: DataFrame, existing: DataFrame) -> DataFrame:
    """Clusters that already have a ticket, with its id and the comment to add."""
    known = existing.select("fingerprint_id", F.col("id").alias("ticket_id"))
    comment = F.concat(F.lit("Rollup update:\n\n"), ticket_body())
    return clusters.join(known, "fingerprint_id").withColumn("comment", comment)


def ticket_creates(
    clusters: DataFrame,
    existing: DataFrame,
    max_tier: int = 1,
    min_sessions: int = 3,
    min_items: int = 10,
    max_create: int = 10,
) -> DataFrame:
    """The best new clusters that deserve a ticket, one per fingerprint."""
    new = clusters.filter(F.coalesce("fingerprint_id", F.lit("")) != "").join(
        existing.select("fingerprint_id"), "fingerprint_id", "left_anti"
    )
    wanted = ticketable(new, max_tier, min_sessions, min_items)
    once = first_per_key(wanted, ["fingerprint_id"], rank_order(), 1).drop("_rank")
    return once.orderBy(*rank_order()).limit(max_create)


def spoken_lines(clusters: DataFrame, title_length: int = 60) -> DataFrame:
    """One spoken sentence and one detail sentence per cluster."""
    parts = F.split("signature_text", r"\|")
    title = F.when(F.size(parts) > 1, F.substring(F.get(parts, F.lit(1)), 1, title_length)).otherwise("Unknown")
    line = F.concat(
        F.lit("Tier "), F.col("tier").cast("string"), F.lit(" "), F.get(parts, F.lit(0)), F.lit(": "),
        F.translate(title, "_", " "), F.lit(". "), F.col("count_items").cast("string"), F.lit(" occurrences."),
    )
    tags = F.array_join(F.slice(F.col("tags_top.value"), 1, 5), ", ")
    reasons = F.coalesce(F.nullif(F.array_join("tier_reasons", ", "), F.lit("")), F.lit("none"))
    details = F.concat(
        F.lit("Severity: "), "max_severity", F.lit(". Tags: "), tags, F.lit(". Tier reasons: "), reasons, F.lit(".")
    )
    return clusters.select("signature_id", line.alias("line"), details.alias("details"), "tier", "score", "first_pos")


def spoken_tickets(clusters: DataFrame, prefix: str) -> DataFrame:
    """Ticket fields made from a cluster that a listener picked."""
    description = F.concat(
        F.lit("**Auto-triaged via voice**\n\nSignature: `"), F.substring("signature_id", 1, 20), F.lit("`\n\nTier: "),
        F.col("tier").cast("string"), F.lit("\nCount: "), F.col("count_items").cast("string"),
    )
    return clusters.select(
        "signature_id",
        F.concat(F.lit(prefix), F.substring("signature_text", 1, 60)).alias("title"),
        description.alias("description"),
        F.when(F.col("tier") == 1, 80).otherwise(50).alias("priority"),
    )


def preview(clusters: DataFrame, limit: int = 20) -> DataFrame:
    """The first clusters in rank order, each with the number of all clusters."""
    total = clusters.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    first = clusters.orderBy(*rank_order()).limit(limit).withColumn("one", F.lit(1))
    return first.join(total, "one").drop("one")
