"""Signals: rule-based mining, parsing of model answers, validation, item ids.

An item row has session_id, chunk_idx, rank, kind, summary, severity, confidence,
tags, evidence (array of event_i, role, field_path, quote), span, proposed_fix,
source and item_id. Its order key is `pos` = struct(session_id, chunk_idx, rank).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.functions import fixed
from signalmill.functions.classify import heuristic_signal, heuristic_summary
from signalmill.functions.sql import Sql, any_of, each, keep, let, no_texts, not_empty
from signalmill.functions.text import json_string, json_strings, rstrip, strip, truncate
from signalmill.operators.chunks import chunk_members
from signalmill.operators.ordered import first_per_key

MAX_ITEMS = 10
MAX_EVIDENCE = 2
MAX_SUMMARY = 120
MAX_QUOTE = 200

EVIDENCE = "array<struct<event_i:bigint,role:string,field_path:string,quote:string>>"
FIX = "struct<fix_type:string,description:string>"


def heuristic_hits(views: DataFrame) -> DataFrame:
    """Views that some rule fires on, with the signal. Row-local."""
    signal = heuristic_signal("role", "tool", "status", "error_code", "text")
    keep = [c for c in views.columns if c in ("session_id", "i", "v", "pos", "ts", "role", "text")]
    # The generator keeps the rules from being copied into a pushed-down filter.
    fired = views.select(*keep, F.expr(f"inline(array_compact(array({signal})))"))
    return fired.withColumn("summary", F.expr(heuristic_summary("text", MAX_SUMMARY)))


def quoted(body: Sql, quote: Sql, limit: int = MAX_QUOTE) -> Sql:
    """The quote, stripped and cut, if it occurs in `body` as it stands; else NULL."""

    def found(q: Sql) -> Sql:
        cut = f"IF(length({q}) > {limit}, {rstrip(f'left({q}, {limit})')}, {q})"
        return let(cut, lambda c: f"IF({c} <> '' AND contains({body}, {c}), {c}, NULL)")

    return let(strip(quote), found)


def normal_tags(tags: Sql) -> Sql:
    cut = each(tags, lambda t: f"left(lower({strip(t)}), 64)")
    return f"coalesce({keep(cut, not_empty)}, {no_texts()})"


def with_incident(tags: Sql, summary: Sql, quotes: Sql) -> Sql:
    quoted_too = any_of(quotes, lambda q: f"contains(lower({q}), 'incident')")
    mentioned = f"(contains(lower({summary}), 'incident') OR {quoted_too})"
    return let(
        tags,
        lambda t: f"IF({mentioned} AND NOT array_contains({t}, 'incident'), array_append({t}, 'incident'), {t})",
    )


def item_id(session_id: Sql, kind: Sql, summary: Sql, quotes: Sql) -> Sql:
    """Content hash over the item's JSON with sorted keys."""
    seed = (
        f"concat('{{\"kind\": ', {json_string(kind)}, ', \"quotes\": ', {json_strings(quotes)}, "
        f"', \"session_id\": ', {json_string(session_id)}, ', \"summary\": ', {json_string(summary)}, '}}')"
    )
    return f"concat('sha256:', sha2({seed}, 256))"


def heuristic_candidates(
    views: DataFrame, bounds: DataFrame, max_items: int = MAX_ITEMS, compat: bool = False
) -> DataFrame:
    """Rule hits per chunk, the first `max_items` by position, with the text they quote.

    Only hits are shuffled; chunk groups hold at most one chunk of views. The
    quote of a long text is its first 200 characters; with `compat` it is the
    shortened text with trailing dots, which validation then mostly rejects.
    """
    return chunk_candidates(heuristic_hits(views).join(chunk_members(bounds), ["session_id", "v"]), max_items, compat)


def chunk_candidates(hits: DataFrame, max_items: int = MAX_ITEMS, compat: bool = False) -> DataFrame:
    """`heuristic_candidates` of rule hits that carry their chunk_idx."""
    quote = F.expr(truncate("text", MAX_QUOTE) if compat else rstrip(f"left({strip('text')}, {MAX_QUOTE})"))
    evidence = F.array(
        F.struct(
            F.col("i").cast("bigint").alias("event_i"), "role", F.lit("text").alias("field_path"), quote.alias("quote")
        )
    )
    first = first_per_key(hits, ["session_id", "chunk_idx"], [F.col("i")], max_items)
    return first.select(
        "session_id",
        "chunk_idx",
        F.col("_rank").cast("bigint").alias("item_no"),
        "kind",
        "summary",
        "severity",
        F.col("confidence").cast("double").alias("confidence"),
        "tags",
        evidence.cast(EVIDENCE).alias("evidence"),
        F.lit(None).cast(FIX).alias("proposed_fix"),
        "text",
    )


def validated(
    candidates: DataFrame,
    views: DataFrame,
    bounds: DataFrame,
    max_items: int = MAX_ITEMS,
    max_evidence: int = MAX_EVIDENCE,
) -> DataFrame:
    """Keep items whose evidence quotes a view of their own chunk, with all fields in order.

    Candidates: session_id, chunk_idx, item_no, kind, summary, severity,
    confidence, tags, evidence, proposed_fix; one of the first `max_evidence`
    entries must hold.
    """
    key = ["session_id", "chunk_idx", "item_no"]
    named = (
        candidates.withColumn("kind", F.expr(strip("kind")))
        .withColumn("summary", F.expr(strip("summary")))
        .filter(F.col("kind").isin(*fixed.KINDS) & (F.col("summary") != ""))
        .withColumn("summary", F.expr(truncate("summary", MAX_SUMMARY)))
    )
    pointers = named.select(
        *key, F.posexplode(F.slice("evidence", 1, max_evidence)).alias("n", "e")
    ).select(*key, "n", "e", F.col("e.event_i").alias("i"))
    # The views of a chunk are found by position, so a long session stays split.
    span = bounds.select("session_id", "chunk_idx", "start_v", "end_v")
    texts = views.select("session_id", "i", "v", F.col("role").alias("view_role"), "text")
    proven = (
        pointers.join(texts, ["session_id", "i"])
        .join(span, ["session_id", "chunk_idx"])
        .filter("v >= start_v AND v < end_v")
        .withColumn("quote", F.expr(quoted("text", "e.quote")))
        .filter("quote IS NOT NULL")
        .groupBy(*key)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "n",
                        F.struct(
                            F.col("i").alias("event_i"),
                            F.coalesce("e.role", "view_role").alias("role"),
                            F.coalesce("e.field_path", F.lit("text")).alias("field_path"),
                            "quote",
                        ).alias("e"),
                    )
                )
            ).alias("proven")
        )
        .select(*key, F.col("proven.e").cast(EVIDENCE).alias("evidence"))
    )
    return _finished(named.drop("evidence").join(proven, key), max_items)


def validated_hits(candidates: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """`validated` for rule hits: the quoted text is on the row, so nothing is joined."""
    proven = candidates.withColumn("quote", F.expr(quoted("text", "evidence[0].quote"))).filter("quote IS NOT NULL")
    evidence = F.transform("evidence", lambda e: e.withField("quote", F.col("quote")))
    return _finished(proven.withColumn("evidence", evidence).drop("quote", "text"), max_items)


def _finished(items: DataFrame, max_items: int) -> DataFrame:
    """Normalise severity, confidence and tags, add ids, keep the most confident items of a chunk."""
    severity = F.lower(F.expr(strip("coalesce(severity, 'unknown')")))
    confidence = F.when(F.col("confidence").between(0.0, 1.0), F.col("confidence")).otherwise(F.lit(0.5))
    items = (
        items.withColumn("severity", F.when(severity.isin(*fixed.SEVERITY_RANK), severity).otherwise("unknown"))
        .withColumn("confidence", confidence)
        .withColumn("quotes", F.col("evidence.quote"))
        .withColumn("tags", F.expr(with_incident(normal_tags("tags"), "summary", "quotes")))
    )
    best = [F.desc("confidence"), F.col("item_no")]
    fix = F.when(F.expr(strip("proposed_fix.description")) != "", F.col("proposed_fix"))
    kept = first_per_key(items, ["session_id", "chunk_idx"], best, max_items)
    chunk_id = F.concat("session_id", F.lit("/chunk:"), F.col("chunk_idx").cast("string"))
    return kept.select(
        F.lit(1).alias("schema_version"),
        F.expr(item_id("session_id", "kind", "summary", "quotes")).alias("item_id"),
        "session_id",
        "chunk_idx",
        F.col("_rank").cast("bigint").alias("rank"),
        F.struct(F.col("session_id").alias("file_hint"), chunk_id.alias("chunk_id")).alias("source"),
        "kind",
        "summary",
        "severity",
        "confidence",
        "tags",
        F.struct(
            F.array_min("evidence.event_i").alias("start_i"), F.array_max("evidence.event_i").alias("end_i")
        ).alias("span"),
        "evidence",
        fix.alias("proposed_fix"),
        F.struct("session_id", F.col("chunk_idx").cast("bigint"), F.col("_rank").cast("bigint").alias("rank")).alias("pos"),
    )


def without_overlap(items: DataFrame) -> DataFrame:
    """One row per item and evidence place: overlapping chunks report the same item twice."""
    place = ["session_id", "item_id", "at"]
    rest = [c for c in items.columns if c not in place]
    first = (
        items.withColumn("at", F.transform("evidence", lambda e: e["event_i"]))
        .groupBy(*place)
        .agg(F.min_by(F.struct(*rest), "pos").alias("row"))
        .select(*[c for c in place if c != "at"], "row.*")
    )
    return first.select(*items.columns)


def mine(views: DataFrame, bounds: DataFrame, max_items: int = MAX_ITEMS, compat: bool = False) -> DataFrame:
    """Rule-based mining of numbered views. `compat` keeps repeats from overlapping chunks."""
    items = validated_hits(heuristic_candidates(views, bounds, max_items, compat), max_items)
    return items if compat else without_overlap(items)


ANSWER_ITEM = (
    "struct<kind:string,summary:string,severity:string,confidence:double,tags:array<string>,"
    f"evidence:{EVIDENCE},proposed_fix:{FIX}>"
)


def answers_to_candidates(answers: DataFrame) -> DataFrame:
    """Candidates from model answers (session_id, chunk_idx, answer).

    The widest `{...}` span of the text must be a JSON object; its list `items`
    gives the candidates, entry by entry: an entry that is no object costs only
    itself, and a field of a wrong type only that field.
    """
    body = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    whole = answers.select("session_id", "chunk_idx", F.try_parse_json(F.nullif(body, F.lit(""))).alias("whole"))
    listed = F.try_variant_get("whole", "$.items", "array<variant>")
    entries = whole.select("session_id", "chunk_idx", F.posexplode(listed).alias("n", "entry"))
    objects = entries.filter(F.startswith(F.schema_of_variant("entry"), F.lit("OBJECT")))
    parsed = objects.withColumn("item", F.from_json(F.to_json("entry"), ANSWER_ITEM))
    return parsed.select("session_id", "chunk_idx", (F.col("n") + 1).cast("bigint").alias("item_no"), "item.*")


def mine_summary(views: DataFrame, items: DataFrame) -> DataFrame:
    """Sessions scanned, sessions with an item, items."""
    both = views.select(F.col("session_id").alias("scanned"), F.lit(None).cast("string").alias("found")).unionByName(
        items.select(F.lit(None).cast("string").alias("scanned"), F.col("session_id").alias("found"))
    )
    return both.agg(
        F.count_distinct("scanned").alias("sessions_scanned"),
        F.count_distinct("found").alias("sessions_with_items"),
        F.count("found").alias("items"),
    )
