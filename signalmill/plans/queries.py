"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions import text as tx
from signalmill.functions.classify import kind_v2, sentiment, spoken_command
from signalmill.functions.sql import no_texts
from signalmill.operators import (
    chunks,
    cron,
    evaluate,
    events,
    evidence,
    graph,
    inspect,
    intervals,
    latency,
    merge,
    patterns,
    requests,
    rollup,
    rollup_state,
    signals,
    text_index,
    throttle,
    tickets,
    triage,
    workflow,
)
from signalmill.operators.answers import AnswerStore
from signalmill.operators.ordered import first_per_key
from signalmill.operators.stable import new_path, stable
from signalmill.sources import documents as docs
from signalmill.sources import items as item_files
from signalmill.sources import sessions, tables
from signalmill.streaming import gaps, live, mining, samples

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}
_shared: dict[tuple[str, str, str], DataFrame] = {}


def register(fn: Query) -> Query:
    _registry[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_registry)


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """An intermediate table, written once per application and read by later queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = stable(make())
    return _shared[key]


# --- shared stages -----------------------------------------------------------


def _views(spark, sf_dir) -> DataFrame:
    # Every trace row is a view, so its position is the dense index of the trace.
    return tables.trace(spark, sf_dir).withColumn("v", F.col("i"))


def _bounds(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "bounds", lambda: chunks.chunk_bounds(_views(spark, sf_dir)))


def _items(spark, sf_dir) -> DataFrame:
    return _once(
        spark, sf_dir, "items", lambda: signals.mine(_views(spark, sf_dir), _bounds(spark, sf_dir))
    )


def _clusters(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "clusters", lambda: rollup.rollups(_items(spark, sf_dir)))


def _json_events(spark, sf_dir) -> DataFrame:
    return sessions.parse_events(tables.trace_json(spark, sf_dir))


def _calls(spark, sf_dir) -> DataFrame:
    made = tables.trace(spark, sf_dir).filter("role = 'toolCall'").select("session_id", "i", "tool")
    return workflow.numbered_calls(made)


def _messages(spark, sf_dir) -> DataFrame:
    return tables.trace(spark, sf_dir).select(
        "session_id", F.col("i").alias("idx"), F.date_format("ts", _ISO).alias("timestamp"), "role", "text"
    )


def _latencies(spark, sf_dir) -> DataFrame:
    """`events` read as latency samples: an error event is a failed call."""
    return tables.table(spark, sf_dir, "events").select(
        F.col("event_type").substr(1, 2).alias("phase"),
        F.col("event_id").alias("call_id"),
        F.col("ts").cast("timestamp").alias("start_ts"),
        F.col("value").alias("latency_ms"),
        (F.col("user_id") % 7 != 0).alias("success"),
        F.when(F.col("event_id") % 2 == 0, "TIMEOUT after 35s").otherwise("refused").alias("error"),
    )


def _pairs(column: str, value: str = "value", n: str = "n"):
    return F.array_join(
        F.transform(column, lambda t: F.concat(t[value], F.lit(":"), t[n].cast("string"))), ","
    )


def _map_text(column: str):
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(column)),
            lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")),
        ),
        ",",
    )


# --- text functions ----------------------------------------------------------


@register
def tokens_signature(spark, sf_dir):
    """Normalised text, bigram core and signature of every document's opening words and tags."""
    d = tables.table(spark, sf_dir, "documents")
    text = tx.signature_text("'other'", "text", "array(source, lang)")
    return d.selectExpr("doc_id", f"size({tx.tokens('text')}) AS n_tokens", f"{text} AS signature_text").withColumn(
        "signature_id", F.expr(tx.hashed("sig1:", "signature_text"))
    )


@register
def redact_documents(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id", f"{tx.redact('text')} AS text")


@register
def redact_strict(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id", f"{tx.redact('text', strict=True)} AS text")


@register
def keywords_documents(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    return d.selectExpr(
        "doc_id", f"array_join({tx.keywords('text')}, ',') AS keywords", f"{tx.slug('text')} AS slug"
    )


@register
def salience_digest(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.expr(f"inline(array({tx.digest('text', 800)}))"))


@register
def truncate_messages(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.expr(f"inline(array({tx.truncated('text', 200)}))"))


# --- raw events --------------------------------------------------------------


@register
def trace_view(spark, sf_dir):
    # By way of text, so that the session's time zone does not matter.
    stamp = F.to_timestamp(F.date_format("ts", _ISO))
    return tables.trace(spark, sf_dir).withColumn("ts", F.unix_micros(stamp))


@register
def event_views(spark, sf_dir):
    """Normalised events from raw JSON lines of every shape."""
    return events.event_views(_json_events(spark, sf_dir)).drop("line_no")


def _session_lines(spark, sf_dir) -> DataFrame:
    """The trace as lines of session files with some blank lines, in files of up to 65,536 events."""
    lines = tables.trace_json(spark, sf_dir).withColumn("part", F.expr("i div 65536"))
    named = F.concat_ws(".", F.coalesce("session_id", F.lit("__HIVE_DEFAULT_PARTITION__")), "part")
    value = F.when(F.col("pos") % 13 == 0, F.concat(F.lit("\n"), "value")).otherwise(F.col("value"))
    return lines.select(named.alias("session_id"), "i", value.alias("value"))


def _write_sessions(lines: DataFrame, path: str) -> str:
    """Lines as session files below `path`.

    A file costs the same whatever it holds, so the sessions are dealt to a
    fixed number of tasks per core, and each file lies in one folder.
    """
    (
        lines.repartition(8 * lines.sparkSession.sparkContext.defaultParallelism, "session_id")
        .sortWithinPartitions("session_id", "i")
        .select("session_id", "value")
        .write.partitionBy("session_id")
        .text(path)
    )
    return path


def _session_folder(spark, sf_dir) -> str:
    """The trace written as session files."""
    return _write_sessions(_session_lines(spark, sf_dir), new_path(spark, "sessions"))


# Session files of a folder, on average. The driver holds some 4 KB for each while it lists and reads the folder.
_FOLDER_FILES = 1 << 14


def _session_folders(spark, sf_dir) -> Iterator[str]:
    """The same files in folders of bounded size, one after another.

    The lines are dealt by folder first, so that a folder is written from its own
    lines, and the driver of a write holds the names of one folder only.
    """
    lines, path, dealt = _session_lines(spark, sf_dir), new_path(spark, "sessions"), new_path(spark, "session-lines")
    folders = 1 + lines.select("session_id").distinct().count() // _FOLDER_FILES
    (
        lines.withColumn("folder", F.pmod(F.xxhash64("session_id"), F.lit(folders)))
        .repartitionByRange(8 * spark.sparkContext.defaultParallelism, "folder", "session_id")
        .write.partitionBy("folder")
        .parquet(dealt)
    )
    rows = spark.read.schema("session_id string, i bigint, value string, folder bigint").parquet(dealt)
    for row in rows.select("folder").distinct().orderBy("folder").collect():
        yield _write_sessions(rows.filter(F.col("folder") == row.folder), f"{path}/{row.folder}")


# Session and part in the path of a file of that folder.
_SESSION = r"session_id=([^/]+)\.[0-9]+/"
_PART = r"session_id=[^/]+\.([0-9]+)/"


@register
def session_files(spark, sf_dir):
    """Session files read back and numbered."""
    path = _session_folder(spark, sf_dir)
    read = sessions.read_sessions(spark, path, include=["session_id=s*"], name_glob="*.txt")
    named = read.select(
        F.regexp_extract("rel_path", _SESSION, 1).alias("session_id"),
        F.regexp_extract("rel_path", _PART, 1).cast("bigint").alias("part"),
        "line_no",
        "i",
        F.col("parse_error").isNotNull().alias("bad"),
        F.expr("try_variant_get(event, '$.message.role', 'string')").alias("role"),
    )
    return named.withColumn("i", F.col("part") * 65536 + F.col("i")).drop("part")


@register
def document_views(spark, sf_dir):
    """Documents of every event shape as normalised events, uncut."""
    views = events.event_views(sessions.parse_events(tables.document_json(spark, sf_dir)), max_text=1 << 30)
    return views.select("session_id", "i", "role", "tool", "status", "error_code", F.md5("text").alias("text_md5"), "raw_shape")


@register
def document_failures(spark, sf_dir):
    found = events.failures(sessions.parse_events(tables.document_json(spark, sf_dir)), limit=None)
    return found.select("session_id", "i", "kind", "detail", "tool_name", "status", "exit_code")


@register
def document_calls(spark, sf_dir):
    calls = events.tool_calls(sessions.parse_events(tables.document_json(spark, sf_dir)))
    return calls.select("session_id", "i", "tool_name", "action", "status", "exit_code", "error", "preview")


@register
def session_openings(spark, sf_dir):
    """The first five events of every session file."""
    read = sessions.read_sessions(
        spark, _session_folder(spark, sf_dir), exclude=["session_id=*.[!0]*/*"], max_events=5, name_glob="*.txt"
    )
    return read.select(F.regexp_extract("rel_path", _SESSION, 1).alias("session_id"), "line_no", "i")


@register
def message_files(spark, sf_dir):
    """Messages of the session files with the text of their first text block."""
    read = sessions.read_messages(spark, _session_folder(spark, sf_dir), name_glob="*.txt")
    return read.select(
        F.regexp_extract("rel_path", _SESSION, 1).alias("session_id"), "idx", "timestamp", "role", "text"
    )


@register
def redacted_views(spark, sf_dir):
    """Normalised events with their texts redacted on the way."""
    views = events.event_views(_json_events(spark, sf_dir), redactor=tx.redact)
    return views.select("session_id", "i", "text")


@register
def markdown_files(spark, sf_dir):
    """Benchmark texts written as a document file each and read back."""
    path = new_path(spark, "documents")
    tables.table(spark, sf_dir, "benchmark").write.partitionBy("item_id").text(path)
    read = docs.read_documents(spark, path, name_glob="*.txt")
    return read.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"), F.md5("text").alias("text_md5"))


@register
def tool_calls(spark, sf_dir):
    return events.tool_calls(_json_events(spark, sf_dir))


@register
def failures(spark, sf_dir):
    return events.failures(_json_events(spark, sf_dir))


@register
def search_hits(spark, sf_dir):
    hits = inspect.search_hits(_json_events(spark, sf_dir), "GATEWAY")
    return hits.withColumn("keys", F.array_join("keys", ","))


@register
def span_window(spark, sf_dir):
    """A window of events with two of their fields."""
    return inspect.compact_window(_json_events(spark, sf_dir), 5, 300, ["type", "timestamp"])


@register
def span_summary(spark, sf_dir):
    return inspect.span_summary(_json_events(spark, sf_dir), 0, 40)


# --- chunks and signals ------------------------------------------------------


@register
def chunk_spans(spark, sf_dir):
    return chunks.chunk_spans(_views(spark, sf_dir), _bounds(spark, sf_dir))


@register
def chunk_turns(spark, sf_dir):
    """Short chunks over the turns of conversations."""
    c = tables.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("v"), "role"
    )
    return chunks.chunk_bounds(c, size=4, overlap=1)


@register
def chunk_members(spark, sf_dir):
    inside = chunks.chunk_views(_views(spark, sf_dir), _bounds(spark, sf_dir))
    return inside.groupBy("session_id", "chunk_idx").agg(
        F.count("*").alias("views"),
        F.count_if(F.col("role") == "user").alias("user_views"),
        F.sum("pos").alias("pos_sum"),
    )


@register
def heuristic_signals(spark, sf_dir):
    hits = signals.heuristic_hits(tables.trace(spark, sf_dir))
    return hits.select(
        "session_id", "i", "kind", "severity", "confidence", F.array_join("tags", ",").alias("tags"), "summary"
    )


def _flat_items(items: DataFrame) -> DataFrame:
    return items.select(
        "item_id",
        "session_id",
        "chunk_idx",
        "rank",
        "kind",
        "summary",
        "severity",
        "confidence",
        F.array_join("tags", ",").alias("tags"),
        F.col("span.start_i").alias("start_i"),
        F.col("span.end_i").alias("end_i"),
        F.array_join("evidence.quote", "|").alias("quotes"),
    )


@register
def mined_items(spark, sf_dir):
    """Validated items, once each."""
    return _flat_items(_items(spark, sf_dir))


def _item_folder(spark, sf_dir) -> str:
    path = new_path(spark, "items")
    item_files.write_items(_items(spark, sf_dir), path)
    return path


@register
def item_files_read(spark, sf_dir):
    """Items written as JSON lines and read back."""
    items = item_files.read_items(spark, _item_folder(spark, sf_dir))
    return items.select(
        "item_id", "session_id", "kind", "summary", "severity", "confidence",
        F.array_join("tags", ",").alias("tags"), F.col("span.start_i").alias("start_i"),
        F.array_join("evidence.quote", "|").alias("quotes"),
    )


@register
def items_per_summary(spark, sf_dir):
    """How many of the first two items of each summary an item file has."""
    items = item_files.read_items(spark, _item_folder(spark, sf_dir), strict=False)
    return item_files.first_per_summary(items, 2).groupBy("summary").agg(F.count("*").alias("n"))


@register
def mined_items_per_chunk(spark, sf_dir):
    """Validated items as each chunk reports them, repeats from overlapping chunks included."""
    return _flat_items(signals.mine(_views(spark, sf_dir), _bounds(spark, sf_dir), compat=True))


@register
def mine_summary(spark, sf_dir):
    return signals.mine_summary(_views(spark, sf_dir), _items(spark, sf_dir))


# --- clusters ----------------------------------------------------------------


@register
def rollup_ranked(spark, sf_dir):
    ranked = rollup.in_rank_order(_clusters(spark, sf_dir))
    return ranked.select(
        "signature_id", "count_items", "count_sessions", "max_severity", "tier", F.round("score", 6).alias("score")
    )


@register
def cluster_files(spark, sf_dir):
    """Clusters written as JSON lines and read back."""
    path = new_path(spark, "clusters")
    clusters = _clusters(spark, sf_dir)
    item_files.write_clusters(clusters, path)
    return item_files.read_cluster_lines(spark, path).select(
        "signature_id", "count_items", "count_sessions", "max_severity", "tier", F.round("score", 6).alias("score"),
        "kind_v2_primary", _map_text("kind_counts").alias("kind_counts"), _pairs("tags_top").alias("tags_top"),
        "canonical_summary", "fingerprint_id",
    )


@register
def rollup_daily(spark, sf_dir):
    """Clusters from items that come in three deliveries, among them drafts that a later one takes back."""
    state = rollup_state.RollupState(spark, new_path(spark, "rollup-state"))
    items = _items(spark, sf_dir).withColumn("day", F.pmod(F.xxhash64("item_id"), F.lit(3)))
    drafts = items.filter("day = 2").withColumn("item_id", F.concat(F.lit("draft:"), "item_id"))
    days = [items.filter("day = 0").unionByName(drafts), items.filter("day = 1"), items.filter("day = 2")]
    for k, delivered in enumerate(days):
        state.add(delivered.drop("day"), drafts.select("item_id") if k == 2 else None, k)
    return state.clusters(len(days)).select(
        "signature_id", "count_items", "count_sessions", "max_severity", "tier", F.round("score", 6).alias("score"),
        "kind_v2_primary", _map_text("kind_counts").alias("kind_counts"), _pairs("tags_top").alias("tags_top"),
        "canonical_summary", "fingerprint_id",
    )


@register
def report_header(spark, sf_dir):
    return item_files.report_header(_clusters(spark, sf_dir))


@register
def rollup_counters(spark, sf_dir):
    return _clusters(spark, sf_dir).select(
        "signature_id",
        "signature_text",
        "canonical_summary",
        _map_text("kind_counts").alias("kind_counts"),
        _map_text("kind_v2_counts").alias("kind_v2_counts"),
        "kind_v2_primary",
        "sentiment",
        F.array_join("tier_reasons", ",").alias("tier_reasons"),
        _pairs("kind_v2_reason_top").alias("reasons"),
    )


@register
def rollup_fingerprints(spark, sf_dir):
    return _clusters(spark, sf_dir).select(
        "signature_id", _pairs("tags_top").alias("tags_top"), "fingerprint_text", "fingerprint_id"
    )


@register
def rollup_samples(spark, sf_dir):
    return _clusters(spark, sf_dir).select(
        "signature_id",
        F.array_join(F.col("sample_refs.item_id"), ",").alias("sample_items"),
        F.array_join(F.col("sample_refs.source.chunk_id"), ",").alias("sample_chunks"),
    )


@register
def rollup_summary(spark, sf_dir):
    return rollup.rollup_summary(_clusters(spark, sf_dir))


@register
def kind_v2_labels(spark, sf_dir):
    """Finer class, reason and sentiment of every view's text under three kinds."""
    t = tables.trace(spark, sf_dir).select(
        "session_id", "i", "text", F.explode(F.array(*[F.lit(k) for k in ("error", "improvement_suggestion", "other")])).alias("kind")
    )
    fine = kind_v2("kind", "text", no_texts())
    return t.selectExpr("session_id", "i", "kind", f"{fine} AS f", f"{sentiment('kind', 'text')} AS sentiment").select(
        "session_id", "i", "kind", F.col("f.label").alias("kind_v2"), F.col("f.reason").alias("reason"), "sentiment"
    )


@register
def rollup_browse(spark, sf_dir):
    found = rollup.browse(_clusters(spark, sf_dir), tier=2, tag="suggestion")
    more = rollup.browse(_clusters(spark, sf_dir), kind_v2="defect")
    return found.unionByName(more).select("signature_id", "kind_v2_primary", "tier", F.round("score", 6).alias("score"))


@register
def best_per_kind(spark, sf_dir):
    best = rollup.one_per_kind(_clusters(spark, sf_dir))
    return best.select("kind_v2_primary", "signature_id", "tier", F.round("score", 6).alias("score"))


@register
def rollup_diff(spark, sf_dir):
    """Clusters from before event 30 of a session against those from there on, by fingerprint."""
    items = _items(spark, sf_dir)
    early = rollup.rollups(items.filter("span.start_i < 30"))
    late = rollup.rollups(items.filter("span.start_i >= 30"))
    return rollup.compare(early, late).select("fingerprint_id", "items_before", "items_after", "state")


# --- merging -----------------------------------------------------------------


@register
def similar_pairs(spark, sf_dir):
    pairs = merge.similar_pairs(_clusters(spark, sf_dir))
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"))


@register
def merge_components(spark, sf_dir):
    return _once(spark, sf_dir, "members", lambda: merge.merge_components(_clusters(spark, sf_dir)))


@register
def components_daily(spark, sf_dir):
    """Components of similar clusters whose edges come in batches, of which each only adds to what is stored."""
    path = new_path(spark, "components")
    edges = stable(merge.merge_edges(_clusters(spark, sf_dir)).select("a", "b"))
    days = 4
    for day in range(days):
        graph.add_batch(edges.filter(F.pmod(F.xxhash64("a", "b"), F.lit(days)) == day), path, day)
    kind = dict(edges.dtypes)["a"]
    return graph.read_grouping(spark, path, days, kind).current().select(F.col("id").alias("signature_id"), "component")


@register
def merged_rollups(spark, sf_dir):
    items = rollup.with_signature(_items(spark, sf_dir)).select("signature_id", "session_id")
    merged = merge.merged_rollups(_clusters(spark, sf_dir), merge_components(spark, sf_dir), items)
    return merged.select(
        "signature_id",
        "merged",
        "count_items",
        "count_sessions",
        "max_severity",
        "tier",
        F.round("score", 6).alias("score"),
        "kind_v2_primary",
        "sentiment",
        _map_text("kind_counts").alias("kind_counts"),
        _map_text("kind_v2_counts").alias("kind_v2_counts"),
        _pairs("tags_top").alias("tags_top"),
        "canonical_summary",
        "fingerprint_id",
    )


@register
def merged_members(spark, sf_dir):
    clusters = _clusters(spark, sf_dir)
    return merge.merged_from(clusters, merge_components(spark, sf_dir)).select("component", "signature_id", "tier")


@register
def merge_decisions(spark, sf_dir):
    """Pairs of a similarity band, a stand-in answer for each, and the edges that the answers add.

    The band is moved up to where the trace has pairs.
    """
    return merge.merge_decisions(_answered(merge.merge_requests(_clusters(spark, sf_dir), 0.6, 0.9)))


def _answered(asked: DataFrame) -> DataFrame:
    """Stand-in answers: sure from a similarity of 0.75 on."""
    sure = F.when(F.col("sim") >= 0.75, 0.9).otherwise(0.4)
    said = F.concat(F.lit('Sure: {"decision": "Merge", "confidence": '), sure.cast("string"), F.lit("}"))
    return asked.withColumn("answer", said)


@register
def similar_members(spark, sf_dir):
    """Similar clusters in rows per cluster: component, the cluster they share their words with, links."""
    return merge.similar_members(_clusters(spark, sf_dir))


@register
def asked_components(spark, sf_dir):
    """Components after asking in rounds, until no pair of the band between two of them is unasked."""
    clusters = _clusters(spark, sf_dir)
    return merge.merge_components(clusters, merge.asked_edges(clusters, _answered, 0.6, 0.9), threshold=0.9)


# --- tickets -----------------------------------------------------------------


def _tickets(spark, sf_dir) -> DataFrame:
    """A ticket table: one per cluster of failed tools or frustration, and one without a fingerprint."""
    known = _clusters(spark, sf_dir).filter("max_severity = 'medium'")
    return known.select(
        F.xxhash64("signature_id").alias("id"),
        F.concat(F.lit("T-"), F.substring("signature_id", 6, 8)).alias("phid"),
        F.concat(F.lit("Signal: "), "canonical_summary").alias("name"),
        F.concat(F.lit("Fingerprint: "), "fingerprint_id", F.lit("\nold")).alias("description"),
        F.col("signature_id").alias("pos"),
    )


@register
def ticket_ir(spark, sf_dir):
    ir = tickets.ticket_ir(tickets.ticketable(_clusters(spark, sf_dir), min_sessions=2, min_items=5))
    return ir.select(
        "fingerprint_id", "title", "priority", "kind_v2_primary", "tier", "count_items",
        F.regexp_extract("body", r"(?s)tags_top: (.*?)\n", 1).alias("body_tags"),
        F.regexp_extract("body", r"(?s)tier: (.*?)\n", 1).alias("body_tier"),
    )


@register
def ticket_summary(spark, sf_dir):
    return tickets.ticket_summary(tickets.ticket_ir(_clusters(spark, sf_dir)))


@register
def ticket_fingerprints(spark, sf_dir):
    found = tickets.existing_fingerprints(_tickets(spark, sf_dir))
    return found.select("fingerprint_id", "phid", "name")


@register
def ticket_updates(spark, sf_dir):
    known = tickets.existing_fingerprints(_tickets(spark, sf_dir))
    return tickets.ticket_updates(_clusters(spark, sf_dir), known).select("signature_id", "fingerprint_id", "count_items")


@register
def ticket_creates(spark, sf_dir):
    known = tickets.existing_fingerprints(_tickets(spark, sf_dir))
    made = tickets.ticket_creates(_clusters(spark, sf_dir), known, max_tier=3, max_create=10)
    return made.select("signature_id", "fingerprint_id", "tier", F.round("score", 6).alias("score"))


@register
def spoken_lines(spark, sf_dir):
    clusters = _clusters(spark, sf_dir)
    lines = tickets.spoken_lines(clusters).select("signature_id", "line", "details")
    made = tickets.spoken_tickets(clusters, "[signals] ").select("signature_id", "title", "priority")
    return lines.join(made, "signature_id")


@register
def spoken_commands(spark, sf_dir):
    t = tables.trace(spark, sf_dir)
    return t.select("session_id", "i", F.expr(spoken_command("text")).alias("command"))


@register
def cluster_preview(spark, sf_dir):
    return tickets.preview(_clusters(spark, sf_dir)).select("signature_id", "tier", "total")


@register
def cluster_report(spark, sf_dir):
    return item_files.cluster_report(_clusters(spark, sf_dir))


# --- triage ------------------------------------------------------------------


@register
def triage_scored(spark, sf_dir):
    return triage.triaged(_items(spark, sf_dir)).select(
        "item_id", F.col("span.start_i").alias("start_i"), "tier",
        F.array_join("tier_reasons", ",").alias("tier_reasons"), F.round("triage_score", 6).alias("triage_score"),
    )


@register
def triage_top(spark, sf_dir):
    best = triage.triage_top(_items(spark, sf_dir))
    return best.select("tier", "rank_in_tier", "item_id", "line")


@register
def triage_summary(spark, sf_dir):
    return triage.triage_summary(_items(spark, sf_dir))


@register
def top_tags(spark, sf_dir):
    return triage.top_tags(_items(spark, sf_dir))


# --- evidence ----------------------------------------------------------------


@register
def fuzzy_evidence(spark, sf_dir):
    return evidence.fuzzy_evidence(_clusters(spark, sf_dir), _items(spark, sf_dir))


@register
def session_context(spark, sf_dir):
    items = rollup.with_signature(_items(spark, sf_dir)).select("signature_id", "session_id")
    return evidence.session_context(_clusters(spark, sf_dir), items, tables.trace(spark, sf_dir))


@register
def span_context(spark, sf_dir):
    refs = _items(spark, sf_dir).select("session_id", "item_id", "span.start_i", "span.end_i")
    return evidence.span_context(refs, tables.trace(spark, sf_dir)).select(
        "session_id", "item_id", "start_i", "i", "role", "text"
    )


@register
def related_documents(spark, sf_dir):
    """The three documents nearest to each benchmark text, taken as a ticket."""
    tickets_of = tables.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("ticket_id"), F.col("text").alias("title"), F.lit("").alias("description")
    )
    found = evidence.related_documents(tables.table(spark, sf_dir, "documents"), tickets_of, path="doc_id")
    return found.select(F.col("ticket_id").alias("item_id"), "doc_id", "score")


@register
def related_by_index(spark, sf_dir):
    """`related_documents` from a stored index instead of a scan."""
    tickets_of = tables.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("ticket_id"), F.col("text").alias("title"), F.lit("").alias("description")
    )
    root = new_path(spark, "text-index")
    text_index.add_documents(tables.table(spark, sf_dir, "documents"), root, path="doc_id")
    found = text_index.related_documents(spark, root, tickets_of, path="doc_id")
    return found.select(F.col("ticket_id").alias("item_id"), "doc_id", "score")


@register
def document_sections(spark, sf_dir):
    """Documents split at lines that begin with `## `; every fourth line is made such a heading."""
    d = tables.table(spark, sf_dir, "documents")
    marked = F.array_join(
        F.transform(F.expr(tx.split_lines("text")), lambda line, k: F.when(k % 4 == 2, F.concat(F.lit("## "), line)).otherwise(line)),
        "\n",
    )
    return docs.sections(d.select("doc_id", marked.alias("text")), key="doc_id")


@register
def context_budget(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    packed = docs.packed(d, 6000, ["source"], ["doc_id"])
    return packed.select("source", "doc_id", "used", F.length("text").alias("kept"), F.md5("text").alias("text_md5"))


# --- evaluation --------------------------------------------------------------


def _labelled(spark, sf_dir) -> DataFrame:
    """Documents with a class by rule and a class by label, off-list classes included."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    rows = d.join(tables.table(spark, sf_dir, "labels"), "doc_id")
    names = F.array(*[F.lit(c) for c in ("defect", "ux_friction", "user_delight", "capability_gap", "safety_compliance")])
    return rows.select(
        "doc_id",
        F.get(names, (F.col("n_chars") % 5).cast("int")).alias("auto"),
        F.get(names, ((F.col("n_chars") + F.col("quality") + F.col("toxic")) % 5).cast("int")).alias("judged"),
        (F.col("quality") == 1).alias("is_real_issue"),
        F.when(F.col("toxic") == 1, "high").otherwise("low").alias("severity"),
    )


@register
def confusion(spark, sf_dir):
    return evaluate.confusion(_labelled(spark, sf_dir), "auto", "judged")


@register
def class_metrics(spark, sf_dir):
    return evaluate.class_metrics(_labelled(spark, sf_dir), "auto", "judged")


@register
def accuracy(spark, sf_dir):
    return evaluate.accuracy(_labelled(spark, sf_dir), "auto", "judged")


@register
def class_intervals(spark, sf_dir):
    """Figures per class with the place of their bootstrap interval: a proper one around the estimate."""
    found = intervals.class_intervals(_labelled(spark, sf_dir), "auto", "judged", "doc_id", replicates=200)
    inside = (F.col("low") <= F.col("estimate")) & (F.col("estimate") <= F.col("high"))
    return found.select("label", "metric", "n", F.round("estimate", 3).alias("estimate"), inside.alias("inside"))


@register
def validity(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumnRenamed("auto", "signal_class")
    return evaluate.validity(rows).withColumn("precision", F.round("precision", 6))


@register
def validity_severity(spark, sf_dir):
    return evaluate.validity_severity(_labelled(spark, sf_dir))


@register
def stratified_sample(spark, sf_dir):
    """A sample with every class; the draw order is an MD5 so that SQL can repeat it."""
    order = [F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))]
    return evaluate.stratified_sample(_labelled(spark, sf_dir), "auto", 40, order).select("doc_id", "auto")


@register
def random_sample(spark, sf_dir):
    order = [F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))]
    return evaluate.random_sample(_labelled(spark, sf_dir), 25, order).select("doc_id")


@register
def problem_clusters(spark, sf_dir):
    return evaluate.problem_clusters(_clusters(spark, sf_dir)).select("signature_id", "kind_v2_primary")


# --- workflows, schedules, latency -------------------------------------------


@register
def tool_ngrams(spark, sf_dir):
    counted = workflow.ngrams(_calls(spark, sf_dir))
    return counted.select("n", F.array_join("pattern", " > ").alias("pattern"), "count")


@register
def top_tool_ngrams(spark, sf_dir):
    best = workflow.top_ngrams(workflow.ngrams(_calls(spark, sf_dir)))
    return best.select("n", F.col("_rank").alias("place"), F.array_join("pattern", " > ").alias("pattern"), "count")


@register
def skill_candidates(spark, sf_dir):
    found = workflow.skill_candidates(workflow.ngrams(_calls(spark, sf_dir)))
    return found.withColumn("pattern", F.array_join("pattern", " > "))


@register
def adjacent_patterns(spark, sf_dir):
    matches = workflow.workflow_matches(_calls(spark, sf_dir))
    return workflow.workflow_examples(matches).select("pattern", "instances", "example", "session_id", "t", "tool", "next_tool")


def _patterns(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The calls, the patterns that a quarter of the sessions with calls follow, and where these end."""
    calls = _once(spark, sf_dir, "numbered_calls", lambda: _calls(spark, sf_dir))
    with_calls = calls.select("session_id").distinct().count()
    return calls, *patterns.gapped_patterns(calls, max(1, -(-with_calls // 4)))


@register
def gapped_patterns(spark, sf_dir):
    """Sequences of up to four tools, with gaps, that a quarter of the sessions follow, and which of them are closed."""
    _, found, _ = _patterns(spark, sf_dir)
    closed = patterns.closed_patterns(found).withColumn("closed", F.lit(True))
    told = found.join(closed, ["pattern", "support"], "left")
    return told.select(
        F.size("pattern").alias("n"), F.array_join("pattern", " > ").alias("pattern"), "support",
        F.coalesce("closed", F.lit(False)).alias("closed"),
    )


@register
def workflow_clusters(spark, sf_dir):
    """Every session with calls, under the most specific closed pattern that it follows."""
    calls, found, places = _patterns(spark, sf_dir)
    clusters = patterns.session_clusters(calls, patterns.closed_patterns(found), places)
    return clusters.withColumn("pattern", F.array_join("pattern", " > "))


@register
def tool_summaries(spark, sf_dir):
    """Tool calls inside message content, with a short text of their arguments."""
    t = tables.trace(spark, sf_dir).filter("role = 'toolCall'")
    line = F.expr(
        """to_json(named_struct('type', 'message', 'message', named_struct('content', array(
          named_struct('type', 'text', 'name', '', 'arguments', named_struct('command', '', 'path', '', 'query', '', 'action', '')),
          named_struct('type', 'toolCall', 'name', tool, 'arguments',
            named_struct('command', text, 'path', text, 'query', text, 'action', tool))))))"""
    )
    lines = t.select("session_id", "i", line.alias("value"))
    calls = workflow.tool_blocks(sessions.parse_events(lines))
    return calls.select("session_id", "i", "at", "tool", F.expr(workflow.tool_summary("tool", "args")).alias("summary"))


@register
def cron_gaps(spark, sf_dir):
    gaps = cron.with_gaps(cron.cron_events(_messages(spark, sf_dir)))
    return gaps.select("session_id", "idx", "role", "is_error", "preview", "content_length", F.round("gap_ms", 3).alias("gap_ms"))


@register
def gap_stats(spark, sf_dir):
    stats = cron.gap_stats(cron.with_gaps(cron.cron_events(_messages(spark, sf_dir))))
    return stats.withColumns({c: F.round(c, 3) for c in ("gap_min_ms", "gap_max_ms")})


@register
def cron_error_samples(spark, sf_dir):
    return cron.error_samples(cron.cron_events(_messages(spark, sf_dir)))


@register
def latency_stats(spark, sf_dir):
    stats = latency.latency_stats(_latencies(spark, sf_dir))
    return stats.withColumn("mean_ms", F.round("mean_ms", 6))


# Days of the trace that the second range of sketches spans.
_SKETCH_DAYS = ("2024-01-08", "2024-01-21")


@register
def latency_sketches(spark, sf_dir):
    """Quantiles from daily sketches, over all days and over some, and whether their rank is within one hundredth."""
    rows = _latencies(spark, sf_dir)
    store = new_path(spark, "sketches")
    written = latency.latency_sketches(rows)
    written.write.partitionBy("day").parquet(store)
    sketches = spark.read.schema(written.schema).parquet(store)
    first, last = _SKETCH_DAYS
    inside = rows.filter(F.to_date("start_ts").between(first, last))
    out = []
    for name, days, part in (("all", (None, None), rows), ("some", (first, last), inside)):
        found = stable(latency.sketch_quantiles(sketches, *days))
        told = latency.rank_errors(part, found).join(found.select("phase", F.col("n").alias("sketched")), "phase")
        out.append(told.select(F.lit(name).alias("days"), "phase", "point", "n", "sketched", (F.col("rank_error") <= 0.01).alias("near")))
    return out[0].unionByName(out[1])


@register
def last_latencies(spark, sf_dir):
    rows = _latencies(spark, sf_dir)
    kept = latency.last_samples(rows).groupBy("phase").agg(
        F.count("*").alias("kept"), F.min("call_id").alias("oldest"), F.round(F.sum("latency_ms"), 2).alias("total_ms")
    )
    return kept.join(latency.sample_counters(rows), "phase")


# --- model requests and answers ----------------------------------------------


@register
def chunk_requests(spark, sf_dir):
    asked = requests.chunk_requests(tables.trace(spark, sf_dir).withColumn("v", F.col("i")).drop("ts"), _bounds(spark, sf_dir))
    events_json = F.get_json_object("user", "$.events")
    return asked.select(
        "session_id",
        "chunk_idx",
        F.get_json_object("user", "$.chunk_id").alias("chunk_id"),
        F.json_array_length(events_json).alias("events"),
        F.get_json_object("user", "$.events[0].text").alias("first_text"),
    )


def _answers(spark, sf_dir) -> DataFrame:
    """Stand-in answers: an item on the first user view of each chunk, in various states of repair."""
    inside = chunks.chunk_views(_views(spark, sf_dir), _bounds(spark, sf_dir)).filter("role = 'user' AND text <> ''")
    first = first_per_key(inside, ["session_id", "chunk_idx"], [F.col("i")], 1)
    body = F.expr(
        """CASE WHEN pos % 7 = 0 THEN 'no idea'
        ELSE 'Here: {"items": ["oops", 7, null, [1], {"kind": 5, "summary": "no proof", "tags": "x"}, {"kind": "' || CASE WHEN pos % 5 = 0 THEN 'bogus' ELSE 'other' END
          || '", "summary": " seen: ' || text || ' ", "severity": "' || CASE WHEN pos % 3 = 0 THEN 'HIGH' ELSE 'odd' END
          || '", "confidence": ' || CASE WHEN pos % 2 = 0 THEN '0.8' ELSE '7' END
          || ', "tags": [" Cron ", ""], "evidence": [{"event_i": ' || CAST(i AS STRING)
          || ', "quote": "' || CASE WHEN pos % 11 = 0 THEN 'never said' ELSE text END || '"}]}]} done' END"""
    )
    return first.select("session_id", "chunk_idx", body.alias("answer"))


@register
def answered_items(spark, sf_dir):
    """Items read from model answers and validated against the views."""
    candidates = signals.answers_to_candidates(_answers(spark, sf_dir))
    return _flat_items(signals.validated(candidates, _views(spark, sf_dir), _bounds(spark, sf_dir)))


@register
def judged_classes(spark, sf_dir):
    """Clusters classified by a stand-in model that runs on the executors."""
    clusters = _clusters(spark, sf_dir)
    context = evidence.fuzzy_evidence(clusters, _items(spark, sf_dir))

    def complete(system: str, user: str) -> str:
        label = "defect" if "gateway" in user else "ux_friction"
        return f'```json\n{{"class": "{label}", "confidence": "high", "reasoning": "rule"}}\n```'

    answers = requests.ask(requests.classify_requests(clusters, context), complete)
    return requests.class_answers(answers).select("signature_id", "kind_v2_primary", "class", "confidence")


@register
def judged_validity(spark, sf_dir):
    clusters = evaluate.problem_clusters(_clusters(spark, sf_dir))
    context = evidence.fuzzy_evidence(clusters, _items(spark, sf_dir), max_chars=3000)

    def complete(system: str, user: str) -> str:
        if "timed out" in user:
            return '{"is_real_issue": true, "confidence": "high", "reasoning": "r", "severity": "medium"}'
        return "cannot tell"

    answers = requests.ask(requests.validity_requests(clusters, context), complete)
    return requests.validity_answers(answers).select("signature_id", "is_real_issue", "confidence", "severity")


@register
def stored_answers(spark, sf_dir):
    """Two runs over one answer store: the second asks only what the first did not."""
    clusters = stable(_clusters(spark, sf_dir))
    asked = requests.classify_requests(clusters, stable(evidence.fuzzy_evidence(clusters, _items(spark, sf_dir))))
    store = AnswerStore(spark, new_path(spark, "answers"))
    early = clusters.filter("length(canonical_summary) % 2 = 0").select("signature_id")
    store.ask(asked.join(early, "signature_id"), lambda system, user: "first run")
    return store.ask(asked, lambda system, user: "second run").select("signature_id", "answer", "error")


# --- streams -----------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = tables.table(spark, sf_dir, "events").schema
    return tables.trace_columns(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


@register
def stream_counts(spark, sf_dir):
    out, mark = new_path(spark, "counts"), new_path(spark, "counts-progress")
    counts = live.daily_counts(live.signal_stream(_event_stream(spark, sf_dir)))
    live.run_available(counts, mark, live.parquet_writer(out), "update")
    schema = "window_start timestamp, kind string, n bigint, batch_id bigint"
    rows = live.latest(spark, out, ["window_start", "kind"], schema)
    return rows.select(F.unix_micros("window_start").alias("window_start"), "kind", "n")


# Hours between two cron posts of a session that are let through; the trace has few within 30 seconds.
_QUIET_HOURS = 6


@register
def cron_throttled(spark, sf_dir):
    """Cron rows that a rate limit per session lets through."""
    rows = tables.trace(spark, sf_dir).filter(F.contains("text", F.lit("Cron"))).select("session_id", "ts", "pos")
    told = throttle.throttled(rows, "pos", _QUIET_HOURS * 3_600_000)
    return told.select("session_id", "pos", "kept")


@register
def stream_throttled(spark, sf_dir):
    """The same rate limit over a stream of time slices, which goes on from the last row that was let through."""
    source, out, mark = (new_path(spark, name) for name in ("posts", "throttled", "throttled-progress"))
    rows = tables.trace(spark, sf_dir).filter(F.contains("text", F.lit("Cron"))).select("session_id", "ts", "pos")
    day = F.dayofmonth("ts")
    for low, high in ((0, 9), (9, 20), (20, 32)):
        rows.filter((day >= low) & (day < high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema("session_id string, ts timestamp, pos bigint").parquet(source)
        live.run_available(stream, mark, throttle.throttle_writer(out, "pos", _QUIET_HOURS * 3_600_000), "append")
    return spark.read.parquet(f"{out}/rows").select("session_id", "pos", "kept")


# The trace reaches the gap stream in slices of time; every third row comes one slice later than it should.
_SLICES = 3
_SLICE_DAYS = 10


@register
def stream_gaps(spark, sf_dir):
    """Gaps between cron rows that come slice by slice and out of order."""
    source, out, mark = (new_path(spark, name) for name in ("cron", "gaps", "gaps-progress"))
    rows = tables.trace(spark, sf_dir).filter(F.contains("text", F.lit("Cron"))).select("session_id", "ts", "pos")
    start = rows.agg(F.min("ts")).first()[0]
    due = F.floor(F.timestamp_diff("DAY", F.lit(start), "ts") / _SLICE_DAYS) + (F.col("pos") % 3 == 0).cast("int")
    slices = rows.withColumn("due", F.least(due, F.lit(_SLICES - 1)))
    for k in range(_SLICES):
        slices.filter(F.col("due") == k).select("session_id", "ts").write.mode("append").parquet(source)
        stream = spark.readStream.schema("session_id string, ts timestamp").parquet(source)
        gaps.release_available(stream, out, mark, f"{2 * _SLICE_DAYS} days")
    return gaps.settled(spark, out, mark).groupBy("session_id").agg(
        F.count("*").alias("n"), F.round(F.sum("gap_ms"), 3).alias("gap_sum"), F.count_if("rapid").alias("rapid")
    )


@register
def stream_last_latencies(spark, sf_dir):
    """The newest latencies per phase, which come in files of any order and are kept on a stream."""
    source, mark = new_path(spark, "latencies"), new_path(spark, "latencies-progress")
    rows = _latencies(spark, sf_dir).select("phase", "start_ts", "call_id", "latency_ms", "success")
    due = F.pmod(F.xxhash64("call_id"), F.lit(_SLICES))
    for k in range(_SLICES):
        rows.filter(due == k).write.mode("append").parquet(source)
        samples.keep_available(spark.readStream.schema(rows.schema).parquet(source), mark)
    kept = samples.last_samples(spark, mark).groupBy("phase").agg(
        F.count("*").alias("kept"), F.min("call_id").alias("oldest"), F.round(F.sum("latency_ms"), 2).alias("total_ms")
    )
    return kept.join(samples.counters(spark, mark), "phase")


@register
def stream_distinct(spark, sf_dir):
    out, mark = new_path(spark, "distinct"), new_path(spark, "distinct-progress")
    hits = live.signal_stream(_event_stream(spark, sf_dir))
    items = hits.withColumn("item_id", F.expr(signals.item_id("session_id", "kind", "summary", "array(left(text, 200))")))
    live.run_available(
        live.distinct_items(items.select("item_id", "kind", "ts"), "400 days"), mark, live.parquet_writer(out), "append"
    )
    return spark.read.parquet(out).select("item_id", "kind")


# Files that the numbered trace is dealt into for a stream, in no order, and how many a batch reads.
_STREAM_FILES = 6
_BATCH_FILES = 2


def _mined_stream(spark, sf_dir) -> str:
    """The folder of a mining stream over the numbered trace in several unordered files."""

    def mine() -> DataFrame:
        source, out, mark = (new_path(spark, name) for name in ("views", "mined", "mined-progress"))
        views = _views(spark, sf_dir).repartition(_STREAM_FILES, "pos")
        views.write.option("maxRecordsPerFile", 0).parquet(source)
        stream = spark.readStream.schema(views.schema).option("maxFilesPerTrigger", _BATCH_FILES).parquet(source)
        mining.mine_available(stream, out, mark)
        return spark.createDataFrame([(out,)], "path string")

    return _once(spark, sf_dir, "mined-stream", mine).first()["path"]


@register
def stream_chunks(spark, sf_dir):
    """Chunks of sessions whose views come unordered in several batches."""
    return mining.mined_chunks(spark, _mined_stream(spark, sf_dir)).select("session_id", "chunk_idx", "start_v", "end_v")


@register
def stream_mined_items(spark, sf_dir):
    """Items mined from the same stream, chunk by chunk."""
    return _flat_items(mining.mined_items(spark, _mined_stream(spark, sf_dir)))


@register
def stream_tickets(spark, sf_dir):
    """Ticket changes that a stream of clusters asks for."""
    source, out, mark = (new_path(spark, name) for name in ("cluster-rows", "tickets", "tickets-progress"))
    clusters = _clusters(spark, sf_dir)
    clusters.write.parquet(source)
    stream = spark.readStream.schema(clusters.schema).parquet(source)
    write = live.ticket_writer(lambda: _tickets(spark, sf_dir), out, max_tier=3, max_create=10)
    live.run_available(stream, mark, write, "append")
    updates = spark.read.schema("fingerprint_id string").parquet(f"{out}/updates")
    creates = spark.read.schema("fingerprint_id string").parquet(f"{out}/creates")
    return updates.select(F.lit("update").alias("change"), "fingerprint_id").unionByName(
        creates.select(F.lit("create").alias("change"), "fingerprint_id")
    )


# Session files are small, so a batch is measured by their bytes and not by their number.
_SESSION_BYTES = 256 << 20


def _streamed_sessions(spark, folder: str) -> DataFrame:
    out, mark = new_path(spark, "views"), new_path(spark, "views-progress")
    with sessions.listing_in_parts(spark):
        views = live.session_stream(spark, folder, name_glob="*.txt", bytes_per_trigger=_SESSION_BYTES)
        live.run_available(views, mark, live.parquet_writer(out), "append")
    batch = sessions.read_lines(spark, folder, name_glob="*.txt").select("rel_path").distinct()
    batch = batch.withColumn("session_id", F.expr(tx.session_key("rel_path")))
    streamed = spark.read.parquet(out).groupBy("session_id").agg(F.count("*").alias("views"))
    named = F.regexp_extract("rel_path", _SESSION, 1)
    return streamed.join(batch, "session_id").groupBy(named.alias("session_id")).agg(F.sum("views").alias("views"))


@register
def stream_sessions(spark, sf_dir):
    """Session files read as a stream: the same sessions and events as in batch.

    The driver lists all files of a stream, so each folder has a stream of its own.
    """
    kept = new_path(spark, "session-views")
    spark.createDataFrame([], "session_id string, views bigint").write.parquet(kept)
    for folder in _session_folders(spark, sf_dir):
        _streamed_sessions(spark, folder).write.mode("append").parquet(kept)
        # Python's references to the plans of a folder, and so to its listing, are cycles.
        gc.collect()
    # Files of a long session may lie in several folders.
    return spark.read.parquet(kept).groupBy("session_id").agg(F.sum("views").alias("views"))


def forget() -> None:
    """Drop the tables kept between queries, so that the next query builds its own."""
    _shared.clear()
    tables.forget()
