"""Looking into a session: windows, search, span summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import ragged
from signalmill.functions.sql import Sql, each, filled, let
from signalmill.functions.text import strip
from signalmill.operators.events import in_event, rows_of
from signalmill.operators.ordered import first_per_key

MAX_HITS = 30
MAX_FIELD = 1200


def window(events: DataFrame, start: int, end: int, fields: Sequence[str] | None = None) -> DataFrame:
    """Events `start <= i < end` of each session, optionally only some top-level fields as text."""
    span = events.filter((F.col("i") >= max(0, start)) & (F.col("i") < end))
    if fields is None:
        return span
    return span.select("session_id", "i", "line_no", *[_field(name).alias(name) for name in fields])


def compact_window(
    events: DataFrame,
    start: int,
    end: int,
    fields: Sequence[str],
    max_events: int | None = None,
    max_field: int = MAX_FIELD,
) -> DataFrame:
    """`window`, on request of at most `max_events` events, with long strings cut."""
    span = window(events, start, _stop(start, end, max_events), fields)

    def short(name: str) -> Column:
        text = F.col(f"`{name}`")
        cut = F.concat(F.substring(text, 1, max_field), F.lit("…"))
        return F.when(F.length(text) > max_field, cut).otherwise(text).alias(name)

    return span.select("session_id", "i", "line_no", *[short(name) for name in fields])


def _stop(start: int, end: int, max_events: int | None) -> int:
    return end if max_events is None else min(end, start + max_events)


def _field(name: str) -> Column:
    return F.expr(ragged.plain_text(ragged.child("event", f"$.{name}")))


def search(
    events: DataFrame,
    query: str,
    fields: Sequence[str] | None = None,
    limit: int = 50,
    start: int = 0,
    regex: bool = False,
    max_chars: int | None = None,
) -> DataFrame:
    """The first `limit` events per session, from `start`, that hold `query`.

    A plain query is matched without regard to case, a regex as it is written.
    Without `fields`, the JSON is searched, on request only its first `max_chars` characters.
    """
    if fields:
        hay = F.concat_ws("\n", *[F.coalesce(_field(name), F.lit("")) for name in fields])
    else:
        # A line that did not parse is searched by its raw text.
        bad = F.to_json(F.struct(F.col("parse_error").alias("_parse_error"), F.col("raw").alias("_raw")))
        hay = F.coalesce(F.to_json("event"), bad)
        hay = hay if max_chars is None else F.substring(hay, 1, max_chars)
    hit = hay.rlike(query) if regex else F.contains(F.lower(hay), F.lit(query.lower()))
    found = events.filter(F.col("i") >= max(0, start)).filter(hit)
    return first_per_key(found, ["session_id"], [F.col("i")], limit).drop("_rank")


def _content_preview(message: Sql) -> Sql:
    """Text of a message: its string parts, joined, or its string content."""

    def part(b: Sql) -> Sql:
        own = f"IF({ragged.type_of(b)} = 'STRING', {ragged.get(b, '$', 'string')}, NULL)"
        return f"coalesce({ragged.text_at(b, '$.text')}, {own})"

    items = ragged.get(ragged.child(message, "$.content"), "$", "array<variant>")
    listed = let(
        f"array_compact({each(items, part)})", lambda t: f"IF(size({t}) > 0, array_join({t}, '\\n'), NULL)"
    )
    return f"coalesce({listed}, {ragged.filled_text_at(message, '$.content')})"


def search_hits(
    events: DataFrame,
    query: str,
    fields: Sequence[str] | None = None,
    limit: int = MAX_HITS,
    start: int = 0,
    regex: bool = False,
    max_keys: int = 40,
    max_preview: int = 500,
) -> DataFrame:
    """Condensed search result: position, the first sorted keys and the start of the text."""
    hits = search(events, query, fields, limit, start, regex)
    return rows_of(hits, ["session_id", "i", "line_no"], _hit(max_keys, max_preview))


def _hit(max_keys: int = 40, max_preview: int = 500) -> Sql:
    """struct<keys, preview> of an event."""

    def shown(e: Sql, m: Sql, d: Sql) -> Sql:
        preview = (
            f"coalesce({_content_preview(m)}, {ragged.filled_text_at(m, '$.text')}, "
            f"{ragged.first_filled(e, ('content', 'text'))}, to_json({e}))"
        )
        return f"named_struct('keys', slice({ragged.keys_of(e)}, 1, {max_keys}), 'preview', left({preview}, {max_preview}))"

    return in_event(shown)


def span_summary(
    events: DataFrame, start: int, end: int, max_events: int | None = None, examples: int = 6
) -> DataFrame:
    """Per session: events, tool and error events in the span, and the first short examples."""
    span = window(events, start, _stop(start, end, max_events))
    rows = rows_of(span, ["session_id", "i"], _example())
    return _summed(rows, start, end, examples)


def _example() -> Sql:
    """struct<tool, error, example> of an event."""

    def shown(e: Sql, m: Sql, d: Sql) -> Sql:
        def truthy(key: str) -> Sql:
            return f"{ragged.truthy_text(ragged.child(e, f'$.{key}'))} IS NOT NULL"

        said = (
            f"coalesce({_content_preview(m)}, {ragged.filled_text_at(d, '$.error')}, "
            f"{ragged.first_filled(e, ('content', 'message'))})"
        )
        example = f"left(replace({strip(said)}, '\\n', ' '), 160)"
        return (
            f"named_struct('tool', IF({truthy('tool')} OR {truthy('tool_name')}, 1, 0), "
            f"'error', IF({truthy('error')}, 1, 0), 'example', {filled(example)})"
        )

    return in_event(shown)


def _summed(rows: DataFrame, start: int, end: int, examples: int) -> DataFrame:
    first = first_per_key(rows.filter("example IS NOT NULL"), ["session_id"], [F.col("i")], examples)
    picked = first.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("i", "example"))).alias("picked"))
    counted = rows.groupBy("session_id").agg(
        F.count("*").alias("events"), F.sum("tool").alias("tool_calls"), F.sum("error").alias("errors")
    )
    return (
        counted.join(picked, "session_id", "left")
        .withColumn(
            "summary",
            F.concat(
                F.format_string(
                    f"Span [{start},{end}) events=%d tool_calls=%d errors=%d\n",
                    "events",
                    "tool_calls",
                    "errors",
                ),
                F.lit("Examples:\n- "),
                F.coalesce(F.array_join("picked.example", "\n- "), F.lit("")),
            ),
        )
        .drop("picked")
    )


def register_sql(events: DataFrame, name: str = "trace") -> None:
    """The helpers as SQL: the view `{name}_events` and the table functions

    `{name}_window(first, stop)`, `{name}_compact(first, stop, max_chars)`, `{name}_search(query, hits)`,
    `{name}_search_hits(query, hits)` and `{name}_span(first, stop)`, which counts tool and error events.
    """
    spark = events.sparkSession
    events.select("session_id", "i", "line_no", "event", "parse_error", "raw").createOrReplaceTempView(f"{name}_events")
    found = "coalesce(to_json(event), to_json(named_struct('_parse_error', parse_error, '_raw', raw)))"

    def function(title: str, arguments: str, columns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{title}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")

    def hits(title: str, picked: str) -> str:
        return f"""SELECT session_id, i, line_no, {picked} FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) AS _place FROM {name}_events
          WHERE contains(lower({found}), lower({name}_{title}.query))) WHERE _place <= {name}_{title}.hits"""

    def span(title: str) -> str:
        return f"FROM {name}_events WHERE i >= greatest(0, {name}_{title}.first) AND i < {name}_{title}.stop"

    place = "session_id STRING, i BIGINT, line_no BIGINT"
    function("window", "first BIGINT, stop BIGINT", f"{place}, event VARIANT", f"SELECT session_id, i, line_no, event {span('window')}")
    cut = f"IF(length({found}) > {name}_compact.max_chars, concat(left({found}, {name}_compact.max_chars), '…'), {found})"
    function(
        "compact", "first BIGINT, stop BIGINT, max_chars INT", f"{place}, json STRING",
        f"SELECT session_id, i, line_no, {cut} {span('compact')}",
    )
    function("search", "query STRING, hits INT", f"{place}, event VARIANT", hits("search", "event"))
    shown = f"SELECT session_id, i, line_no, h.keys, h.preview FROM (SELECT session_id, i, line_no, {_hit()} AS h FROM ({hits('search_hits', 'event')}))"
    function("search_hits", "query STRING, hits INT", f"{place}, keys ARRAY<STRING>, preview STRING", f"{shown} WHERE h IS NOT NULL")
    counted = f"""SELECT session_id, count(*), sum(h.tool), sum(h.error) FROM (
      SELECT session_id, {_example()} AS h {span('span')}) WHERE h IS NOT NULL GROUP BY session_id"""
    function(
        "span", "first BIGINT, stop BIGINT", "session_id STRING, events BIGINT, tool_calls BIGINT, errors BIGINT", counted
    )
