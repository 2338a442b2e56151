"""Event normalisation and the rule-based detectors over raw events.

Input: session_id, line_no, i, event (VARIANT), parse_error, raw. Everything
here is row-local, so it runs inside the scan stage, before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.functions import fixed, ragged
from signalmill.functions.sql import Sql, filled, let, matches, text, texts
from signalmill.functions.text import digest, strip
from signalmill.operators.ordered import BLOCK, first_per_key, renumbered

MAX_TEXT = 800
_ERROR_KEYS = ("error_code", "errorCode", "code")


def _joined(parts: list[Sql]) -> Sql:
    """Non-empty parts, one per line."""
    return f"concat_ws('\\n', {', '.join(filled(p) for p in parts)})"


def in_event(body: Callable[[Sql, Sql, Sql], Sql], event: Sql = "event") -> Sql:
    """`body(event, message, details)`, each evaluated once; NULL unless they are objects."""
    return let(
        event,
        lambda e: let(
            ragged.object_at(e, "$.message"),
            lambda m: let(ragged.object_at(m, "$.details"), lambda d: body(e, m, d)),
        ),
    )


def rows_of(events: DataFrame, keep: Sequence[str], row: Sql) -> DataFrame:
    """One output row per non-NULL struct. The generator also keeps the optimizer
    from copying these large expressions into every filter above them."""
    return events.select(*keep, F.expr(f"inline(array_compact(array({row})))"))


def _has_message(message: Sql) -> Sql:
    return f"({message} IS NOT NULL AND to_json({message}) <> '{{}}')"


def is_metadata(event: Sql, message: Sql) -> Sql:
    kind = ragged.text_at(event, "$.type")
    return f"(NOT {_has_message(message)} AND coalesce({kind} IN ({texts(fixed.METADATA_TYPES)}), false))"


def role_of(event: Sql, message: Sql, parse_error: Sql) -> Sql:
    named = f"coalesce({ragged.text_at(message, '$.role')}, {ragged.text_at(event, '$.role')}, 'other')"
    return f"IF({parse_error} IS NOT NULL, 'parse_error', {named})"


def tool_of(event: Sql, message: Sql) -> Sql:
    flat = ragged.first_filled(event, ("tool", "tool_name", "toolName", "name"))
    return f"coalesce({ragged.text_at(message, '$.toolName')}, {flat})"


def status_of(event: Sql, details: Sql) -> Sql:
    return f"coalesce({ragged.text_at(details, '$.status')}, {ragged.text_at(event, '$.status')})"


def error_code_of(event: Sql, details: Sql) -> Sql:
    inner, outer = ragged.integer_at(details, "$.exitCode"), ragged.integer_at(event, "$.exitCode")
    exit_code = f"IF({ragged.present(details, '$.exitCode')}, {inner}, {outer})"
    spelled = let(exit_code, lambda code: f"IF({code} <> 0, concat('EXIT_', {code}), NULL)")
    return f"coalesce({ragged.first_filled(details, _ERROR_KEYS)}, {ragged.first_filled(event, _ERROR_KEYS)}, {spelled})"


def text_of(event: Sql, message: Sql, details: Sql, role: Sql, tool: Sql) -> Sql:
    """struct<text, shape>: the text of an event, put together by role, before the digest."""

    def shaped(body: Sql, shape: str) -> Sql:
        return f"named_struct('text', {body}, 'shape', {text(shape)})"

    def by_role(content: Sql) -> Sql:
        result = _joined(
            [
                f"concat('tool=', {filled(tool)})",
                f"concat('status=', {ragged.text_at(details, '$.status')})",
                f"concat('exitCode=', {ragged.integer_at(details, '$.exitCode')})",
                f"concat('error=', {ragged.truthy_text(ragged.child(details, '$.error'))})",
                *[ragged.text_at(details, f"$.{k}") for k in ("stderr", "stdout", "aggregated")],
                content,
            ]
        )
        call = _joined([ragged.content_text(ragged.child(message, "$.input")), content])
        return f"""CASE {role} WHEN 'toolResult' THEN {shaped(result, "message.details+content")}
          WHEN 'toolCall' THEN {shaped(call, "message.input")}
          ELSE {shaped(content, "message.content")} END"""

    top = _joined([ragged.text_at(event, f"$.{k}") for k in ("content", "text", "error", "stderr", "stdout")])
    nested = let(ragged.content_text(ragged.child(message, "$.content")), by_role)
    return f"IF({_has_message(message)}, {nested}, {shaped(top, 'event')})"


def event_view(max_text: int = MAX_TEXT, redactor: Callable[[Sql], Sql] | None = None) -> Sql:
    """The normalised event as a struct, NULL for metadata and empty events.

    Reads the columns event and parse_error.
    """
    clean = redactor or (lambda body: body)

    def view(e: Sql, m: Sql, d: Sql) -> Sql:
        def with_body(role: Sql, tool: Sql) -> Sql:
            bad = "named_struct('text', parse_error, 'shape', '_parse_error')"
            body = f"IF(parse_error IS NOT NULL, {bad}, {text_of(e, m, d, role, tool)})"
            return let(
                body,
                lambda b: let(digest(clean(strip(f"{b}.text")), max_text), lambda s: finished(role, tool, b, s)),
            )

        def finished(role: Sql, tool: Sql, body: Sql, short: Sql) -> Sql:
            row = f"""named_struct('ts', {ragged.text_at(e, "$.timestamp")}, 'role', {role}, 'tool', {tool},
              'status', {status_of(e, d)}, 'error_code', {error_code_of(e, d)},
              'text', {short}.text, 'text_truncated', {short}.cut, 'raw_shape', {body}.shape)"""
            return f"IF({short}.text <> '' OR {role} <> 'other', {row}, NULL)"

        shown = let(role_of(e, m, "parse_error"), lambda role: let(tool_of(e, m), lambda tool: with_body(role, tool)))
        return f"IF({is_metadata(e, m)}, NULL, {shown})"

    return in_event(view)


def event_views(
    events: DataFrame, max_text: int = MAX_TEXT, redactor: Callable[[Sql], Sql] | None = None
) -> DataFrame:
    """Normalised events: session_id, i, ts, role, tool, status, error_code, text, flags.

    `redactor` is an optional expression builder applied before the digest, such as `redact`.
    """
    keep = [c for c in ("session_id", "line_no", "i", "pos") if c in events.columns]
    return rows_of(events, keep, event_view(max_text, redactor))


def numbered_views(views: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add `v`: the dense position of a view in its session, which chunks are cut by."""
    return renumbered(views, ["session_id"], "i", "v", block)


def tool_calls(events: DataFrame) -> DataFrame:
    """One row per event that names a tool, from the nested or the older flat shape."""

    def call(e: Sql, m: Sql, d: Sql) -> Sql:
        def top(key: str) -> Sql:
            return ragged.child(e, f"$.{key}")

        def with_name(nested: Sql, name: Sql) -> Sql:
            own = f"IF({nested}, {d}, NULL)"
            # A truthy `input` hides `arguments`.
            flat = f"IF({ragged.truthy_text(top('input'))} IS NOT NULL, {top('input')}, {top('arguments')})"
            given = f"IF({ragged.present(m, '$.input')}, {ragged.child(m, '$.input')}, {flat})"
            content = f"IF({ragged.present(m, '$.content')}, {ragged.child(m, '$.content')}, {top('content')})"

            def nested_first(key: str) -> Sql:
                inner = ragged.child(own, f"$.{key}")
                return ragged.plain_text(f"coalesce({inner}, {top(key)})")

            error = f"coalesce({ragged.truthy_text(ragged.child(own, '$.error'))}, {ragged.truthy_text(top('error'))})"
            action = let(
                given, lambda g: f"IF({ragged.is_object(g)}, {ragged.plain_text(ragged.child(g, '$.action'))}, NULL)"
            )
            preview = filled(f"left({strip(ragged.content_text(content))}, 300)")
            return f"""IF({name} IS NULL, NULL, named_struct('tool_name', {name},
              'tool_call_id', IF({nested}, {ragged.filled_text_at(m, "$.toolCallId")}, NULL), 'action', {action},
              'status', {nested_first("status")}, 'exit_code', {nested_first("exitCode")},
              'error', left({error}, 2000), 'preview', {preview}))"""

        # A truthy `tool` of another type hides `tool_name`.
        flat_name = (
            f"IF({ragged.truthy_text(top('tool'))} IS NOT NULL, {ragged.filled_text_at(e, '$.tool')}, "
            f"{ragged.filled_text_at(e, '$.tool_name')})"
        )
        flat_type = f"coalesce({ragged.text_at(e, '$.type')} IN ('tool_call', 'tool'), false)"
        nested = f"coalesce({ragged.text_at(m, '$.role')} = 'toolResult', false)"

        def named(is_nested: Sql) -> Sql:
            return (
                f"coalesce(IF({is_nested}, {ragged.filled_text_at(m, '$.toolName')}, NULL), {flat_name}, "
                f"IF({flat_type}, {ragged.truthy_text(top('name'))}, NULL))"
            )

        return let(nested, lambda n: let(named(n), lambda name: with_name(n, name)))

    return rows_of(events, ["session_id", "i", "line_no"], in_event(call))


def failures(events: DataFrame, limit: int | None = 200) -> DataFrame:
    """Failures in order of certainty: bad line, failed tool, error field, failure words.

    `limit` keeps the first so many per session; None keeps all.
    """

    def found(kind: str, detail: Sql, tool: Sql = "NULL", status: Sql = "NULL", exit_code: Sql = "NULL") -> Sql:
        return (
            f"named_struct('kind', {text(kind)}, 'detail', left({detail}, 2000), 'tool_name', CAST({tool} AS STRING), "
            f"'status', CAST({status} AS STRING), 'exit_code', CAST({exit_code} AS BIGINT))"
        )

    def failure(e: Sql, m: Sql, d: Sql) -> Sql:
        def decide(exit_code: Sql, error: Sql, flat_error: Sql) -> Sql:
            nested = f"coalesce({ragged.text_at(m, '$.role')} = 'toolResult', false)"
            failed = (
                f"(coalesce({ragged.text_at(d, '$.status')} = 'error', false) OR coalesce({exit_code} <> 0, false) "
                f"OR {error} IS NOT NULL)"
            )
            detail = f"coalesce({error}, {ragged.content_text(ragged.child(m, '$.content'))})"
            status = ragged.plain_text(ragged.child(d, "$.status"))
            places = [ragged.child(e, f"$.{k}") for k in ("content", "text", "output", "stderr", "stdout")]
            places.append(ragged.child(m, "$.content"))
            places += [ragged.child(d, f"$.{k}") for k in ("aggregated", "stderr", "stdout", "error")]
            words = let(
                _joined([strip(ragged.content_text(p)) for p in places]),
                lambda hay: f"IF({matches(hay, fixed.FAILURE[0])} OR {matches(hay, fixed.FAILURE[1])}, "
                f"{found('pattern', hay)}, NULL)",
            )
            return f"""CASE WHEN parse_error IS NOT NULL THEN {found("parse_error", "parse_error")}
              WHEN {nested} AND {failed}
                THEN {found("tool_error", detail, ragged.text_at(m, "$.toolName"), status, exit_code)}
              WHEN {flat_error} IS NOT NULL THEN {found("error_field", flat_error)}
              ELSE {words} END"""

        def truthy(owner: Sql) -> Sql:
            return ragged.truthy_text(ragged.child(owner, "$.error"))

        return let(
            ragged.integer_at(d, "$.exitCode"),
            lambda code: let(truthy(d), lambda error: let(truthy(e), lambda flat: decide(code, error, flat))),
        )

    rows = rows_of(events, ["session_id", "i", "line_no"], in_event(failure))
    if limit is None:
        return rows
    return first_per_key(rows, ["session_id"], [F.col("i")], limit).drop("_rank")
