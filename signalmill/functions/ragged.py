"""Expressions over ragged JSON, held as VARIANT.

A path read with a type converts numbers to strings, so each reader first checks
the type that the value really has. Arguments named `value` are used more than
once: pass a column or a `let` variable, or the text multiplies.
"""

from __future__ import annotations

from collections.abc import Iterable

from signalmill.functions.sql import Sql, each, filled, let


def get(value: Sql, path: str, kind: str) -> Sql:
    return f"try_variant_get({value}, '{path}', '{kind}')"


def child(value: Sql, path: str) -> Sql:
    return get(value, path, "variant")


def type_of(value: Sql) -> Sql:
    """Type name as `schema_of_variant` spells it; a missing value gives NULL."""
    return f"schema_of_variant({value})"


def is_object(value: Sql) -> Sql:
    return f"coalesce(startswith({type_of(value)}, 'OBJECT'), false)"


def text_at(value: Sql, path: str) -> Sql:
    """The string at `path`; NULL when missing or of another type."""
    return f"IF({type_of(child(value, path))} = 'STRING', {get(value, path, 'string')}, NULL)"


def filled_text_at(value: Sql, path: str) -> Sql:
    return filled(text_at(value, path))


def object_at(value: Sql, path: str) -> Sql:
    """The object at `path`, else NULL."""
    return let(child(value, path), lambda v: f"IF({is_object(v)}, {v}, NULL)")


def first_filled(value: Sql, keys: Iterable[str]) -> Sql:
    return f"coalesce({', '.join(filled_text_at(value, f'$.{key}') for key in keys)})"


def integer_at(value: Sql, path: str) -> Sql:
    """The integer at `path`. A boolean counts as 0 or 1, as in the logs' own language."""
    kind = type_of(child(value, path))
    return (
        f"CASE {kind} WHEN 'BIGINT' THEN {get(value, path, 'bigint')} "
        f"WHEN 'BOOLEAN' THEN CAST({get(value, path, 'boolean')} AS BIGINT) END"
    )


def present(value: Sql, path: str) -> Sql:
    """Is there a value at `path` that is not JSON null?"""
    at = child(value, path)
    return f"({at} IS NOT NULL AND NOT is_variant_null({at}))"


def plain_text(value: Sql) -> Sql:
    """A string as is, anything else as compact JSON; JSON null gives NULL."""
    return let(
        value,
        lambda v: f"CASE WHEN is_variant_null({v}) THEN NULL WHEN {type_of(v)} = 'STRING' "
        f"THEN {get(v, '$', 'string')} ELSE to_json({v}) END",
    )


def truthy_text(value: Sql) -> Sql:
    """`plain_text` of a value that is not empty, zero or false; else NULL."""
    return let(plain_text(value), lambda t: f"IF({t} IN ('', '0', '0.0', 'false', '[]', '{{}}'), NULL, {t})")


def _list_part(item: Sql) -> Sql:
    """Text of one entry of a content list; empty entries give NULL."""
    other = f"coalesce({filled_text_at(item, '$.text')}, left(to_json({item}), 2000))"
    return filled(
        f"CASE {type_of(item)} WHEN 'STRING' THEN {get(item, '$', 'string')} WHEN 'VOID' THEN 'None' ELSE {other} END"
    )


def content_text(value: Sql) -> Sql:
    """Readable text of a content field: a string, a list of parts or an object."""

    def by_kind(v: Sql) -> Sql:
        kind = type_of(v)
        parts = each(get(v, "$", "array<variant>"), _list_part)
        obj = f"coalesce({first_filled(v, ('text', 'error', 'stderr', 'stdout', 'output'))}, left(to_json({v}), 4000))"
        return f"""CASE WHEN {kind} = 'STRING' THEN {get(v, "$", "string")}
          WHEN startswith({kind}, 'ARRAY') THEN array_join(array_compact({parts}), '\\n')
          WHEN startswith({kind}, 'OBJECT') THEN {obj}
          WHEN {kind} <> 'VOID' THEN left(to_json({v}), 4000) END"""

    return f"coalesce({let(value, by_kind)}, '')"


def keys_of(value: Sql) -> Sql:
    """Sorted top-level keys of an object."""
    return f"array_sort(json_object_keys(to_json({value})))"
