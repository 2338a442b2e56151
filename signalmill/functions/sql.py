"""Small helpers to put Spark SQL expressions together as text.

The functions of this package take and return expression text, for `F.expr` or
`selectExpr`. A rule of a few hundred terms then reaches Spark as one string,
where building it from Column objects would take as many round trips.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

Sql = str

_names = itertools.count()


def text(value: str) -> Sql:
    """A string literal."""
    body = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{body}'"


def pattern(value: str) -> Sql:
    """A raw string literal, for regular expressions."""
    return f"r'{value}'"


def texts(values: Iterable[str]) -> Sql:
    return ", ".join(text(v) for v in values)


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate `value` once and use it several times in `body`.

    Two branches of a CASE must not differ only in an outer variable that is
    used inside an inner `let`: the optimizer takes such branches for equal.
    """
    name = f"x{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def each(values: Sql, body: Callable[[Sql], Sql]) -> Sql:
    name = f"x{next(_names)}"
    return f"transform({values}, {name} -> {body(name)})"


def keep(values: Sql, test: Callable[[Sql], Sql]) -> Sql:
    name = f"x{next(_names)}"
    return f"filter({values}, {name} -> {test(name)})"


def any_of(values: Sql, test: Callable[[Sql], Sql]) -> Sql:
    name = f"x{next(_names)}"
    return f"exists({values}, {name} -> {test(name)})"


def matches(value: Sql, regex: str) -> Sql:
    return f"rlike({value}, {pattern(regex)})"


def contains_any(value: Sql, terms: Iterable[str]) -> Sql:
    return "(" + " OR ".join(f"contains({value}, {text(t)})" for t in terms) + ")"


def filled(value: Sql) -> Sql:
    """The text, or NULL when it is empty."""
    return f"nullif({value}, '')"


def no_texts() -> Sql:
    return "CAST(array() AS ARRAY<STRING>)"


def not_empty(value: Sql) -> Sql:
    return f"{value} <> ''"
