"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regex is turned into a Boolean trigram query: a match is not
possible unless all trigrams of at least one of its sets occur in the text. The
index holds postings (trigram, document) for the trigrams that the queries
name, over the lower-cased texts. Postings are intersected per set; documents
that have a whole set are candidates of the rule and are verified with the
regex. A rule without mandatory trigrams scans every text.

Offsets come from the pieces between the matches: the text is split by the
regex, and the lengths of pieces and matches add up to the positions.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.functions.sql import each, keep, let, pattern, text as literal

# Alternatives that a query follows before it gives up on a stretch.
ALTERNATIVES = 24
# Positions are summed in blocks of so many matches.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """`group` 1 is the whole match, `group` 2 the part that needs `least` characters."""

    kind: str
    regex: str
    least: int = 0
    base: bool = False


# Kinds, patterns and least lengths of the contract, then added kinds.
RULES = [
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)""",
        12,
        True,
    ),
    # A longest run that starts with AKIA and is too short holds no later one that is long enough.
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, True),
    # The same holds for runs of hexadecimal digits.
    Rule("hex", r"[0-9a-f]{16,}", 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]

Query = frozenset[frozenset[str]]
# A query that every text passes.
ANY: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _either(a: Query, b: Query) -> Query:
    return _least(a | b)


def _least(query: Query) -> Query:
    """Without sets that contain another set of the query."""
    return frozenset(x for x in query if not any(y < x for y in query))


def _of_strings(strings: set[str]) -> Query:
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return _least(frozenset(sets)) if sets else ANY


def trigram_query(regex: str) -> Query:
    """The sets of lower-case trigrams of which every match of `regex` has one whole set."""
    return _sequence(list(parser.parse(regex)))


def _strings(op, value) -> set[str] | None:
    """All texts that a part of a regex stands for, in lower case; None if there are many."""
    if op is rc.LITERAL:
        return {chr(value).lower()}
    if op is rc.AT:
        return {""}
    if op is rc.IN:
        out = set()
        for kind, x in value:
            if kind is rc.LITERAL:
                out.add(chr(x).lower())
            elif kind is rc.RANGE and x[1] - x[0] < ALTERNATIVES:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= ALTERNATIVES else None
    if op is rc.SUBPATTERN:
        return _joined(list(value[-1]))
    if op is rc.BRANCH:
        parts = [_joined(list(x)) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        low, high, inner = value
        one = _joined(list(inner))
        if one is None or high is rc.MAXREPEAT or high > 8:
            return None
        out = set()
        for n in range(low, high + 1):
            out |= reduce(lambda a, b: {x + y for x in a for y in b}, [one] * n, {""})
        return out if len(out) <= ALTERNATIVES else None
    return None


def _joined(parts: list) -> set[str] | None:
    out = {""}
    for op, value in parts:
        one = _strings(op, value)
        if one is None or len(out) * len(one) > ALTERNATIVES:
            return None
        out = {x + y for x in out for y in one}
    return out


def _sequence(parts: list) -> Query:
    query, strings = ANY, {""}
    for op, value in parts:
        one = _strings(op, value)
        if one is not None and len(strings) * len(one) <= ALTERNATIVES:
            strings = {x + y for x in strings for y in one}
            continue
        query = _both(query, _of_strings(strings))
        if one is not None:
            # Only the ends go on into the next trigrams.
            strings = {y for y in one}
            continue
        strings = {""}
        if op is rc.SUBPATTERN:
            query = _both(query, _sequence(list(value[-1])))
        elif op is rc.BRANCH:
            query = _both(query, reduce(_either, [_sequence(list(x)) for x in value[1]]))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT) and value[0] > 0:
            query = _both(query, _sequence(list(value[2])))
    return _both(query, _of_strings(strings))


def postings(docs: DataFrame, grams: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(gram, id): the trigrams of `grams` that the lower-cased text has. Ids may repeat and may be NULL."""
    folded = docs.select(F.col(id).alias("id"), F.lower(F.col(text)).alias("folded"))
    found = ", ".join(f"IF(contains(folded, {literal(g)}), {literal(g)}, NULL)" for g in grams)
    return folded.selectExpr("id", f"explode(array_compact(array({found}))) AS gram")


def candidates(docs: DataFrame, rules: list[Rule], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rules): per id, the kinds whose trigram query its texts pass."""
    sets = []
    for rule in rules:
        query = trigram_query(rule.regex)
        if query != ANY:
            sets += [(rule.kind, f"{rule.kind}{k}", sorted(s)) for k, s in enumerate(sorted(query, key=sorted))]
    spark = docs.sparkSession
    if not sets:
        return docs.select(F.col(id).alias("id"), F.array().cast("array<string>").alias("rules")).limit(0)
    # As many rows as the rules name trigrams.
    named = [(g, kind, name, 1 << k, (1 << len(s)) - 1) for kind, name, s in sets for k, g in enumerate(s)]
    terms = F.broadcast(spark.createDataFrame(named, "gram string, kind string, name string, bit bigint, whole bigint"))
    found = postings(docs, sorted({g for _, _, s in sets for g in s}), id, text).join(terms, "gram")
    whole = found.groupBy("id", "name", "kind", "whole").agg(F.bit_or("bit").alias("seen")).filter("seen = whole")
    return whole.groupBy("id").agg(F.collect_set("kind").alias("rules"))


def _total(values: str) -> str:
    return f"aggregate({values}, 0, (a, x) -> a + x)"


def _spans(text: str, rule: Rule, rank: int) -> str:
    """SQL for the matches of a rule in a text: array of (start, rank, kind, end)."""
    regex = f"({rule.regex})"

    def placed(hits: str, parts: str, gaps: str, steps: str, before: str) -> str:
        inside = _total(f"slice({steps}, (i div {BLOCK}) * {BLOCK} + 1, CAST(i % {BLOCK} AS INT))")
        start = f"({before}[i div {BLOCK}] + {inside} + length({gaps}[i]))"
        at = (
            f"transform({hits}, (h, i) -> named_struct('start', {start}, 'rank', {rank}, 'kind', {literal(rule.kind)},"
            f" 'end', {start} + length(h), 'size', length({parts}[i])))"
        )
        kept = keep(at, lambda x: f"{x}.size >= {rule.least}")
        return each(kept, lambda x: f"named_struct('start', {x}.start, 'rank', {x}.rank, 'kind', {x}.kind, 'end', {x}.end)")

    def summed(hits: str, parts: str, gaps: str, steps: str) -> str:
        blocks = each(f"sequence(0, size({hits}) div {BLOCK})", lambda c: _total(f"slice({steps}, {c} * {BLOCK} + 1, {BLOCK})"))
        return let(
            blocks,
            lambda sums: let(
                each(f"sequence(0, size({sums}) - 1)", lambda c: _total(f"slice({sums}, 1, {c})")),
                lambda before: placed(hits, parts, gaps, steps, before),
            ),
        )

    part = 2 if rule.least else 1
    return let(
        f"regexp_extract_all({text}, {pattern(regex)}, 1)",
        lambda hits: let(
            f"regexp_extract_all({text}, {pattern(regex)}, {part})",
            lambda parts: let(
                f"split({text}, {pattern(rule.regex)}, -1)",
                lambda gaps: let(
                    f"zip_with({gaps}, {hits}, (g, h) -> length(g) + coalesce(length(h), 0))",
                    lambda steps: summed(hits, parts, gaps, steps),
                ),
            ),
        ),
    )


_SPANS = "array<struct<start: int, rank: int, kind: string, end: int>>"


def secrets(docs: DataFrame, rules: list[Rule] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and spans, an array of (start, rank, kind, end) by start and order of the rules.

    A NULL text has no spans. Rows that share an id are verified one by one; an
    id is only a way to find candidates.
    """
    rules = RULES if rules is None else rules
    told = candidates(docs, rules, id, text).withColumnRenamed("id", "_candidate")
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(told, F.col("id").eqNullSafe(F.col("_candidate")), "left")
    parts = []
    for rank, rule in enumerate(rules):
        test = f"rlike(text, {pattern(rule.regex)})"
        if trigram_query(rule.regex) != ANY:
            test = f"array_contains(rules, {literal(rule.kind)}) AND {test}"
        parts.append(f"CASE WHEN {test} THEN {_spans('text', rule, rank)} ELSE CAST(array() AS {_SPANS}) END")
    return rows.selectExpr("id", f"array_sort(concat({', '.join(parts)})) AS spans").withColumnRenamed("id", id)
