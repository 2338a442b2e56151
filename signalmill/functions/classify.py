"""Expressions that label events and items by rule."""

from __future__ import annotations

from signalmill.functions import fixed
from signalmill.functions.sql import Sql, any_of, contains_any, matches, no_texts, text
from signalmill.functions.text import first_line, severity_rank, truncate


def _signal(kind: str, severity: str, confidence: float, tags: Sql) -> Sql:
    return (
        f"named_struct('kind', {text(kind)}, 'severity', {text(severity)}, "
        f"'confidence', {confidence}D, 'tags', {tags})"
    )


def heuristic_signal(role: Sql, tool: Sql, status: Sql, error_code: Sql, body: Sql) -> Sql:
    """struct<kind, severity, confidence, tags> of the first rule that fires, else NULL."""
    failed = f"coalesce(lower({status}) = 'error', false) OR coalesce(startswith({error_code}, 'EXIT_'), false)"
    tool_tag = f"IF({tool} <> '', array(concat('tool:', {tool})), {no_texts()})"

    def low(kind: str, tag: str, pattern: str) -> Sql:
        return f"WHEN {matches(body, pattern)} THEN {_signal(kind, 'low', 0.3, f'array({text(tag)})')}"

    return f"""CASE WHEN {body} IS NULL OR {body} = '' THEN NULL
      WHEN {role} = 'toolResult' AND ({failed}) THEN {_signal("error", "medium", 0.4, tool_tag)}
      WHEN {role} = 'user' AND {matches(body, fixed.FRUSTRATION)}
        THEN {_signal("user_frustration", "medium", 0.4, "array('frustration')")}
      {low("experiment_suggestion", "experiment", fixed.EXPERIMENT)}
      {low("proactive_opportunity", "opportunity", fixed.OPPORTUNITY)}
      {low("user_delight", "delight", fixed.DELIGHT)}
      {low("improvement_suggestion", "suggestion", fixed.IMPROVE)} END"""


def heuristic_summary(body: Sql, limit: int) -> Sql:
    return truncate(first_line(body), limit)


def kind_v2(kind: Sql, summary: Sql, tags: Sql) -> Sql:
    """struct<label, reason>: the finer class of an item. Terms are substrings, first hit wins."""
    kind = f"lower(coalesce({kind}, ''))"
    said = f"lower(coalesce({summary}, ''))"
    tagged = any_of(tags, lambda t: f"lower({t}) = 'process'")
    is_process = f"(coalesce({tagged}, false) OR {contains_any(said, fixed.PROCESS_TERMS)})"
    suggestion = f"{kind} IN ('improvement_suggestion', 'experiment_suggestion')"

    def when(test: Sql, label: str, origin: str) -> Sql:
        return f"WHEN {test} THEN {answer(label, origin)}"

    def answer(label: str, origin: str) -> Sql:
        return f"named_struct('label', {text(label)}, 'reason', {text(f'{origin}:{label}')})"

    unreliable = contains_any(said, fixed.ERROR_RELIABILITY_TERMS)
    cases = [
        when(f"{kind} = 'proactive_opportunity'", "proactive_opportunity", "kind"),
        when(f"{kind} = 'user_delight'", "user_delight", "kind"),
        when(f"{kind} = 'error' AND {unreliable}", "reliability_perf", "error"),
        when(f"{kind} = 'error'", "defect", "error"),
        when(f"{kind} = 'user_frustration'", "ux_friction", "user_frustration"),
        *[
            when(f"{suggestion} AND {contains_any(said, terms)}", label, "suggestion")
            for label, terms in fixed.SUGGESTION_TERMS
        ],
        when(f"{suggestion} AND {is_process}", "process_tooling", "suggestion"),
        when(suggestion, "ux_friction", "suggestion"),
        when(is_process, "process_tooling", "other"),
    ]
    return f"CASE {' '.join(cases)} ELSE {answer('ux_friction', 'other')} END"


def sentiment(kind: Sql, summary: Sql) -> Sql:
    upset = contains_any(f"lower(coalesce({summary}, ''))", fixed.FRUSTRATED_STEMS)
    return f"IF(lower(coalesce({kind}, '')) = 'user_frustration' OR {upset}, 'frustrated', 'neutral')"


def _tiers(urgent: Sql, notable: Sql) -> Sql:
    """struct<tier, reasons> from the reasons of the first two tiers."""
    return f"""CASE WHEN size({urgent}) > 0 THEN named_struct('tier', 1, 'reasons', {urgent})
      WHEN size({notable}) > 0 THEN named_struct('tier', 2, 'reasons', {notable})
      ELSE named_struct('tier', 3, 'reasons', array('default')) END"""


def group_tier(max_severity: Sql, incident: Sql, error: Sql, frustration: Sql) -> Sql:
    """struct<tier, reasons> of a cluster from its counters."""
    rank = severity_rank(max_severity)
    urgent = f"array_compact(array(IF({incident}, 'incident', NULL), IF({rank} >= 3, concat('severity:', {max_severity}), NULL)))"
    notable = (
        f"array_compact(array(IF({error}, 'kind:error', NULL), IF({frustration}, 'kind:user_frustration', NULL), "
        f"IF({rank} = 2, 'severity:medium', NULL)))"
    )
    return _tiers(urgent, notable)


def group_score(count_items: Sql, max_severity: Sql, incident: Sql, error: Sql, frustration: Sql) -> Sql:
    # Added one by one: the order of the additions decides the last digit.
    out = f"(log1p({count_items}) + {severity_rank(max_severity)})"
    for hit, weight in ((incident, "2.0D"), (error, "0.3D"), (frustration, "0.2D")):
        out = f"({out} + IF({hit}, {weight}, 0.0D))"
    return out


def _has_incident(tags: Sql) -> Sql:
    return f"coalesce(array_contains({tags}, 'incident'), false)"


def item_tier(kind: Sql, severity: Sql, tags: Sql) -> Sql:
    """struct<tier, reasons> of a single item."""
    severity = f"lower(coalesce({severity}, 'unknown'))"
    kind = f"lower(coalesce({kind}, ''))"
    urgent = (
        f"array_compact(array(IF({_has_incident(tags)}, 'incident', NULL), "
        f"IF({severity} IN ('critical', 'high'), concat('severity:', {severity}), NULL)))"
    )
    notable = (
        f"array_compact(array(IF({kind} IN ('error', 'user_frustration'), concat('kind:', {kind}), NULL), "
        f"IF({severity} = 'medium', 'severity:medium', NULL)))"
    )
    return _tiers(urgent, notable)


def item_score(kind: Sql, severity: Sql, tags: Sql) -> Sql:
    kind = f"lower(coalesce({kind}, ''))"
    return (
        f"(CAST({severity_rank(f'''coalesce({severity}, 'unknown')''')} AS DOUBLE) + IF({_has_incident(tags)}, 2.0D, 0.0D) "
        f"+ IF({kind} = 'error', 0.3D, 0.0D) + IF({kind} = 'user_frustration', 0.2D, 0.0D))"
    )


def spoken_command(utterance: Sql) -> Sql:
    said = f"lower(trim({utterance}))"
    cases = " ".join(f"WHEN {contains_any(said, words)} THEN {text(name)}" for name, words in fixed.COMMANDS)
    return f"CASE {cases} ELSE 'unknown' END"
