"""DuckDB twins of the registered queries, built from shared common table expressions."""

from __future__ import annotations

from signalmill.functions import fixed
from signalmill.sources.tables import _ROLE, _TEXTS, _TOOL

_STOP = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)


def _re(pattern: str) -> str:
    """A pattern without the flags that only Java knows."""
    return pattern.replace("(?iU)", "").replace("(?U)", "").replace("(?i)", "")


def _hit(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{_re(pattern)}', 'i')"


def _has_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '')"


def _rstrip(text: str) -> str:
    return f"regexp_replace({text}, '\\s+$', '')"


def _redact(text: str, strict: bool = False) -> str:
    steps = list(fixed.REDACTIONS)
    if strict:
        steps = steps[:2] + [steps[7]] + steps[2:7]
    for pattern, mark in steps:
        text = f"regexp_replace({text}, '{_re(pattern)}', '{mark}', 'g')"
    return text


def _words(text: str) -> str:
    return (
        "list_filter(string_split(trim(regexp_replace(lower("
        f"{text}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    )


def _token_columns(source: str, text: str, name: str = "tok") -> str:
    """Subquery that adds the token list of `text`."""
    return (
        f"(SELECT *, CASE WHEN len(kept_) > 0 THEN kept_ ELSE words_ END AS {name} FROM "
        f"(SELECT *, list_filter(words_, lambda w: w NOT IN ({_STOP})) AS kept_ FROM "
        f"(SELECT *, {_words(text)} AS words_ FROM {source})))"
    )


def _grams(tok: str) -> str:
    return (
        f"CASE WHEN len({tok}) < 2 THEN array_to_string({tok}, ' ') ELSE array_to_string(list_transform("
        f"range(1, least(len({tok}), 7)), lambda g: {tok}[g] || '_' || {tok}[g + 1]), ' ') END"
    )


def _tag_core(tags: str) -> str:
    return f"array_to_string(list_transform(({tags})[1:5], lambda t: lower(left(t, 32))), ',')"


_TRACE = f"""
trace AS (
  SELECT 's' || CAST(user_id AS STRING) AS session_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i,
    event_id AS pos, ts, {_ROLE} AS role, {_TOOL} AS tool,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN 'error' ELSE 'ok' END END AS status,
    CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN 'EXIT_' || CAST(k % 4 AS STRING) END AS error_code,
    {_TEXTS} AS text
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""

_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_EMPTY_BLOCK = """'{"text":"","type":"text"}'"""

# The shape each raw line has, and what its content reads as.
_SHAPED = f"""{_TRACE},
shaped AS (
  SELECT *, i + 1 AS line_no, {_STAMP} AS stamp,
    CASE WHEN pos % 29 = 0 THEN 'bad' WHEN pos % 23 = 0 THEN 'heartbeat' WHEN pos % 11 = 0 THEN 'flat'
      WHEN role = 'toolResult' THEN 'result' WHEN role = 'toolCall' THEN 'call'
      WHEN pos % 2 = 0 THEN 'plain' ELSE 'list' END AS shape
  FROM trace),
lines AS (
  SELECT *, CASE WHEN shape IN ('result', 'list') AND text = '' THEN {_EMPTY_BLOCK}
      WHEN shape = 'call' AND text = '' THEN '{{"action":"' || tool || '","text":""}}'
      ELSE text END AS content,
    CASE WHEN shape = 'result' THEN CAST(substr(error_code, 6) AS BIGINT) END AS exit_code
  FROM shaped)"""


def _chunks(source: str, session: str, at: str, size: int, overlap: int) -> str:
    return f"""
ends AS (
  SELECT a.{session} AS session_id, a.{at} AS s, n.n,
    CASE WHEN a.{at} + {size} >= n.n THEN n.n ELSE a.{at} + {size} + CASE
      WHEN (p.role = 'toolCall' AND q.role = 'toolResult') OR (p.role = 'toolResult' AND q.role = 'assistant')
        OR (p.role = 'user' AND q.role = 'assistant') THEN 1 ELSE 0 END END AS e
  FROM {source} a JOIN (SELECT {session}, count(*) AS n FROM {source} GROUP BY 1) n ON n.{session} = a.{session}
  LEFT JOIN {source} p ON p.{session} = a.{session} AND p.{at} = a.{at} + {size} - 1
  LEFT JOIN {source} q ON q.{session} = a.{session} AND q.{at} = a.{at} + {size}),
bounds AS (
  SELECT session_id, CAST(0 AS BIGINT) AS chunk_idx, s, e, n FROM ends WHERE s = 0
  UNION ALL
  SELECT b.session_id, b.chunk_idx + 1, x.s, x.e, x.n FROM bounds b
  JOIN ends x ON x.session_id = b.session_id AND x.s = b.e - {overlap} WHERE b.e < b.n)"""


_FAILED = "(lower(status) = 'error' OR error_code LIKE 'EXIT\\_%' ESCAPE '\\')"
_KIND = f"""CASE WHEN text = '' THEN NULL
  WHEN role = 'toolResult' AND coalesce({_FAILED}, false) THEN 'error'
  WHEN role = 'user' AND {_hit("text", fixed.FRUSTRATION)} THEN 'user_frustration'
  WHEN {_hit("text", fixed.EXPERIMENT)} THEN 'experiment_suggestion'
  WHEN {_hit("text", fixed.OPPORTUNITY)} THEN 'proactive_opportunity'
  WHEN {_hit("text", fixed.DELIGHT)} THEN 'user_delight'
  WHEN {_hit("text", fixed.IMPROVE)} THEN 'improvement_suggestion' END"""

_HITS = f"""
hits AS (
  SELECT *, CASE WHEN kind IN ('error', 'user_frustration') THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN kind IN ('error', 'user_frustration') THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS confidence,
    CASE kind WHEN 'error' THEN ['tool:' || tool] WHEN 'user_frustration' THEN ['frustration']
      WHEN 'experiment_suggestion' THEN ['experiment'] WHEN 'proactive_opportunity' THEN ['opportunity']
      WHEN 'user_delight' THEN ['delight'] ELSE ['suggestion'] END AS tags,
    text AS summary
  FROM (SELECT *, {_KIND} AS kind FROM trace) WHERE kind IS NOT NULL)"""

_ITEMS = f"""{_TRACE},{_chunks("trace", "session_id", "i", 20, 4)},{_HITS},
per_chunk AS (
  SELECT h.* EXCLUDE (tags), b.chunk_idx,
    row_number() OVER (PARTITION BY h.session_id, b.chunk_idx ORDER BY confidence DESC, i) AS rank,
    CASE WHEN contains(lower(summary), 'incident') AND NOT list_contains(tags, 'incident')
      THEN list_append(tags, 'incident') ELSE tags END AS tags,
    'sha256:' || sha256('{{"kind": "' || kind || '", "quotes": ["' || text || '"], "session_id": "'
      || h.session_id || '", "summary": "' || summary || '"}}') AS item_id
  FROM (SELECT h.*, b.chunk_idx, row_number() OVER (PARTITION BY h.session_id, b.chunk_idx ORDER BY i) AS no
        FROM hits h JOIN bounds b ON b.session_id = h.session_id AND h.i >= b.s AND h.i < b.e) h
  JOIN bounds b ON b.session_id = h.session_id AND b.chunk_idx = h.chunk_idx WHERE no <= 10),
items AS (
  SELECT *, row_number() OVER (ORDER BY session_id, chunk_idx, rank) AS place FROM per_chunk
  QUALIFY row_number() OVER (PARTITION BY session_id, item_id, i ORDER BY chunk_idx, rank) = 1)"""

_ITEMS = _ITEMS.replace("SELECT h.* EXCLUDE (tags), b.chunk_idx,", "SELECT h.* EXCLUDE (tags, no),")


def _fine(kind: str, text: str, what: str) -> str:
    """Finer class or reason; `text` must be lower-cased and no item carries the tag `process`."""

    def answer(label: str, origin: str) -> str:
        return f"'{label}'" if what == "label" else f"'{origin}:{label}'"

    suggestion = f"{kind} IN ('improvement_suggestion', 'experiment_suggestion')"
    out = f"""CASE WHEN {kind} = 'proactive_opportunity' THEN {answer("proactive_opportunity", "kind")}
      WHEN {kind} = 'user_delight' THEN {answer("user_delight", "kind")}
      WHEN {kind} = 'error' AND {_has_any(text, fixed.ERROR_RELIABILITY_TERMS)} THEN {answer("reliability_perf", "error")}
      WHEN {kind} = 'error' THEN {answer("defect", "error")}
      WHEN {kind} = 'user_frustration' THEN {answer("ux_friction", "user_frustration")}"""
    for label, terms in fixed.SUGGESTION_TERMS:
        out += f"\n WHEN {suggestion} AND {_has_any(text, terms)} THEN {answer(label, 'suggestion')}"
    return (
        out
        + f"""\n WHEN {suggestion} AND {_has_any(text, fixed.PROCESS_TERMS)} THEN {answer("process_tooling", "suggestion")}
      WHEN {suggestion} THEN {answer("ux_friction", "suggestion")}
      WHEN {_has_any(text, fixed.PROCESS_TERMS)} THEN {answer("process_tooling", "other")}
      ELSE {answer("ux_friction", "other")} END"""
    )


def _mood(kind: str, text: str) -> str:
    return f"CASE WHEN {kind} = 'user_frustration' OR {_has_any(text, fixed.FRUSTRATED_STEMS)} THEN 'frustrated' ELSE 'neutral' END"


_SEV = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_TAGS = "string_agg(value || ':' || CAST(n AS STRING), ',' ORDER BY n DESC, first_place)"


def _score(n: str, severity: str) -> str:
    return (
        f"ln(1 + {n}) + {_SEV.format(severity)} + CASE WHEN incident THEN 2.0 ELSE 0 END"
        " + CASE WHEN error THEN 0.3 ELSE 0 END + CASE WHEN frustration THEN 0.2 ELSE 0 END"
    )


def _tier(severity: str) -> str:
    rank = _SEV.format(severity)
    return f"CASE WHEN incident OR {rank} >= 3 THEN 1 WHEN error OR frustration OR {rank} = 2 THEN 2 ELSE 3 END"


def _tier_reasons(severity: str) -> str:
    rank = _SEV.format(severity)
    return f"""CASE WHEN incident OR {rank} >= 3
      THEN concat_ws(',', CASE WHEN incident THEN 'incident' END, CASE WHEN {rank} >= 3 THEN 'severity:' || {severity} END)
      WHEN error OR frustration OR {rank} = 2 THEN concat_ws(',', CASE WHEN error THEN 'kind:error' END,
        CASE WHEN frustration THEN 'kind:user_frustration' END, CASE WHEN {rank} = 2 THEN 'severity:medium' END)
      ELSE 'default' END"""


def _clusters(items: str = "items", suffix: str = "") -> str:
    """CTEs that end in `clusters<suffix>`."""
    x = suffix
    return f"""
signed{x} AS (
  SELECT *, 'sig1:' || sha256(signature_raw) AS signature_id FROM (
    SELECT *, kind || '|' || {_grams("tok")} || '|' || {_tag_core("list_sort(tags)")} AS signature_raw,
      {_fine("kind", "lower(summary)", "label")} AS label, {_fine("kind", "lower(summary)", "reason")} AS reason,
      {_mood("kind", "lower(summary)")} AS mood, {_redact("summary")} AS clean
    FROM {_token_columns(items, "summary")})),
counts{x} AS (
  SELECT signature_id, facet, value, count(*) AS n, min(place) AS first_place FROM (
    SELECT signature_id, place * 100 AS place, unnest(['kind', 'kind_v2', 'reason', 'severity', 'sentiment', 'session', 'summary']) AS facet,
      unnest([kind, label, reason, severity, mood, session_id, clean]) AS value FROM signed{x}
    UNION ALL SELECT signature_id, place * 100 + generate_subscripts(tags, 1), 'tag', unnest(tags) FROM signed{x}) GROUP BY ALL),
tags{x} AS (
  SELECT signature_id, list(value ORDER BY n DESC, first_place) AS tag_list, list(n ORDER BY n DESC, first_place) AS tag_n,
    {_TAGS} AS tags_top
  FROM (SELECT * FROM counts{x} WHERE facet = 'tag'
        QUALIFY row_number() OVER (PARTITION BY signature_id ORDER BY n DESC, first_place) <= 8) GROUP BY 1),
base{x} AS (
  SELECT signature_id, CAST(sum(n) FILTER (facet = 'kind') AS BIGINT) AS count_items,
    count(*) FILTER (facet = 'session') AS count_sessions, min(first_place) AS first_place,
    string_agg(value || ':' || CAST(n AS STRING), ',' ORDER BY value) FILTER (facet = 'kind') AS kind_counts,
    string_agg(value || ':' || CAST(n AS STRING), ',' ORDER BY value) FILTER (facet = 'kind_v2') AS kind_v2_counts,
    first(value ORDER BY n DESC, first_place) FILTER (facet = 'kind_v2') AS kind_v2_primary,
    first(value ORDER BY n DESC, first_place) FILTER (facet = 'sentiment') AS sentiment,
    first(value ORDER BY n DESC, first_place) FILTER (facet = 'summary') AS canonical_summary,
    first(value ORDER BY {_SEV.format("value")} DESC, first_place) FILTER (facet = 'severity') AS max_severity,
    array_to_string((list(value || ':' || CAST(n AS STRING) ORDER BY n DESC, first_place) FILTER (facet = 'reason'))[1:2], ',') AS reasons,
    bool_or(facet = 'tag' AND value = 'incident') AS incident, bool_or(facet = 'kind' AND value = 'error') AS error,
    bool_or(facet = 'kind' AND value = 'user_frustration') AS frustration
  FROM counts{x} GROUP BY 1),
clusters{x} AS (
  SELECT *, 'fp1:' || sha256(fp_raw) AS fingerprint_id, {_redact("fp_raw")} AS fingerprint_text,
    {_redact("sig_raw")} AS signature_text FROM (
    SELECT b.*, t.tag_list, t.tag_n, coalesce(t.tags_top, '') AS tags_top, s.signature_raw AS sig_raw,
      kind_v2_primary || '|' || {_grams("tok")} || '|' || coalesce({_tag_core("t.tag_list")}, '') AS fp_raw,
      CAST({_tier("max_severity")} AS INTEGER) AS tier, {_tier_reasons("max_severity")} AS tier_reasons,
      {_score("count_items", "max_severity")} AS score
    FROM {_token_columns(f"base{x}", "canonical_summary")} b LEFT JOIN tags{x} t USING (signature_id)
    JOIN (SELECT signature_id, any_value(signature_raw) AS signature_raw FROM signed{x} GROUP BY 1) s USING (signature_id)))"""


_CLUSTERS = f"{_ITEMS},{_clusters()}"
_RANKED = "tier, score DESC, first_place"

_PAIRS = f"""{_CLUSTERS},
sets AS (SELECT signature_id, kind_v2_primary AS block, list_distinct(tok) AS w
  FROM {_token_columns("clusters", "canonical_summary")}),
sims AS (
  SELECT a.signature_id AS a, b.signature_id AS b,
    len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS sim
  FROM sets a JOIN sets b ON a.block = b.block AND a.signature_id < b.signature_id)"""

_DISTINCT = f"""{_PAIRS},
reps AS (SELECT min(signature_id) AS id FROM sets GROUP BY block, list_sort(w))"""

_MEMBERS = f"""{_PAIRS},
near AS (SELECT a, b FROM sims WHERE sim >= 0.62 UNION SELECT b, a FROM sims WHERE sim >= 0.62),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
members AS (SELECT a AS signature_id, least(a, min(b)) AS component FROM reach GROUP BY a)"""

_MERGED = f"""{_MEMBERS},
mem AS (SELECT c.*, m.component, row_number() OVER (ORDER BY {_RANKED}) AS ord
  FROM clusters c JOIN members m USING (signature_id)),
sess AS (SELECT m.component, count(DISTINCT s.session_id) AS count_sessions
  FROM signed s JOIN members m USING (signature_id) GROUP BY 1),
mkinds AS (SELECT component, facet, value, sum(c.n) AS n, min((m.ord, c.n * 0 + c.first_place)) AS o
  FROM counts c JOIN mem m USING (signature_id) WHERE facet IN ('kind', 'kind_v2') GROUP BY ALL),
mtags AS (SELECT component, value, sum(n) AS n, min((ord, nth)) AS o FROM (
    SELECT component, ord, unnest(tag_list) AS value, unnest(tag_n) AS n, generate_subscripts(tag_list, 1) AS nth FROM mem)
  GROUP BY ALL),
mtop AS (SELECT component, list(value ORDER BY n DESC, o) AS tag_list,
    string_agg(value || ':' || CAST(n AS STRING), ',' ORDER BY n DESC, o) AS tags_top
  FROM (SELECT * FROM mtags QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, o) <= 8) GROUP BY 1),
mbase AS (
  SELECT component, CAST(sum(count_items) AS BIGINT) AS count_items, count(*) AS merged,
    first(max_severity ORDER BY {_SEV.format("max_severity")} DESC, ord) AS max_severity,
    first(signature_id ORDER BY count_items DESC, ord) AS signature_id,
    first(canonical_summary ORDER BY count_items DESC, ord) AS canonical_summary
  FROM mem GROUP BY 1),
mmood AS (SELECT component, first(sentiment ORDER BY k DESC, o) AS sentiment FROM (
    SELECT component, sentiment, count(*) AS k, min(ord) AS o FROM mem GROUP BY ALL) GROUP BY 1),
mfacets AS (SELECT component,
    string_agg(value || ':' || CAST(n AS STRING), ',' ORDER BY value) FILTER (facet = 'kind') AS kind_counts,
    string_agg(value || ':' || CAST(n AS STRING), ',' ORDER BY value) FILTER (facet = 'kind_v2') AS kind_v2_counts,
    first(value ORDER BY n DESC, o) FILTER (facet = 'kind_v2') AS kind_v2_primary,
    bool_or(facet = 'kind' AND value = 'error') AS error,
    bool_or(facet = 'kind' AND value = 'user_frustration') AS frustration FROM mkinds GROUP BY 1),
mall AS (SELECT * FROM
  {_token_columns("mbase", "canonical_summary")} JOIN mfacets USING (component) JOIN mmood USING (component)
  JOIN sess USING (component) JOIN mtop USING (component)
  JOIN (SELECT component, bool_or(incident) AS incident FROM mem GROUP BY 1) USING (component)),
merged_rows AS (
  SELECT signature_id, merged, count_items, count_sessions, max_severity, CAST({_tier("max_severity")} AS INTEGER) AS tier,
    round({_score("count_items", "max_severity")}, 6) AS score, kind_v2_primary, sentiment, kind_counts, kind_v2_counts,
    tags_top, canonical_summary,
    'fp1:' || sha256(kind_v2_primary || '|' || {_grams("tok")} || '|' || {_tag_core("tag_list")}) AS fingerprint_id
  FROM mall
  UNION ALL
  SELECT signature_id, 1, count_items, count_sessions, max_severity, tier, round(score, 6), kind_v2_primary, sentiment,
    kind_counts, kind_v2_counts, tags_top, canonical_summary, fingerprint_id
  FROM clusters WHERE signature_id NOT IN (SELECT signature_id FROM members))"""

_KNOWN = f"""{_CLUSTERS},
known AS (SELECT fingerprint_id, max_by('T-' || substr(signature_id, 6, 8), signature_id) AS phid,
    max_by('Signal: ' || canonical_summary, signature_id) AS name
  FROM clusters WHERE max_severity = 'medium' GROUP BY 1)"""

_FUZZY = f"""{_CLUSTERS},
summaries AS (SELECT summary, min(place) AS p, list_distinct(regexp_split_to_array(lower(summary), '\\s+')) AS w
  FROM items GROUP BY summary),
firsts AS (SELECT *, row_number() OVER (PARTITION BY summary ORDER BY place) AS no FROM items QUALIFY no <= 3),
cw AS (SELECT signature_id, canonical_summary, kind_v2_primary,
  list_distinct(regexp_split_to_array(lower(canonical_summary), '\\s+')) AS w FROM clusters),
snips AS (
  SELECT c.signature_id, unnest(['[' || f.role || ']: ' || f.text, '[signal]: ' || f.summary]) AS line,
    unnest([1, 2]) AS part, s.p, f.no
  FROM cw c JOIN summaries s ON len(list_intersect(c.w, s.w)) >= 3 JOIN firsts f ON f.summary = s.summary),
uniq AS (SELECT signature_id, line, min((p, no, part)) AS o FROM snips GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY signature_id ORDER BY o) AS k FROM uniq QUALIFY k <= 15),
contexts AS (
  SELECT c.signature_id, c.kind_v2_primary, c.canonical_summary,
    coalesce(string_agg(n.line, chr(10) || '---' || chr(10) ORDER BY n.k), '[canonical]: ' || c.canonical_summary) AS full_context
  FROM cw c LEFT JOIN numbered n USING (signature_id) GROUP BY c.signature_id, c.kind_v2_primary, c.canonical_summary)"""

_LABELLED = """
labelled AS (
  SELECT d.doc_id, ['defect', 'ux_friction', 'user_delight', 'capability_gap', 'safety_compliance'][n_chars % 5 + 1] AS auto,
    ['defect', 'ux_friction', 'user_delight', 'capability_gap', 'safety_compliance'][(n_chars + quality + toxic) % 5 + 1] AS judged,
    quality = 1 AS is_real_issue, CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END AS severity
  FROM documents d JOIN labels l USING (doc_id))"""

_CALLS = f"""{_TRACE},
calls AS (SELECT session_id, i, tool, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS t
  FROM trace WHERE role = 'toolCall'),
ahead AS (SELECT *, lead(tool, 1) OVER w AS n1, lead(tool, 2) OVER w AS n2, lead(tool, 3) OVER w AS n3, lead(tool, 4) OVER w AS n4
  FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY t)),
grams AS (
  SELECT 2 AS n, [tool, n1] AS p, session_id, t FROM ahead WHERE n1 IS NOT NULL
  UNION ALL SELECT 3, [tool, n1, n2], session_id, t FROM ahead WHERE n2 IS NOT NULL
  UNION ALL SELECT 4, [tool, n1, n2, n3], session_id, t FROM ahead WHERE n3 IS NOT NULL
  UNION ALL SELECT 5, [tool, n1, n2, n3, n4], session_id, t FROM ahead WHERE n4 IS NOT NULL),
counted AS (SELECT n, p, count(*) AS c, min((session_id, t)) AS o FROM grams GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c DESC, o) AS place FROM counted)"""

# All sequences of up to four tools, looked for in the calls of a session as one string.
_PATTERNS = f"""{_TRACE},
strings AS (SELECT session_id, string_agg('<' || tool || '>', '' ORDER BY i) AS s FROM trace WHERE role = 'toolCall' GROUP BY session_id),
tools AS (SELECT DISTINCT tool FROM trace WHERE role = 'toolCall'),
p1 AS (SELECT [tool] AS p FROM tools), p2 AS (SELECT list_append(p, tool) AS p FROM p1, tools),
p3 AS (SELECT list_append(p, tool) AS p FROM p2, tools), p4 AS (SELECT list_append(p, tool) AS p FROM p3, tools),
every AS (SELECT p FROM p1 UNION ALL SELECT p FROM p2 UNION ALL SELECT p FROM p3 UNION ALL SELECT p FROM p4),
follows AS MATERIALIZED (SELECT p, session_id FROM every, strings WHERE regexp_matches(s, '<' || array_to_string(p, '>.*<') || '>')),
frequent AS MATERIALIZED (SELECT p, count(*) AS support FROM follows GROUP BY p HAVING count(*) >= (SELECT ceil(count(*) / 4.0) FROM strings)),
inside AS (SELECT DISTINCT p[:CAST(k AS BIGINT) - 1] || p[CAST(k AS BIGINT) + 1:] AS p, support FROM (SELECT p, support, unnest(range(1, len(p) + 1)) AS k FROM frequent WHERE len(p) > 1)),
told AS MATERIALIZED (SELECT f.p, f.support, i.p IS NULL AS closed FROM frequent f LEFT JOIN inside i ON i.p = f.p AND i.support = f.support)"""

_CRON = f"""{_TRACE},
cron AS (SELECT *, contains(lower(text), 'error') AND contains(text, 'Cron') AS is_error, left(text, 100) AS preview
  FROM trace WHERE regexp_matches(text, '{_re(fixed.CRON_LABEL)}', 'i') OR contains(text, 'Cron')),
gaps AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY i) AS gap_us, gap_us / 1000.0::DOUBLE AS gap_ms FROM cron)"""
_FALSE_ERROR = f"(is_error AND {_has_any('lower(preview)', fixed.SUCCESS_WORDS)})"

_LATENCY = """
lat AS (SELECT substr(event_type, 1, 2) AS phase, event_id AS call_id, ts, value AS latency_ms, user_id % 7 <> 0 AS ok,
  CASE WHEN event_id % 2 = 0 THEN 'TIMEOUT after 35s' ELSE 'refused' END AS error FROM events)"""

_TRIAGED = f"""{_ITEMS},
tri AS (SELECT *, CASE WHEN list_contains(tags, 'incident') THEN 1 WHEN kind IN ('error', 'user_frustration') OR severity = 'medium'
      THEN 2 ELSE 3 END AS tier,
    CASE WHEN list_contains(tags, 'incident') THEN 'incident' WHEN kind IN ('error', 'user_frustration') OR severity = 'medium'
      THEN concat_ws(',', CASE WHEN kind IN ('error', 'user_frustration') THEN 'kind:' || kind END,
        CASE WHEN severity = 'medium' THEN 'severity:medium' END) ELSE 'default' END AS tier_reasons,
    round({_SEV.format("severity")}::DOUBLE + CASE WHEN list_contains(tags, 'incident') THEN 2.0 ELSE 0 END
      + CASE kind WHEN 'error' THEN 0.3 WHEN 'user_frustration' THEN 0.2 ELSE 0 END, 6) AS triage_score FROM items)"""

_DIGEST = f"""
d0 AS (SELECT doc_id, {_strip("text")} AS s FROM documents),
d1 AS (SELECT *, list_filter(list_transform(string_split(s, chr(10)), lambda l: {_strip("l")}), lambda l: l <> '') AS ls FROM d0),
d2 AS (SELECT *, CASE WHEN len(ls) > 1 THEN [ls[1], ls[-1]] ELSE ls END AS ends_,
  list_filter(ls, lambda l: {_hit("l", fixed.SALIENT)}) AS sal FROM d1),
d3 AS (SELECT *, {_strip("array_to_string(list_concat(ends_, list_filter(sal, lambda l, k: NOT list_contains(ends_, l) AND list_position(sal, l) = k)), chr(10))")} AS dig,
  {_strip("concat(" + _rstrip("left(s, 400)") + ", chr(10), '...', chr(10), " + _strip("right(s, 400)") + ")")} AS ht FROM d2)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


def _flat(source: str) -> str:
    return f"""SELECT item_id, session_id, chunk_idx, rank, kind, summary, severity, confidence,
      array_to_string(tags, ',') AS tags, i AS start_i, i AS end_i, text AS quotes FROM {source}"""


def _context_sql() -> str:
    return f"""{_CLUSTERS},
opening AS (SELECT session_id, i, '[' || role || ']: ' || left(text, 500) AS line FROM trace
  WHERE i < 50 AND role IN ('user', 'assistant', 'system') AND text <> ''
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i) <= 10),
pairs AS (SELECT DISTINCT signature_id, session_id FROM signed),
firstten AS (SELECT p.signature_id, o.line, row_number() OVER (PARTITION BY p.signature_id ORDER BY o.session_id, o.i) AS k
  FROM pairs p JOIN opening o USING (session_id) QUALIFY k <= 10)"""


def all_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["tokens_signature"] = f"""SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, raw AS signature_text, 'sig1:' || sha256(raw) AS signature_id
      FROM (SELECT *, 'other|' || {_grams("tok")} || '|' || {_tag_core("list_sort([source, lang])")} AS raw FROM {_token_columns("documents", "text")})"""
    sql["redact_documents"] = f"SELECT doc_id, {_redact('text')} AS text FROM documents"
    sql["redact_strict"] = f"SELECT doc_id, {_redact('text', True)} AS text FROM documents"
    sql["keywords_documents"] = f"""SELECT doc_id, array_to_string((list_filter(w, lambda x, k: list_position(w, x) = k))[1:12], ',') AS keywords,
        CASE WHEN slug = '' THEN 'brief' ELSE slug END AS slug
      FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{4,}}'), lambda x: x NOT IN ({_STOP})) AS w,
        left(regexp_replace(regexp_replace(lower({_strip("text")}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM documents)"""
    sql["salience_digest"] = _with(
        _DIGEST,
        f"""SELECT doc_id, CASE WHEN length(s) <= 800 THEN s WHEN length(dig) <= 800 THEN dig
          WHEN length(ht) > 800 THEN {_rstrip("left(ht, 797)")} || '...' ELSE ht END AS text,
        CASE WHEN length(s) <= 800 THEN false WHEN length(dig) <= 800 THEN true ELSE length(ht) > 800 END AS cut FROM d3""",
    )
    sql["truncate_messages"] = f"""SELECT conv_id, turn, CASE WHEN length(s) <= 200 THEN s ELSE {_rstrip("left(s, 197)")} || '...' END AS text,
        length(s) > 200 AS cut FROM (SELECT *, {_strip("text")} AS s FROM conversations)"""

    sql["trace_view"] = _with(_TRACE, "SELECT * REPLACE (epoch_us(ts) AS ts) FROM trace")
    view_text = """CASE shape WHEN 'bad' THEN 'malformed JSON'
        WHEN 'result' THEN concat_ws(chr(10), 'tool=' || tool, 'status=' || status, 'exitCode=' || CAST(exit_code AS STRING), content)
        ELSE content END"""
    sql["event_views"] = _with(
        _SHAPED,
        f"""SELECT session_id, i, pos, CASE WHEN shape <> 'bad' THEN stamp END AS ts,
        CASE WHEN shape = 'bad' THEN 'parse_error' ELSE role END AS role, CASE WHEN shape <> 'bad' THEN tool END AS tool,
        CASE WHEN shape IN ('result', 'flat') THEN status END AS status,
        CASE WHEN shape IN ('result', 'flat') THEN error_code END AS error_code, {view_text} AS text, false AS text_truncated,
        CASE shape WHEN 'bad' THEN '_parse_error' WHEN 'flat' THEN 'event' WHEN 'result' THEN 'message.details+content'
          WHEN 'call' THEN 'message.input' ELSE 'message.content' END AS raw_shape
        FROM lines WHERE shape <> 'heartbeat'""",
    )
    sql["session_files"] = _with(
        _SHAPED,
        """SELECT session_id, i + 1 + count(*) FILTER (pos % 13 = 0) OVER (PARTITION BY session_id ORDER BY i) AS line_no, i,
        shape = 'bad' AS bad, CASE WHEN shape IN ('result', 'call', 'plain', 'list') THEN role END AS role
        FROM lines""",
    )
    sql["tool_calls"] = _with(
        _SHAPED,
        """SELECT session_id, i, line_no, tool AS tool_name, CASE WHEN shape = 'result' THEN 'c' || CAST(pos AS STRING) END AS tool_call_id,
        CAST(NULL AS STRING) AS action, status, CASE WHEN shape = 'result' THEN CAST(exit_code AS STRING) END AS exit_code,
        CAST(NULL AS STRING) AS error, nullif(content, '') AS preview
        FROM lines WHERE shape = 'result' OR (shape = 'flat' AND tool IS NOT NULL)""",
    )
    pattern = f"({_hit('text', fixed.FAILURE[0])} OR {_hit('text', fixed.FAILURE[1])})"
    sql["failures"] = _with(
        _SHAPED,
        f"""SELECT session_id, i, line_no, kind, CASE WHEN kind = 'parse_error' THEN 'malformed JSON' ELSE content END AS detail,
        CASE WHEN kind = 'tool_error' THEN tool END AS tool_name, CASE WHEN kind = 'tool_error' THEN status END AS status,
        CASE WHEN kind = 'tool_error' THEN exit_code END AS exit_code
        FROM (SELECT *, CASE WHEN shape = 'bad' THEN 'parse_error'
            WHEN shape = 'result' AND (status = 'error' OR coalesce(exit_code, 0) <> 0) THEN 'tool_error'
            WHEN shape IN ('flat', 'result', 'plain', 'list') AND {pattern} THEN 'pattern' END AS kind FROM lines)
        WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i) <= 200""",
    )
    sql["search_hits"] = _with(
        _SHAPED,
        """SELECT session_id, i, line_no, CASE WHEN shape = 'flat' THEN concat_ws(',', 'content', CASE WHEN error_code IS NOT NULL THEN 'error_code' END,
          'role', CASE WHEN status IS NOT NULL THEN 'status' END, 'timestamp', CASE WHEN tool IS NOT NULL THEN 'tool' END)
          ELSE 'message,timestamp,type' END AS keys,
        CASE WHEN shape = 'call' THEN '{"message":{"input":{"action":"' || tool || '","text":"' || text || '"},"role":"toolCall","toolName":"'
          || tool || '"},"timestamp":"' || stamp || '","type":"message"}' ELSE content END AS preview
        FROM lines WHERE shape NOT IN ('bad', 'heartbeat') AND contains(text, 'gateway')
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i) <= 30""",
    )
    sql["span_window"] = _with(
        _SHAPED,
        """SELECT session_id, i, line_no, CASE WHEN shape = 'heartbeat' THEN 'heartbeat' WHEN shape IN ('result', 'call', 'plain', 'list')
        THEN 'message' END AS type, CASE WHEN shape <> 'bad' THEN stamp END AS timestamp FROM lines WHERE i >= 5 AND i < 300""",
    )
    sql["span_summary"] = _with(
        _SHAPED,
        """SELECT session_id, count(*) AS events, count(*) FILTER (shape = 'flat' AND tool IS NOT NULL) AS tool_calls, 0 AS errors,
        'Span [0,40) events=' || count(*) || ' tool_calls=' || count(*) FILTER (shape = 'flat' AND tool IS NOT NULL) || ' errors=0'
        || chr(10) || 'Examples:' || chr(10) || '- ' || coalesce(array_to_string((list(text ORDER BY i) FILTER (
          shape IN ('flat', 'result', 'plain', 'list') AND text <> ''))[1:6], chr(10) || '- '), '') AS summary
        FROM lines WHERE i < 40 GROUP BY session_id""",
    )

    bounds = f"{_TRACE},{_chunks('trace', 'session_id', 'i', 20, 4)}"
    sql["chunk_spans"] = _with(
        bounds,
        "SELECT session_id, chunk_idx, 'chunk:' || CAST(chunk_idx AS STRING) AS chunk_id, s AS start_i, e - 1 AS end_i, e - s AS views FROM bounds",
    )
    sql["chunk_turns"] = _with(
        _chunks("conversations", "conv_id", "turn", 4, 1), "SELECT session_id, chunk_idx, s AS start_v, e AS end_v FROM bounds"
    )
    sql["chunk_members"] = _with(
        bounds,
        """SELECT b.session_id, chunk_idx, count(*) AS views, count(*) FILTER (role = 'user') AS user_views, CAST(sum(pos) AS BIGINT) AS pos_sum
        FROM bounds b JOIN trace t ON t.session_id = b.session_id AND t.i >= b.s AND t.i < b.e GROUP BY ALL""",
    )
    sql["heuristic_signals"] = _with(
        f"{_TRACE},{_HITS}",
        "SELECT session_id, i, kind, severity, confidence, array_to_string(tags, ',') AS tags, summary FROM hits",
    )
    sql["mined_items"] = _with(_ITEMS, _flat("items"))
    sql["mined_items_per_chunk"] = _with(_ITEMS, _flat("per_chunk"))
    sql["mine_summary"] = _with(
        _ITEMS,
        """SELECT (SELECT count(DISTINCT session_id) FROM trace) AS sessions_scanned,
        (SELECT count(DISTINCT session_id) FROM items) AS sessions_with_items, (SELECT count(*) FROM items) AS items""",
    )

    sql["rollup_ranked"] = _with(
        _CLUSTERS, "SELECT signature_id, count_items, count_sessions, max_severity, tier, round(score, 6) AS score FROM clusters"
    )
    sql["rollup_counters"] = _with(
        _CLUSTERS,
        """SELECT signature_id, signature_text, canonical_summary, kind_counts, kind_v2_counts, kind_v2_primary, sentiment,
        tier_reasons, reasons FROM clusters""",
    )
    sql["rollup_fingerprints"] = _with(_CLUSTERS, "SELECT signature_id, tags_top, fingerprint_text, fingerprint_id FROM clusters")
    sql["rollup_samples"] = _with(
        _CLUSTERS,
        """SELECT signature_id, string_agg(item_id, ',' ORDER BY place) AS sample_items,
        string_agg(session_id || '/chunk:' || CAST(chunk_idx AS STRING), ',' ORDER BY place) AS sample_chunks
        FROM (SELECT * FROM signed QUALIFY row_number() OVER (PARTITION BY signature_id ORDER BY place) <= 3) GROUP BY 1""",
    )
    sql["rollup_summary"] = _with(
        _CLUSTERS,
        """SELECT CAST(sum(count_items) AS BIGINT) AS items, count(*) AS groups, count(*) FILTER (tier = 1) AS tier1,
        count(*) FILTER (tier = 2) AS tier2, count(*) FILTER (tier = 3) AS tier3 FROM clusters""",
    )
    sql["kind_v2_labels"] = _with(
        _TRACE,
        f"""SELECT session_id, i, kind, {_fine("kind", "lower(text)", "label")} AS kind_v2, {_fine("kind", "lower(text)", "reason")} AS reason,
        {_mood("kind", "lower(text)")} AS sentiment FROM trace, (VALUES ('error'), ('improvement_suggestion'), ('other')) k(kind)""",
    )
    browse = "SELECT signature_id, kind_v2_primary, tier, round(score, 6) AS score FROM clusters WHERE"
    sql["rollup_browse"] = _with(
        _CLUSTERS, f"{browse} tier = 2 AND list_contains(tag_list, 'suggestion') UNION ALL {browse} kind_v2_primary = 'defect'"
    )
    sql["best_per_kind"] = _with(
        _CLUSTERS,
        f"""SELECT kind_v2_primary, signature_id, tier, round(score, 6) AS score FROM clusters
        QUALIFY row_number() OVER (PARTITION BY kind_v2_primary ORDER BY {_RANKED}) = 1""",
    )
    halves = f"""{_ITEMS}, early AS (SELECT * FROM items WHERE i < 30), late AS (SELECT * FROM items WHERE i >= 30),
    {_clusters("early", "_e")}, {_clusters("late", "_o")},
    be AS (SELECT fingerprint_id, CAST(sum(count_items) AS BIGINT) AS n FROM clusters_e GROUP BY 1),
    af AS (SELECT fingerprint_id, CAST(sum(count_items) AS BIGINT) AS n FROM clusters_o GROUP BY 1)"""
    sql["rollup_diff"] = _with(
        halves,
        """SELECT coalesce(be.fingerprint_id, af.fingerprint_id) AS fingerprint_id, be.n AS items_before, af.n AS items_after,
        CASE WHEN be.n IS NULL THEN 'new' WHEN af.n IS NULL THEN 'gone' WHEN be.n <> af.n THEN 'changed' ELSE 'same' END AS state
        FROM be FULL JOIN af ON be.fingerprint_id = af.fingerprint_id""",
    )

    distinct = "a IN (SELECT id FROM reps) AND b IN (SELECT id FROM reps)"

    def band(low: float, high: float) -> str:
        """All pairs of different word sets in a band of similarity."""
        return f"band AS (SELECT a, b, sim FROM sims WHERE sim >= {low} AND sim < {high} AND {distinct})"

    sql["similar_pairs"] = _with(f"{_DISTINCT}, {band(0.62, 2.0)}", "SELECT a, b, round(sim, 6) AS sim FROM band")
    sql["merge_components"] = _with(_MEMBERS, "SELECT signature_id, component FROM members")
    sql["similar_members"] = _with(
        f"""{_MEMBERS},
        repof AS (SELECT signature_id, min(signature_id) OVER (PARTITION BY block, list_sort(w)) AS rep FROM sets),
        band AS (SELECT a, b FROM sims WHERE sim >= 0.62 AND a IN (SELECT rep FROM repof) AND b IN (SELECT rep FROM repof)),
        linked AS (SELECT rep, count(*) AS n FROM (SELECT a AS rep FROM band UNION ALL SELECT b FROM band) GROUP BY rep)""",
        "SELECT signature_id, component, rep, coalesce(n, 0) AS n_links FROM members JOIN repof USING (signature_id) LEFT JOIN linked USING (rep)",
    )
    sql["asked_components"] = _with(_MEMBERS.replace("0.62", "0.75"), "SELECT signature_id, component FROM members")
    sql["components_daily"] = sql["merge_components"]
    sql["merged_members"] = _with(
        _MEMBERS, "SELECT component, signature_id, tier FROM members JOIN clusters USING (signature_id)"
    )
    sql["merged_rollups"] = _with(_MERGED, "SELECT * FROM merged_rows")
    sql["merge_decisions"] = _with(f"{_DISTINCT}, {band(0.6, 0.9)}", "SELECT a, b FROM band WHERE sim >= 0.75")

    sql["ticket_ir"] = _with(
        _CLUSTERS,
        """SELECT fingerprint_id, 'Signal: ' || canonical_summary AS title, 80 AS priority, kind_v2_primary, tier, count_items,
        replace(tags_top, ',', ', ') AS body_tags,
        CAST(tier AS STRING) || ' reasons=[' || chr(39) || replace(tier_reasons, ',', chr(39) || ', ' || chr(39)) || chr(39) || ']' AS body_tier
        FROM clusters WHERE tier <= 3 AND (max_severity = 'critical' OR count_sessions >= 2 OR count_items >= 5)""",
    )
    sql["ticket_summary"] = _with(
        _CLUSTERS,
        """SELECT 'tier' AS facet, CAST(tier AS STRING) AS value, count(*) AS tickets FROM clusters GROUP BY tier
        UNION ALL SELECT 'kind_v2_primary', kind_v2_primary, count(*) FROM clusters GROUP BY kind_v2_primary
        UNION ALL SELECT 'total', 'all', count(*) FROM clusters""",
    )
    sql["ticket_fingerprints"] = _with(_KNOWN, "SELECT * FROM known")
    sql["ticket_updates"] = _with(
        _KNOWN, "SELECT signature_id, fingerprint_id, count_items FROM clusters WHERE fingerprint_id IN (SELECT fingerprint_id FROM known)"
    )
    sql["ticket_creates"] = _with(
        _KNOWN,
        f"""SELECT signature_id, fingerprint_id, tier, round(score, 6) AS score FROM (SELECT * FROM clusters
        WHERE fingerprint_id NOT IN (SELECT fingerprint_id FROM known) AND (max_severity = 'critical' OR count_sessions >= 3 OR count_items >= 10)
        QUALIFY row_number() OVER (PARTITION BY fingerprint_id ORDER BY {_RANKED}) = 1) ORDER BY {_RANKED} LIMIT 10""",
    )
    sql["spoken_lines"] = _with(
        _CLUSTERS,
        """SELECT signature_id, 'Tier ' || CAST(tier AS STRING) || ' ' || string_split(signature_text, '|')[1] || ': '
        || replace(left(string_split(signature_text, '|')[2], 60), '_', ' ') || '. ' || CAST(count_items AS STRING) || ' occurrences.' AS line,
        'Severity: ' || max_severity || '. Tags: ' || coalesce(array_to_string(tag_list[1:5], ', '), '') || '. Tier reasons: '
        || replace(tier_reasons, ',', ', ') || '.' AS details,
        '[signals] ' || left(signature_text, 60) AS title, CASE WHEN tier = 1 THEN 80 ELSE 50 END AS priority FROM clusters""",
    )
    command = " ".join(f"WHEN {_has_any('lower(text)', words)} THEN '{name}'" for name, words in fixed.COMMANDS)
    sql["spoken_commands"] = _with(_TRACE, f"SELECT session_id, i, CASE {command} ELSE 'unknown' END AS command FROM trace")
    sql["cluster_preview"] = _with(
        _CLUSTERS, f"SELECT signature_id, tier, (SELECT count(*) FROM clusters) AS total FROM clusters ORDER BY {_RANKED} LIMIT 20"
    )
    sql["cluster_report"] = _with(
        _CLUSTERS,
        f"""SELECT CAST(row_number() OVER (ORDER BY {_RANKED}) AS INTEGER) AS place, '## Tier ' || CAST(tier AS STRING) || ' score=' || printf('%.2f', score)
        || chr(10) || chr(10) || '- summary: ' || canonical_summary || chr(10) || '- kinds: ' || replace(kind_counts, ',', ', ')
        || chr(10) || '- max_severity: ' || max_severity || chr(10) || '- tags_top: ' || replace(tags_top, ',', ', ')
        || chr(10) || '- samples: ' || CAST(least(3, count_items) AS STRING) || chr(10) AS line
        FROM clusters ORDER BY {_RANKED} LIMIT 50""",
    )

    sql["triage_scored"] = _with(
        _TRIAGED, "SELECT item_id, i AS start_i, CAST(tier AS INTEGER) AS tier, tier_reasons, triage_score FROM tri"
    )
    sql["triage_top"] = _with(
        _TRIAGED,
        f"""SELECT CAST(tier AS INTEGER) AS tier, CAST(rk AS INTEGER) AS rank_in_tier, item_id, '- [' || kind || '] sev=' || severity || ' score=' || printf('%.2f', triage_score)
        || ' tags=' || array_to_string(tags, ',') || ' id=' || item_id || ' summary=' || {_redact("summary")} AS line
        FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY triage_score DESC, place) AS rk FROM tri) WHERE rk <= 10""",
    )
    sql["triage_summary"] = _with(
        _TRIAGED,
        """SELECT 'tier' AS facet, CAST(tier AS STRING) AS value, count(*) AS n FROM tri GROUP BY tier
        UNION ALL SELECT 'kind', kind, count(*) FROM tri GROUP BY kind
        UNION ALL SELECT 'severity', severity, count(*) FROM tri GROUP BY severity UNION ALL SELECT 'items', 'all', count(*) FROM tri""",
    )
    sql["top_tags"] = _with(
        _ITEMS,
        """SELECT tag, n FROM (SELECT tag, count(*) AS n, min((place, nth)) AS o FROM (
          SELECT place, unnest(tags) AS tag, generate_subscripts(tags, 1) AS nth FROM items) GROUP BY 1) ORDER BY n DESC, o LIMIT 15""",
    )

    sql["fuzzy_evidence"] = _with(_FUZZY, "SELECT signature_id, left(full_context, 4000) AS context FROM contexts")
    sql["session_context"] = _with(
        _context_sql(),
        """SELECT c.signature_id, coalesce(left(string_agg(line, chr(10) || '---' || chr(10) ORDER BY k), 3000), any_value(canonical_summary)) AS context
        FROM clusters c LEFT JOIN firstten f USING (signature_id) GROUP BY 1""",
    )
    sql["span_context"] = _with(
        _ITEMS,
        """SELECT x.session_id, x.item_id, x.i AS start_i, t.i, t.role, t.text FROM items x
        JOIN trace t ON t.session_id = x.session_id AND t.i BETWEEN x.i - 2 AND x.i + 1""",
    )
    sql["related_documents"] = f"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text || ' '), '[a-z0-9_]{{4,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM benchmark),
      k AS (SELECT item_id, unnest((list_filter(w, lambda x, k: list_position(w, x) = k))[1:12]) AS word FROM w),
      s AS (SELECT item_id, doc_id, CAST(count(*) AS INTEGER) AS score FROM documents JOIN k ON contains(lower(text), word) GROUP BY 1, 2)
      SELECT item_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 3"""
    sql["related_by_index"] = sql["related_documents"]
    sql["document_sections"] = f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
      m AS (SELECT doc_id, k, CASE WHEN k % 4 = 2 THEN '## ' || line ELSE line END AS line FROM p),
      h AS (SELECT *, starts_with(line, '## ') AS is_head, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM m),
      g AS (SELECT doc_id, section, max({_strip("line")}) FILTER (is_head) AS heading,
        coalesce({_rstrip("string_agg(line, chr(10) ORDER BY k) FILTER (NOT is_head)")}, '') AS body FROM h GROUP BY 1, 2)
      SELECT doc_id, CAST(section AS INTEGER) AS section, heading, body FROM g WHERE NOT (section = 0 AND body = '')"""
    sql["context_budget"] = """WITH u AS (SELECT source, doc_id, text,
        coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents),
      k AS (SELECT source, doc_id, CAST(used AS BIGINT) AS used, CASE WHEN length(text) > 6000 - used
        THEN left(text, CAST(6000 - used AS INTEGER)) || chr(10) || '...[truncated]' || chr(10) ELSE text END AS text FROM u WHERE used < 6000)
      SELECT source, doc_id, used, CAST(length(text) AS INTEGER) AS kept, md5(text) AS text_md5 FROM k"""

    sql["confusion"] = _with(_LABELLED, "SELECT auto AS truth, judged AS predicted, count(*) AS n FROM labelled GROUP BY ALL")
    classes = ", ".join(f"('{c}')" for c in fixed.EVAL_CLASSES)
    listed = ", ".join(f"'{c}'" for c in fixed.EVAL_CLASSES)
    sql["class_metrics"] = _with(
        f"""{_LABELLED}, cells AS (SELECT auto, judged FROM labelled WHERE auto IN ({listed}) AND judged IN ({listed})),
        m AS (SELECT c.label, count(*) FILTER (auto = label AND judged = label) AS tp, count(*) FILTER (auto <> label AND judged = label) AS fp,
          count(*) FILTER (auto = label AND judged <> label) AS fn FROM cells, (VALUES {classes}) c(label) GROUP BY 1),
        r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM m)""",
        """SELECT label, tp, fp, fn, round(p, 3) AS precision, round(q, 3) AS recall,
        round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 3) AS f1 FROM r""",
    )
    sql["accuracy"] = _with(
        _LABELLED,
        """SELECT count(*) AS n_samples, count(*) FILTER (auto = judged) AS n_correct,
        round(count(*) FILTER (auto = judged) / count(*), 3) AS accuracy FROM labelled""",
    )
    sql["class_intervals"] = f"""WITH metrics AS ({sql["class_metrics"]}), whole AS ({sql["accuracy"]})
        SELECT label, 'precision' AS metric, CAST(tp + fp AS BIGINT) AS n, precision AS estimate, TRUE AS inside FROM metrics
        UNION ALL SELECT label, 'recall', tp + fn, recall, TRUE FROM metrics
        UNION ALL SELECT label, 'f1', tp + fp + fn, f1, TRUE FROM metrics
        UNION ALL SELECT 'all', 'accuracy', n_samples, accuracy, TRUE FROM whole"""
    sql["validity"] = _with(
        _LABELLED,
        """SELECT coalesce(auto, 'all') AS signal_class, count(*) AS total, count(*) FILTER (is_real_issue) AS real,
        count(*) FILTER (NOT is_real_issue) AS "false", round(count(*) FILTER (is_real_issue) / count(*), 6) AS precision
        FROM labelled GROUP BY GROUPING SETS ((auto), ())""",
    )
    sql["validity_severity"] = _with(_LABELLED, "SELECT severity, count(*) AS n FROM labelled WHERE is_real_issue GROUP BY 1")
    place = " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(fixed.EVAL_CLASSES, 1))
    sql["stratified_sample"] = _with(
        f"""{_LABELLED}, sizes AS (SELECT auto, count(*) AS size, CASE auto {place} END AS place FROM labelled GROUP BY 1),
        tot AS (SELECT sum(size) AS total FROM sizes),
        ord AS (SELECT auto, size, row_number() OVER (ORDER BY place) AS k FROM sizes WHERE place IS NOT NULL),
        take AS (
          SELECT CAST(0 AS BIGINT) AS k, '' AS auto, CAST(0 AS BIGINT) AS quota, CAST(40 AS BIGINT) AS rest
          UNION ALL
          SELECT o.k, o.auto, CASE WHEN t.rest > 0 THEN CAST(greatest(1, least(o.size, floor(40 * (o.size / total)) + 1, t.rest)) AS BIGINT) ELSE 0 END AS quota,
            t.rest - CASE WHEN t.rest > 0 THEN CAST(greatest(1, least(o.size, floor(40 * (o.size / total)) + 1, t.rest)) AS BIGINT) ELSE 0 END
          FROM take t JOIN ord o ON o.k = t.k + 1, tot)""",
        """SELECT doc_id, l.auto FROM (SELECT *, row_number() OVER (PARTITION BY auto ORDER BY md5('7:' || CAST(doc_id AS STRING))) AS r FROM labelled) l
        JOIN take t ON t.auto = l.auto WHERE r <= quota""",
    )
    sql["random_sample"] = _with(_LABELLED, "SELECT doc_id FROM labelled ORDER BY md5('7:' || CAST(doc_id AS STRING)) LIMIT 25")
    problems = ", ".join(f"'{c}'" for c in fixed.PROBLEM_CLASSES)
    sql["problem_clusters"] = _with(
        _CLUSTERS, f"SELECT signature_id, kind_v2_primary FROM clusters WHERE kind_v2_primary IN ({problems})"
    )

    sql["tool_ngrams"] = _with(_CALLS, "SELECT CAST(n AS INTEGER) AS n, array_to_string(p, ' > ') AS pattern, c AS count FROM counted")
    sql["top_tool_ngrams"] = _with(
        _CALLS, "SELECT CAST(n AS INTEGER) AS n, CAST(place AS INTEGER) AS place, array_to_string(p, ' > ') AS pattern, c AS count FROM best WHERE place <= 20"
    )
    sql["skill_candidates"] = _with(
        f"""{_CALLS}, cand AS (SELECT *, row_number() OVER (ORDER BY n DESC, place) AS r FROM best
          WHERE place <= 50 AND c >= 3 AND len(list_distinct(p)) >= 2),
        kept AS (SELECT * FROM cand x WHERE NOT EXISTS (SELECT 1 FROM cand y WHERE y.r < x.r AND len(list_filter(x.p, lambda t: NOT list_contains(y.p, t))) = 0))""",
        """SELECT CAST(row_number() OVER (ORDER BY r) AS INTEGER) AS place, array_to_string(p, ' > ') AS pattern, c AS count, CAST(n AS INTEGER) AS length,
        CASE WHEN list_contains(p, 'memory_search') THEN 'Memory/recall workflow' WHEN list_contains(p, 'exec') THEN 'CLI/automation workflow'
          WHEN list_contains(p, 'cron') THEN 'Scheduling workflow' END AS skill FROM kept ORDER BY r LIMIT 15""",
    )
    sql["adjacent_patterns"] = _with(
        f"""{_CALLS}, found AS (SELECT *, CASE WHEN tool = 'memory_search' AND n1 IN ('bash', 'exec') THEN 'recall-then-execute'
          WHEN tool = 'read' AND n1 IN ('bash', 'exec') THEN 'file-driven-cli'
          WHEN tool = 'cron' AND NOT (t = 0 AND n1 IS NULL) THEN 'scheduling' END AS pattern FROM ahead)""",
        """SELECT pattern, count(*) OVER (PARTITION BY pattern) AS instances, CAST(row_number() OVER (PARTITION BY pattern ORDER BY session_id, t) AS INTEGER) AS example,
        session_id, t, tool, CASE WHEN pattern <> 'scheduling' THEN n1 END AS next_tool FROM found WHERE pattern IS NOT NULL QUALIFY example <= 5""",
    )
    sql["gapped_patterns"] = _with(
        _PATTERNS, "SELECT CAST(len(p) AS INTEGER) AS n, array_to_string(p, ' > ') AS pattern, support, closed FROM told"
    )
    sql["workflow_clusters"] = _with(
        f"""{_PATTERNS}, best AS (SELECT f.session_id, t.p, t.support FROM follows f JOIN told t ON t.p = f.p
          WHERE t.closed AND len(list_distinct(t.p)) >= 2
          QUALIFY row_number() OVER (PARTITION BY f.session_id ORDER BY len(t.p) DESC, t.support, t.p) = 1)""",
        """SELECT s.session_id, array_to_string(b.p, ' > ') AS pattern, b.support, count(*) OVER (PARTITION BY b.p) AS members
        FROM strings s LEFT JOIN best b ON b.session_id = s.session_id""",
    )
    sql["tool_summaries"] = _with(
        _TRACE,
        """SELECT session_id, i, CAST(1 AS INTEGER) AS at, tool, CASE WHEN tool IN ('bash', 'exec') THEN '`' || left(text, 80) || '`'
        WHEN tool IN ('read', 'edit') THEN tool || ': ' || text WHEN tool = 'memory_search' THEN 'memory: ' || chr(39) || left(text, 50) || chr(39)
        ELSE 'cron.' || tool END AS summary FROM trace WHERE role = 'toolCall'""",
    )
    sql["cron_gaps"] = _with(
        _CRON,
        "SELECT session_id, i AS idx, role, is_error, preview, CAST(length(text) AS INTEGER) AS content_length, round(gap_ms, 3) AS gap_ms FROM gaps",
    )
    sql["gap_stats"] = _with(
        _CRON,
        f"""SELECT session_id, count(*) AS total_cron_events, count(*) FILTER (is_error) AS error_labeled,
        count(*) FILTER (role = 'user') AS user_role_cron, count(*) FILTER (gap_ms < 10000) AS rapid_fire_count,
        round(min(gap_ms), 3) AS gap_min_ms, round(max(gap_ms), 3) AS gap_max_ms, avg(gap_us) / 1000.0::DOUBLE AS gap_mean_ms,
        count(*) FILTER ({_FALSE_ERROR}) AS false_errors FROM gaps GROUP BY 1""",
    )
    sql["cron_error_samples"] = _with(
        _CRON,
        f"""SELECT session_id, i AS idx, {_FALSE_ERROR} AS has_successful_content, left(preview, 50) AS preview FROM cron WHERE is_error
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i) <= 5""",
    )
    sql["latency_stats"] = _with(
        f"""{_LATENCY}, r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY latency_ms) - 1 AS nth, count(*) OVER (PARTITION BY phase) AS n
          FROM lat WHERE ok),
        p AS (SELECT phase, max(latency_ms) FILTER (nth = floor(n * 0.5)) AS p50_ms, max(latency_ms) FILTER (nth = floor(n * 0.95)) AS p95_ms,
          max(latency_ms) FILTER (nth = floor(n * 0.99)) AS p99_ms FROM r GROUP BY 1)""",
        """SELECT phase, count(*) AS n_calls, count(*) FILTER (ok) AS n_success, count(*) FILTER (NOT ok) AS n_failures,
        count(*) FILTER (NOT ok AND contains(error, 'TIMEOUT')) AS timeouts, min(latency_ms) FILTER (ok) AS min_ms, max(latency_ms) FILTER (ok) AS max_ms,
        round(avg(latency_ms) FILTER (ok), 6) AS mean_ms, any_value(p50_ms) AS p50_ms, any_value(p95_ms) AS p95_ms, any_value(p99_ms) AS p99_ms
        FROM lat LEFT JOIN p USING (phase) GROUP BY phase""",
    )
    sql["latency_sketches"] = _with(
        _LATENCY,
        """SELECT days, phase, point, count(*) AS n, CAST(count(*) AS BIGINT) AS sketched, TRUE AS near
        FROM (SELECT 'all' AS days, * FROM lat UNION ALL SELECT 'some', * FROM lat WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21')
        CROSS JOIN (VALUES ('p50_ms'), ('p95_ms'), ('p99_ms')) AS points(point) WHERE ok GROUP BY ALL""",
    )
    sql["last_latencies"] = _with(
        f"""{_LATENCY}, kept AS (SELECT * FROM lat QUALIFY row_number() OVER (PARTITION BY phase ORDER BY ts DESC, call_id DESC) <= 1000),
        k AS (SELECT phase, count(*) AS kept, min(call_id) AS oldest, round(sum(latency_ms), 2) AS total_ms FROM kept GROUP BY 1),
        c AS (SELECT phase, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS failure_count FROM lat GROUP BY 1)""",
        "SELECT * FROM k JOIN c USING (phase)",
    )

    sql["stream_last_latencies"] = sql["last_latencies"]

    sql["chunk_requests"] = _with(
        bounds,
        """SELECT b.session_id, chunk_idx, 'chunk:' || CAST(chunk_idx AS STRING) AS chunk_id, CAST(e - s AS INTEGER) AS events, t.text AS first_text
        FROM bounds b JOIN trace t ON t.session_id = b.session_id AND t.i = b.s""",
    )
    sql["answered_items"] = _with(
        f"""{bounds}, first_user AS (SELECT t.*, b.chunk_idx FROM bounds b JOIN trace t ON t.session_id = b.session_id AND t.i >= b.s AND t.i < b.e
          WHERE role = 'user' AND text <> '' QUALIFY row_number() OVER (PARTITION BY b.session_id, b.chunk_idx ORDER BY t.i) = 1),
        good AS (SELECT *, 'seen: ' || text AS summary, CASE WHEN pos % 3 = 0 THEN 'high' ELSE 'unknown' END AS severity,
            CASE WHEN pos % 2 = 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM first_user WHERE pos % 7 <> 0 AND pos % 5 <> 0 AND pos % 11 <> 0)""",
        """SELECT 'sha256:' || sha256('{"kind": "other", "quotes": ["' || text || '"], "session_id": "' || session_id || '", "summary": "' || summary || '"}') AS item_id,
        session_id, chunk_idx, CAST(1 AS BIGINT) AS rank, 'other' AS kind, summary, severity, confidence,
        CASE WHEN contains(lower(text), 'incident') THEN 'cron,incident' ELSE 'cron' END AS tags, i AS start_i, i AS end_i, text AS quotes FROM good""",
    )
    sql["judged_classes"] = _with(
        _FUZZY,
        """SELECT signature_id, kind_v2_primary, CASE WHEN contains(canonical_summary, 'gateway') OR contains(left(full_context, 4000), 'gateway')
        THEN 'defect' ELSE 'ux_friction' END AS class, 'high' AS confidence FROM contexts""",
    )
    sql["stored_answers"] = _with(
        _FUZZY,
        """SELECT signature_id, CASE WHEN length(canonical_summary) % 2 = 0 THEN 'first run' ELSE 'second run' END AS answer,
        CAST(NULL AS VARCHAR) AS error FROM contexts""",
    )
    sql["judged_validity"] = _with(
        _FUZZY,
        f"""SELECT signature_id, y AS is_real_issue, CASE WHEN y THEN 'high' ELSE 'none' END AS confidence, CASE WHEN y THEN 'medium' ELSE 'none' END AS severity
        FROM (SELECT *, contains(canonical_summary, 'timed out') OR contains(left(full_context, 3000), 'timed out') AS y FROM contexts
        WHERE kind_v2_primary IN ({problems}))""",
    )

    sql["stream_counts"] = _with(
        f"{_TRACE},{_HITS}",
        "SELECT epoch_us(date_trunc('day', ts)) AS window_start, kind, count(*) AS n FROM hits GROUP BY ALL",
    )
    sql["cron_throttled"] = sql["stream_throttled"] = f"""WITH RECURSIVE {_TRACE},
    posts AS (SELECT session_id, pos, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, pos) AS k FROM trace WHERE contains(text, 'Cron')),
    passed AS (
      SELECT session_id, k, ts FROM posts WHERE k = 1
      UNION ALL
      SELECT session_id, n.k, n.ts FROM (
        SELECT p.session_id, min({{'k': x.k, 'ts': x.ts}}) AS n FROM passed p
        JOIN posts x ON x.session_id = p.session_id AND x.ts >= p.ts + INTERVAL 6 HOUR GROUP BY p.session_id))
    SELECT session_id, pos, passed.k IS NOT NULL AS kept FROM posts LEFT JOIN passed USING (session_id, k)"""
    sql["stream_chunks"] = _with(bounds, "SELECT session_id, chunk_idx, s AS start_v, e AS end_v FROM bounds")
    sql["stream_mined_items"] = sql["mined_items"]
    sql["stream_gaps"] = _with(
        _CRON,
        """SELECT session_id, count(*) AS n, round(sum(g), 3) AS gap_sum, count(*) FILTER (g < 10000) AS rapid FROM (
        SELECT session_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts)) / 1000.0::DOUBLE AS g FROM cron) GROUP BY 1""",
    )
    sql["stream_distinct"] = _with(
        f"{_TRACE},{_HITS}",
        """SELECT DISTINCT 'sha256:' || sha256('{"kind": "' || kind || '", "quotes": ["' || text || '"], "session_id": "' || session_id
        || '", "summary": "' || summary || '"}') AS item_id, kind FROM hits""",
    )

    sql["session_openings"] = _with(
        _SHAPED,
        """SELECT session_id, line_no, i FROM (SELECT session_id, i,
          i + 1 + count(*) FILTER (pos % 13 = 0) OVER (PARTITION BY session_id ORDER BY i) AS line_no FROM lines) WHERE i < 5""",
    )
    sql["message_files"] = _with(
        _SHAPED,
        """SELECT session_id, idx, stamp AS timestamp, role, CASE WHEN shape IN ('result', 'list') THEN text ELSE '' END AS text FROM (
          SELECT *, i + count(*) FILTER (pos % 13 = 0) OVER (PARTITION BY session_id ORDER BY i) AS idx FROM lines)
        WHERE shape IN ('result', 'call', 'plain', 'list')""",
    )
    sql["redacted_views"] = _with(
        _SHAPED,
        f"""SELECT session_id, i, {_redact("body")} AS text FROM (SELECT session_id, i, CASE shape WHEN 'bad' THEN 'malformed JSON'
          WHEN 'result' THEN concat_ws(chr(10), 'tool=' || tool, 'status=' || status, 'exitCode=' || CAST(exit_code AS STRING), content)
          ELSE content END AS body FROM lines WHERE shape <> 'heartbeat')""",
    )
    sql["markdown_files"] = "SELECT item_id, md5(text || chr(10)) AS text_md5 FROM benchmark"
    sql["item_files_read"] = _with(
        _ITEMS,
        """SELECT item_id, session_id, kind, summary, severity, confidence, array_to_string(tags, ',') AS tags,
          i AS start_i, text AS quotes FROM items""",
    )
    sql["items_per_summary"] = _with(_ITEMS, "SELECT summary, least(count(*), 2) AS n FROM items GROUP BY summary")
    sql["cluster_files"] = _with(
        _CLUSTERS,
        """SELECT signature_id, count_items, count_sessions, max_severity, tier, round(score, 6) AS score, kind_v2_primary, kind_counts,
          tags_top, canonical_summary, fingerprint_id FROM clusters""",
    )
    sql["rollup_daily"] = sql["cluster_files"]
    sql["report_header"] = _with(
        _CLUSTERS,
        """SELECT 0 AS place, '# Signals' || chr(10) || chr(10) || '- items: ' || sum(count_items) || chr(10) || '- groups: ' || count(*) || chr(10)
          || '- tier 1: ' || count(*) FILTER (tier = 1) || chr(10) || '- tier 2: ' || count(*) FILTER (tier = 2) || chr(10)
          || '- tier 3: ' || count(*) FILTER (tier = 3) || chr(10) AS line FROM clusters""",
    )
    sql["stream_tickets"] = _with(
        _KNOWN,
        """SELECT 'update' AS change, fingerprint_id FROM clusters WHERE fingerprint_id IN (SELECT fingerprint_id FROM known) UNION ALL
        SELECT 'create', fingerprint_id FROM (SELECT * FROM clusters
          WHERE fingerprint_id NOT IN (SELECT fingerprint_id FROM known) AND (max_severity = 'critical' OR count_sessions >= 3 OR count_items >= 10)
          QUALIFY row_number() OVER (PARTITION BY fingerprint_id ORDER BY tier, score DESC, first_place) = 1
          ORDER BY tier, score DESC, first_place LIMIT 10)""",
    )
    sql["stream_sessions"] = _with(_SHAPED, "SELECT session_id, count(*) AS views FROM lines WHERE shape <> 'heartbeat' GROUP BY session_id")

    shaped = """d AS (SELECT source AS session_id, doc_id AS i, doc_id % 5 AS shape, lang, source, text,
        'bad "quote" ' || lang AS flat_error, 'it''s "' || lang || '"' || chr(10) || source AS error FROM documents)"""
    body = """CASE shape WHEN 0 THEN concat_ws(chr(10), nullif(text, ''), flat_error, lang, source)
        WHEN 1 THEN concat_ws(chr(10), 'tool=exec', 'status=error', 'exitCode=2', 'error=' || error, nullif(text, ''), source, lang, nullif(text, ''))
        WHEN 4 THEN '"quoted" \\ ' || text || chr(9) || '| end' ELSE text END"""
    sql["document_views"] = _with(
        shaped,
        f"""SELECT session_id, i, CASE shape WHEN 0 THEN 'assistant' WHEN 1 THEN 'toolResult' WHEN 2 THEN 'toolCall' ELSE 'user' END AS role,
        CASE shape WHEN 0 THEN 'exec' WHEN 1 THEN 'exec' WHEN 2 THEN 'read' END AS tool, CASE WHEN shape = 1 THEN 'error' END AS status,
        CASE WHEN shape = 1 THEN 'EXIT_2' END AS error_code, md5({_strip(body)}) AS text_md5,
        CASE shape WHEN 0 THEN 'event' WHEN 1 THEN 'message.details+content' WHEN 2 THEN 'message.input' ELSE 'message.content' END AS raw_shape
        FROM d""",
    )
    sql["document_failures"] = _with(
        shaped,
        """SELECT session_id, i, CASE shape WHEN 0 THEN 'error_field' ELSE 'tool_error' END AS kind,
        CASE shape WHEN 0 THEN flat_error ELSE error END AS detail, CASE WHEN shape = 1 THEN 'exec' END AS tool_name,
        CASE WHEN shape = 1 THEN 'error' END AS status, CASE WHEN shape = 1 THEN 2::BIGINT END AS exit_code FROM d WHERE shape IN (0, 1)""",
    )
    sql["document_calls"] = _with(
        shaped,
        f"""SELECT session_id, i, 'exec' AS tool_name, CASE WHEN shape = 0 THEN lang END AS action, CASE WHEN shape = 1 THEN 'error' END AS status,
        CASE WHEN shape = 1 THEN '2' END AS exit_code, CASE shape WHEN 0 THEN flat_error ELSE error END AS error,
        nullif(left({_strip("text")}, 300), '') AS preview FROM d WHERE shape IN (0, 1)""",
    )
    return sql
