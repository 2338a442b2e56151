"""DuckDB twins of the queries that SQL can express.

Token counts, the quality classifier, packing and the random field have none:
byte-pair merges, zstandard and message passing are held against brute-force
versions in the tests.
"""

from __future__ import annotations

from signalmill.llm.license_scan import templates

# Words of whole texts: A-Z lowered, everything else as it is.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_NGRAM_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(w[i:i + 4], ' ')))) AS g
  FROM docs WHERE len(w) > 0),
hashed AS (SELECT doc_id, g, md5(array_to_string(g, ',')) AS s FROM grams),
sets AS (SELECT s, min(doc_id) AS rep, count(*) AS n_copies, any_value(g) AS g FROM hashed GROUP BY s),
parts AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM sets),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM parts a JOIN parts b ON a.x = b.x AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT rep AS node, rep AS seen FROM sets
  UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.seen),
class AS (SELECT node, min(seen) AS class_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links,
  coalesce(s.n_copies, 1)::BIGINT AS n_copies
FROM docs d LEFT JOIN hashed h ON h.doc_id = d.doc_id LEFT JOIN sets s ON s.s = h.s
LEFT JOIN class c ON c.node = s.rep LEFT JOIN degree g ON g.a = s.rep
"""

_DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size,
    unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS x
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS x
  FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, pos, d.size, item_id FROM doc_windows d JOIN item_windows i ON i.size = d.size AND i.x = d.x),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN marks USING (doc_id) LEFT JOIN found USING (doc_id)
"""

# kind, pattern, group that is measured, its least length.
_SECRETS = [
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]


def _secrets() -> str:
    kinds = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{regex}') AS hits,
          regexp_extract_all(t, '{regex}', {group}) AS parts, regexp_split_to_array(t, '{regex}') AS gaps FROM docs"""
        for k, (kind, regex, group, least) in enumerate(_SECRETS)
    )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds AS ({kinds}),
placed AS (
  SELECT doc_id, rank, kind, least, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[1:len(hits)]) AS gap,
    unnest(range(len(hits))) AS k FROM kinds),
summed AS (
  SELECT doc_id, rank, kind, hit, length(part) >= least AS long_enough,
    sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY k) - length(hit) AS start FROM placed),
spans AS (
  SELECT doc_id, rank, start, kind, kind || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT AS span
  FROM summed WHERE long_enough),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (doc_id)
"""


_LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS text FROM docs),
words AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS w FROM lines),
numbered AS (
  SELECT doc_id, line, w, row_number() OVER (ORDER BY doc_id, line) AS place, array_to_string(w, ' ') AS s FROM words WHERE len(w) > 0),
sets AS (SELECT s, min(place) AS first, any_value(w) AS w FROM numbered GROUP BY s),
parts AS (SELECT first, len(w) AS n, unnest(w) AS x FROM sets),
matched AS (
  SELECT DISTINCT later FROM (
    SELECT a.first AS earlier, b.first AS later FROM parts a
    JOIN parts b ON a.x = b.x AND a.first < b.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
    GROUP BY a.first, b.first, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*)))),
gone AS (
  SELECT doc_id, line FROM numbered JOIN sets USING (s) LEFT JOIN matched ON later = first
  WHERE place <> first OR later IS NOT NULL),
told AS (SELECT doc_id, count(*) AS n_removed, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed_lines FROM gone GROUP BY doc_id)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM docs LEFT JOIN told USING (doc_id)
"""


def _licenses() -> str:
    rows = ", ".join(f"({k}, '{licence}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (licence, text) in enumerate(templates()))
    words = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
    pairs = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    return rf"""
WITH known AS (SELECT template, licence, {words.format("text")} AS w FROM (VALUES {rows}) AS v(template, licence, text)),
terms AS (
  SELECT template, licence, size, x, count(*) AS times FROM (SELECT template, licence, len(w) - 1 AS size, unnest({pairs.format("w")}) AS x FROM known)
  GROUP BY ALL),
cut AS (
  SELECT doc_id, unnest(list_distinct(list_concat([text], regexp_split_to_array(text, '\n\s*\n'), string_split(text, chr(10))))) AS unit
  FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, unit, {words.format("unit")} AS w FROM cut),
grams AS (
  SELECT doc_id, unit, n, x, count(*) AS times FROM (SELECT doc_id, unit, len(w) - 1 AS n, unnest({pairs.format("w")}) AS x FROM units WHERE len(w) > 1)
  GROUP BY ALL),
scored AS (
  SELECT doc_id, unit, template, licence, 2.0::DOUBLE * sum(least(g.times, t.times)) / (n + size) AS dice
  FROM grams g JOIN terms t USING (x) GROUP BY doc_id, unit, n, template, licence, size),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, licence, template) AS place FROM scored WHERE dice >= 0.8)
SELECT doc_id, licence, count(*) AS n_units, max(dice) AS dice FROM best WHERE place = 1 GROUP BY doc_id, licence
"""


_EXACT_DEDUP = r"""
WITH docs AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents),
groups AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM docs GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM docs JOIN groups USING (s)
"""


# Unsigned CRC-32 of the decimal digits of an id, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, d: list_reduce(range(8),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, d)), 4294967295::BIGINT), 4294967295::BIGINT)"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return f"sha256({' || '.join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)})"


# All levels of all trees, one row per node; a proof is walked up level by level.
_MANIFEST = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claim FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM rows),
nodes AS (
  SELECT source, 0 AS level, i, n, leaf AS digest FROM numbered
  UNION ALL
  SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1
  GROUP BY source, level, i // 3, n),
subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3, n),
lower_runs AS (SELECT source, level, i // 3 AS run, list(digest ORDER BY i) AS members FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, i // 3 AS run, list(digest ORDER BY i) AS members FROM top WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT x.doc_id, x.leaf, l.level, members, x.i // (3 ** l.level)::BIGINT % 3 AS own
  FROM numbered x JOIN lower_runs l ON l.source IS NOT DISTINCT FROM x.source AND l.run = x.i // (3 ** (l.level + 1))::BIGINT
  UNION ALL
  SELECT x.doc_id, x.leaf, 1000 + u.level, members, s.i // (3 ** u.level)::BIGINT % 3 AS own
  FROM numbered x JOIN subroots s ON s.source IS NOT DISTINCT FROM x.source JOIN upper_runs u ON u.run = s.i // (3 ** (u.level + 1))::BIGINT),
paths AS (
  SELECT doc_id, leaf, list({{'l': array_to_string(members[1:own], ''), 'r': array_to_string(members[own + 2:], '')}} ORDER BY level) AS path
  FROM steps GROUP BY doc_id, leaf),
told AS (
  SELECT x.doc_id, x.leaf, x.claim, s.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root,
    coalesce(p.path, []) AS path
  FROM numbered x JOIN subroots s ON s.source IS NOT DISTINCT FROM x.source LEFT JOIN paths p ON p.doc_id = x.doc_id AND p.leaf = x.leaf)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) AS proof_sha256,
  list_reduce(list_transform(path, lambda p: {{'l': p.l, 'd': '', 'r': p.r}}), lambda a, p: {{'l': '', 'd': sha256(p.l || a.d || p.r), 'r': ''}},
    {{'l': '', 'd': claim, 'r': ''}}).d AS folded_root,
  folded_root = root AS verified
FROM told
"""

_TOP_K = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
placed AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM placed WHERE rank <= 5
"""

# Every lag of every pair of equal words, then the islands of each lag.
_PERIODIC_RUNS = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w, {_CRC} AS h, h // 10 AS g FROM documents),
bent AS (
  SELECT doc_id, w, h % 10 = 0 AND len(w) > 0 AS periodic, g % greatest(len(w), 1) AS a, 1 + (len(w) - a) // (3 + g % 8) AS p FROM docs),
made AS (
  SELECT doc_id, CASE WHEN periodic THEN list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM bent),
words AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x, len(w) AS n FROM made),
met AS (SELECT b.doc_id, b.i, b.i - a.i AS lag FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i AND 4 * (b.i - a.i) <= b.n),
islands AS (SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM met),
diagonals AS (SELECT doc_id, lag, min(i) - lag AS start, count(*) + lag AS length FROM islands GROUP BY doc_id, lag, island),
runs AS (SELECT doc_id, start, length, min(lag) AS period FROM diagonals WHERE length >= greatest(6, 4 * lag) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS longest FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, longest.s AS start, longest.l AS length, longest.p AS period,
  1000 * longest.l // longest.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM made LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def all_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": _NGRAM_JOIN,
        "op3_decontamination": _DECONTAMINATION,
        "op4_secrets": _secrets(),
        "op6_line_dedup": _LINE_DEDUP,
        "op7_licenses": _licenses(),
        "op10_exact_dedup": _EXACT_DEDUP,
        "op11_manifest": _MANIFEST,
        "op12_top_k": _TOP_K,
        "op13_periodic_runs": _PERIODIC_RUNS,
    }
