"""Expressions over text: trimming, digests, tokens, signatures, keywords."""

from __future__ import annotations

from signalmill.functions.fixed import REDACTIONS, SALIENT, SEVERITY_RANK, STOPWORDS
from signalmill.functions.sql import Sql, each, keep, let, matches, no_texts, not_empty, pattern, text, texts

# Unicode white space plus the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"
_LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _replace(value: Sql, regex: str, by: str) -> Sql:
    return f"regexp_replace({value}, {pattern(regex)}, {text(by)})"


def strip(value: Sql) -> Sql:
    return _replace(value, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def rstrip(value: Sql) -> Sql:
    return _replace(value, rf"(?U){_SPACE}+\z", "")


def lstrip(value: Sql) -> Sql:
    return _replace(value, rf"(?U)\A{_SPACE}+", "")


def split_lines(value: Sql) -> Sql:
    return f"split({value}, {pattern(_LINE_BREAK)})"


def full_lines(value: Sql) -> Sql:
    """Stripped lines, blank ones left out."""
    return keep(each(split_lines(value), strip), not_empty)


def first_line(value: Sql) -> Sql:
    return f"{split_lines(value)}[0]"


def _cut(value: Sql, cut: Sql) -> Sql:
    return f"named_struct('text', {value}, 'cut', {cut})"


def truncated(value: Sql, limit: int) -> Sql:
    """struct<text, cut>: stripped text, shortened to `limit` with a trailing `...`."""
    if limit <= 0:
        return let(strip(value), lambda s: _cut("''", f"{s} <> ''"))
    return let(
        strip(value),
        lambda s: _cut(
            f"IF(length({s}) <= {limit}, {s}, concat({rstrip(f'left({s}, {limit - 3})')}, '...'))",
            f"length({s}) > {limit}",
        ),
    )


def truncate(value: Sql, limit: int) -> Sql:
    return f"{truncated(value, limit)}.text"


def _line_digest(value: Sql) -> Sql:
    def pick(lines: Sql) -> Sql:
        ends = f"IF(size({lines}) > 1, array({lines}[0], element_at({lines}, -1)), {lines})"
        salient = keep(lines, lambda line: matches(line, SALIENT))
        return strip(f"array_join(concat({ends}, array_except({salient}, {ends})), '\\n')")

    return let(full_lines(value), pick)


def digest(value: Sql, limit: int) -> Sql:
    """struct<text, cut>: short text as is; else first, last and salient lines; else head and tail."""
    half = limit // 2

    def head_tail(s: Sql) -> Sql:
        return truncated(f"concat({rstrip(f'left({s}, {half})')}, '\\n...\\n', {lstrip(f'right({s}, {half})')})", limit)

    def long_form(s: Sql) -> Sql:
        return let(_line_digest(s), lambda d: f"IF(length({d}) <= {limit}, {_cut(d, 'true')}, {head_tail(s)})")

    return let(strip(value), lambda s: f"IF(length({s}) <= {limit}, {_cut(s, 'false')}, {long_form(s)})")


def redact(value: Sql, strict: bool = False) -> Sql:
    """Replace personal data by placeholders.

    The order is part of the result. `strict` tries card numbers before phone
    numbers, so that a card in groups of four is not taken for two phones.
    """
    steps = list(REDACTIONS)
    if strict:
        steps = steps[:2] + [steps[7]] + steps[2:7]
    for regex, mark in steps:
        value = _replace(value, regex, mark)
    return value


def redacted_if_needed(value: Sql) -> Sql:
    """`redact`, skipping its eight scans for texts that hold none of the trigger characters."""
    risky = matches(value, r"(?U)[@\d/]|[0-9a-fA-F]{16}|sk-|xox|ghp_|AKIA")
    return f"IF({risky}, {redact(value)}, {value})"


def normalize(value: Sql) -> Sql:
    return f"trim({_replace(f'lower({value})', '[^a-z0-9]+', ' ')})"


def tokens(value: Sql) -> Sql:
    """Words without stopwords; all words if nothing else is left."""

    def chosen(words: Sql) -> Sql:
        useful = keep(words, lambda w: f"{w} NOT IN ({texts(STOPWORDS)})")
        return let(useful, lambda kept: f"IF(size({kept}) > 0, {kept}, {words})")

    return let(keep(f"split({normalize(value)}, ' ')", not_empty), chosen)


def bigrams(words: Sql) -> Sql:
    n = f"greatest(size({words}) - 1, 0)"
    pairs = f"zip_with(slice({words}, 1, {n}), slice({words}, 2, {n}), (a, b) -> concat(a, '_', b))"
    return f"IF(size({words}) < 2, {words}, {pairs})"


def gram_core(value: Sql) -> Sql:
    """The first six bigrams; they depend on the first seven words only."""
    return let(f"slice({tokens(value)}, 1, 7)", lambda words: f"array_join({bigrams(words)}, ' ')")


def tag_core(tags: Sql) -> Sql:
    return f"array_join({each(f'slice({tags}, 1, 5)', lambda t: f'lower(left({t}, 32))')}, ',')"


def signature_text(kind: Sql, summary: Sql, tags: Sql) -> Sql:
    named = f"coalesce(nullif({kind}, ''), 'unknown')"
    ordered = f"array_sort(array_compact(coalesce({tags}, {no_texts()})))"
    return f"concat(lower({strip(named)}), '|', {gram_core(f'''coalesce({summary}, '')''')}, '|', {tag_core(ordered)})"


def fingerprint_text(kind_v2: Sql, summary: Sql, ranked_tags: Sql) -> Sql:
    return f"concat({kind_v2}, '|', {gram_core(f'''coalesce({summary}, '')''')}, '|', {tag_core(ranked_tags)})"


def hashed(prefix: str, value: Sql) -> Sql:
    return f"concat({text(prefix)}, sha2({value}, 256))"


def session_key(relative_path: Sql) -> Sql:
    return hashed("sha256:", relative_path)


def severity_rank(severity: Sql) -> Sql:
    cases = " ".join(f"WHEN {text(name)} THEN {rank}" for name, rank in SEVERITY_RANK.items() if rank)
    return f"CASE lower({severity}) {cases} ELSE 0 END"


def jaccard(a: Sql, b: Sql) -> Sql:
    return (
        f"IF(size({a}) = 0 OR size({b}) = 0, 0.0D, "
        f"CAST(size(array_intersect({a}, {b})) AS DOUBLE) / size(array_union({a}, {b})))"
    )


def keywords(value: Sql, limit: int = 12) -> Sql:
    words = f"regexp_extract_all(lower({value}), '([a-z0-9_]{{4,}})', 1)"
    useful = keep(words, lambda w: f"{w} NOT IN ({texts(STOPWORDS)})")
    return f"slice(array_distinct({useful}), 1, {limit})"


def slug(value: Sql) -> Sql:
    dashed = _replace(f"lower({strip(value)})", "[^a-z0-9]+", "-")
    trimmed = _replace(dashed, r"\A-+|-+\z", "")
    return f"coalesce(nullif(left({trimmed}, 60), ''), 'brief')"


def white_words(value: Sql) -> Sql:
    """Distinct lower-case words between white space."""
    words = f"split(lower({strip(value)}), {pattern(rf'(?U){_SPACE}+')})"
    return f"array_distinct({keep(words, not_empty)})"


_SHORT_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def json_string(value: Sql) -> Sql:
    """Quoted JSON string, non-ASCII kept, control characters as lower-case `\\u00xx`."""

    def quoted(v: Sql) -> Sql:
        plain = f"replace(replace({v}, {text(chr(92))}, {text(chr(92) * 2)}), '\"', {text(chr(92) + chr(34))})"
        spelled = plain
        for code in range(0x20):
            escape = _SHORT_ESCAPES.get(code, f"\\u{code:04x}")
            spelled = f"replace({spelled}, char({code}), {text(escape)})"
        control = matches(v, r"[\x00-\x1f]")
        return f"concat('\"', IF({control}, {spelled}, {plain}), '\"')"

    return let(value, quoted)


def json_strings(values: Sql) -> Sql:
    return f"concat('[', array_join({each(values, json_string)}, ', '), ']')"
