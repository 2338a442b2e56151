import random
import re

import pytest

from signalmill.llm import secret_scan
from signalmill.llm.secret_scan import ANY, RULES, Rule, trigram_query

from .cases import ODD, table

# The contract's patterns, spelled out.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
ORDER = [r.kind for r in RULES]


def brute(text, rules=RULES):
    out = []
    for kind in [r.kind for r in rules]:
        regex, group, least = BASE.get(kind) or (next(r.regex for r in rules if r.kind == kind), 0, 0)
        for m in re.finditer(regex, text or ""):
            if len(m[group]) >= least:
                out.append((m.start(), ORDER.index(kind), kind, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(6)
    bits = [
        "password", "PassWd", "secret", "ToKeN", "api_key", "apikey", "API_KEY", "=", ": ", ' = "', "'", '"', " ", "\n",
        "AKIA", "ABCDEFGHIJ0123456", "abcdef0123456789", "deadbeef", "x" * 12, "short", "é東\U0001f600", "=secret=", "tok en",
        "ghp_" + "a1" * 20, "xoxb-1234567890-ab", "AIza" + "b" * 35, "sk_live_" + "9" * 16, "-----BEGIN RSA PRIVATE KEY-----",
        "eyJhbGciOiJI.eyJzdWIiOiIx.sig-x", "K", "ſecret=abcdefabcdef1",
    ]
    made = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(300)]
    return made + ["token: secret: abcdefghijklmnop", "token=secret=abcdefghijkl", "AKIAAKIA" + "Z" * 9, "AKIA" + "Z" * 14]


def test_against_brute_force(spark):
    rows = list(enumerate(texts())) + ODD
    # Many matches in one text reach over several blocks of positions.
    rows.append((9000, " ".join(f"token={'ab' * 8}{i}" for i in range(700))))
    found = secret_scan.secrets(table(spark, rows)).collect()
    got = sorted(repr((r["doc_id"], [tuple(s) for s in r["spans"]])) for r in found)
    assert got == sorted(repr((i, brute(t))) for i, t in rows)


def test_empty_table_and_scanning_rules_only(spark):
    assert secret_scan.secrets(table(spark, [])).count() == 0
    hexes = [r for r in RULES if r.kind == "hex"]
    found = secret_scan.secrets(table(spark, [(1, "x " + "ab" * 8), (1, None)]), hexes).collect()
    assert sorted(len(r["spans"]) for r in found) == [0, 1]


def test_queries_of_the_rules():
    query = {r.kind: trigram_query(r.regex) for r in RULES}
    assert query["hex"] == ANY
    assert query["access"] == {frozenset({"aki", "kia"})}
    assert frozenset({"tok", "oke", "ken"}) in query["assign"]
    assert all(query[r.kind] != ANY for r in RULES if r.kind != "hex")


@pytest.mark.parametrize(
    "regex", ["ab?cde+f", "(foo|barbaz)qux", "x[yz]{2}abc", "[a-z]+key", "(?:one|two)+three", "a{3,5}bcd", "pass(word)?", "..."]
)
def test_every_match_passes_its_query(regex):
    rng = random.Random(1)
    query, seen = trigram_query(regex), 0
    for _ in range(30_000):
        text = "".join(rng.choices(["a", "b", "c", "cde", "f", "foo", "barbaz", "qux", "x", "yz", "zy", "abc", "key", "one", "three", "bcd", "pass", "word"], k=6))
        m = re.search(regex, text)
        if m:
            seen += 1
            folded = m[0].lower()
            assert any(all(g in folded for g in s) for s in query), (m[0], query)
    assert seen


def test_own_rules(spark):
    rules = [Rule("word", r"alpha[0-9]+"), Rule("pair", r"k([a-z]+)", 3)]
    found = secret_scan.secrets(table(spark, [(1, "alpha12 kab kabc")]), rules).collect()
    assert [tuple(s) for s in found[0]["spans"]] == [(0, 0, "word", 7), (12, 1, "pair", 16)]
