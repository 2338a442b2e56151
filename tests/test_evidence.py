"""Evidence joins against plain loops, with tiny blocks."""

import random
import re

import pytest

from signalmill.functions.fixed import STOPWORDS
from signalmill.operators import evidence


@pytest.mark.parametrize("block", [4, 400])
def test_matched_summaries(spark, block):
    rng = random.Random(block)
    words = [f"w{k}" for k in range(14)]
    items = [(" ".join(rng.sample(words, rng.randint(1, 8))), n) for n in range(150)]
    items += [("the same long phrase of all " + rng.choice(words), 200 + n) for n in range(60)] + [(None, 400)]
    clusters = [(f"c{n}", " ".join(rng.sample(words, rng.randint(2, 7)))) for n in range(20)] + [("c90", "the same long phrase"), ("c91", "")]
    first = {}
    for s, p in items:
        first.setdefault(s or "", p)
    wanted = set()
    for c, text in clusters:
        hits = sorted((p, s) for s, p in first.items() if len(set(s.split()) & set(text.split())) >= 3)
        wanted |= {(c, s, p) for p, s in hits[:5]}
    found = evidence.matched_summaries(
        spark.createDataFrame(clusters, "signature_id string, canonical_summary string"),
        spark.createDataFrame(items, "summary string, pos int"),
        limit=5,
        block=block,
    )
    assert {tuple(r) for r in found.collect()} == wanted and wanted


@pytest.mark.parametrize("block", [2, 100])
def test_related_documents(spark, block):
    rng = random.Random(1)
    words = [f"term{k}" for k in range(12)] + ["with", "from"]
    docs = [(f"p{n:02d}", " ".join(rng.choices(words, k=rng.randint(0, 6))).upper()) for n in range(40)] + [("p90", None), (None, "term1")]
    tickets = [(n, " ".join(rng.sample(words, 3)), rng.choice([None, "term1 xterm2x"])) for n in range(7)] + [(8, "", None), (9, "of", "")]
    wanted = set()
    for t, title, description in tickets:
        keys = [w for w in dict.fromkeys(re.findall("[a-z0-9_]{4,}", f"{title} {description or ''}".lower())) if w not in STOPWORDS][:12]
        scores = sorted((-sum(w in (x or "").lower() for w in keys), p) for p, x in docs if p is not None)
        wanted |= {(t, p, -s, k + 1) for k, (s, p) in enumerate(scores[:3]) if s}
    documents = spark.createDataFrame(docs, "path string, text string")
    asked = spark.createDataFrame(tickets, "ticket_id int, title string, description string")
    found = evidence.related_documents(documents, asked, block=block)
    assert {(r.ticket_id, r.path, r.score, r.place) for r in found.collect()} == wanted
    context = {r.ticket_id: r.context for r in evidence.related_context(found, documents, max_chars=30).collect()}
    assert set(context) == {w[0] for w in wanted}
    assert all(c.startswith("## p") for c in context.values())


def test_span_context_looks_behind_gaps(spark):
    views = spark.createDataFrame([("s", i, "user", f"t{i}") for i in range(0, 400, 3)], "session_id string, i bigint, role string, text string")
    refs = spark.createDataFrame([("s", "x", 10, 300)], "session_id string, item_id string, start_i bigint, end_i bigint")
    got = [r.i for r in evidence.span_context(refs, views).orderBy("i").collect()]
    assert got == list(range(9, 9 + 36, 3))
