import random
import re

import numpy as np

from signalmill.llm import pii_crf

from .cases import ODD, table


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += sum(divmod(2 * d, 10)) if k % 2 else d
    return total % 10 == 0


def brute(text):
    """The contract's rules as written."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(5)
    bits = [
        "a.b", "@", "x-1", ".com", "..", "me@site.org", "%+_", "12", "255", "256", ".", "1.2.3.4", "007", " ", "-", "--", "  ",
        "4111111111111111", "4111 1111 1111 1111", "49", "+", "+1", "(", ")", "555", "(017) 555-7713", "\n", "é\U0001f600", "9" * 14,
    ]
    made = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(4000)]
    return made + ["a@b@c.de", "a@@b.c", "@x.yz", "a@b.", "1.2.3.4.5.6.7.8", "+1" + "2" * 30, "+12", "+1-2", "+1 2 ("]


def test_rules():
    for text in texts():
        assert pii_crf.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    for c in ("1", "a", "a.", "+", "@", "1.", "1 ", "a@"):
        pii_crf.base_spans(c * 200_000)


def exact(weights, t):
    """Marginals by adding up all labellings."""
    n, size = len(t.spans), len(pii_crf.LABELS)
    unary = np.array([weights.shape[a] + weights.number[b] for a, b in t.features])
    total = np.zeros((n, size))
    for y in np.ndindex(*[size] * n):
        score = sum(unary[k, y[k]] for k in range(n))
        score += sum(weights.chain[y[a], y[b]] for a, b in t.chain) + sum(weights.skip[y[a], y[b]] for a, b in t.skip)
        for k in range(n):
            total[k, y[k]] += np.exp(score)
    return total / total.sum(1, keepdims=True)


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(1)
    size = len(pii_crf.LABELS)
    w = pii_crf.Weights(*(rng.normal(size=(n, size)) for n in (pii_crf.SHAPES, pii_crf.NUMBERS, size, size)))
    w.skip = w.skip + w.skip.T
    parts = [pii_crf.tokens(t, []) for t in ("call 12 34 word 77", "1 x 55 y 55", "a@b", "9999 c 9999 d 9999")]
    got, at = pii_crf.marginals(w, parts), 0
    for t in parts:
        assert np.allclose(got[at : at + len(t.spans)], exact(w, t), atol=2e-2)
        at += len(t.spans)


def trained(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        phone = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        rows.append((i, f"some words {phone} and {rng.randint(1, 99)} more" if i % 2 else f"in {rng.randint(1900, 2030)} we had {rng.randint(1, 9999)} of {rng.randint(1, 999)}"))
    return rows, pii_crf.fit(table(spark, rows))


def test_repeated_entities_are_added(spark):
    rows, weights = trained(spark)
    text = "call +1 (417) 555-7713 now, or 555-7713, or 12 of 1987"
    found = {r["doc_id"]: r for r in pii_crf.personal_data(table(spark, [(1, text), *[(10 + (i or 0), t) for i, t in ODD]]), weights).collect()}
    spans = [tuple(s) for s in found[1]["spans"]]
    at = text.index("555-7713,")
    assert (at, 3, "phone", at + 8) in spans
    assert [tuple(s) for s in found[1]["base"]] == [(5, 3, "phone", 22)]
    assert set(map(tuple, found[1]["base"])) <= set(spans) and len(spans) == 2


def test_base_spans_always_stay(spark):
    rows = list(enumerate(texts())) + ODD
    docs = table(spark, rows)
    found = pii_crf.personal_data(docs, pii_crf.fit(docs)).collect()
    got = sorted(repr((r["doc_id"], [(s["start"], s["rank"], s["end"]) for s in r["base"]])) for r in found)
    assert got == sorted(repr((i, brute(t))) for i, t in rows)
    for r in found:
        base, whole = ([tuple(s) for s in r[k]] for k in ("base", "spans"))
        assert set(base) <= set(whole) and whole == sorted(whole)
        assert not any(s[0] < b[3] and s[3] > b[0] for s in set(whole) - set(base) for b in base)


def test_training_does_not_depend_on_the_order_and_empty_table(spark):
    rows, weights = trained(spark)
    again = pii_crf.fit(table(spark, rows[::-1]).repartition(3))
    assert np.allclose(weights.shape, again.shape) and np.allclose(weights.chain, again.chain)
    empty = table(spark, [])
    assert pii_crf.personal_data(empty, pii_crf.fit(empty)).count() == 0


def test_repeats_are_found_in_the_documents_of_the_fit(spark):
    """Most phones repeat in a bare form that no rule sees; the same documents train and are scored."""
    rng = random.Random(7)
    rows, wanted = [], set()
    for i in range(1000):
        last, order = f"555-{rng.randint(1000, 9999)}", rng.randint(1000, 9999)
        text = f"call +1 ({rng.randint(200, 999)}) {last} about order {order} of {rng.randint(1, 99)} parts, order {order} is late"
        if i % 2:
            bare = last if i % 4 == 1 else last.replace("-", "")
            text += f" so please use {bare} today"
            at = text.rindex(bare)
            wanted.add((i, at, at + len(bare)))
        elif i % 20 == 0:
            text += f" or write to +1 (212) {last} today"
        rows.append((i, text))
    docs = table(spark, rows)
    weights = pii_crf.fit(docs)
    phone = pii_crf.LABELS.index("phone")
    assert weights.skip[phone, phone] > 1 > -1 > weights.skip[phone, 0]
    found = pii_crf.personal_data(docs, weights).collect()
    added = {(r["doc_id"], s["start"], s["end"]) for r in found for s in set(r["spans"]) - set(r["base"])}
    assert (len(wanted & added), len(added - wanted)) == (500, 0)


def test_evidence_reaches_all_repeats_of_a_long_text():
    """One base span, then 300 bare repeats: the marginals are those of the chain, to its end."""
    size = len(pii_crf.LABELS)
    w = pii_crf.Weights(*(np.zeros((n, size)) for n in (pii_crf.SHAPES, pii_crf.NUMBERS, size, size)))
    w.skip = np.where(np.eye(size) > 0, 6.0, -1.0)
    text = "+1 (417) 555-7713" + " and 555-7713 too" * 300
    t = pii_crf.tokens(text, pii_crf.base_spans(text))
    other = pii_crf.tokens("call 12 34 word 77", [])
    got = pii_crf.marginals(w, [other, t])[len(other.spans) :]
    step = np.exp(w.skip) / np.exp(w.skip).sum(1, keepdims=True)
    wanted = np.eye(size)[pii_crf.LABELS.index("phone")]
    for row in got[-300:]:
        wanted = wanted @ step
        assert np.allclose(row, wanted, atol=2e-2)
