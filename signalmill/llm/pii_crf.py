"""Personal data by rules and a skip-chain conditional random field.

Rules give the base spans. The random field labels every token with a digit or
an @ sign as email, ip, card, phone or none. Neighbouring tokens share a chain
potential; tokens that repeat or have the same digits, however far apart, share
a skip potential, so that an entity which the rules see once is also found
where it stands in another form. Loopy message passing gives the marginals of
each document. A token that is surely an entity and lies outside the base spans
becomes an added span; base spans always stay.

The weights are trained on the documents themselves: the base spans are the
labels. A token outside them that repeats one inside is what the field has to
find, so it counts as unlabelled. Where the field is applied, the labels of
base spans are evidence. Tasks only hand on counts of (features, label) and of label pairs along
the two kinds of edges, over all documents; their number is bounded by the
feature space, not by the data.

All rules and features read a text in linear time, also one long run of digits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import texts_of

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
SHAPES = 8192
NUMBERS = 32
# A token needs this marginal to become an added span.
SURE = 0.9
# Advantage of none, in log odds, for a shape without examples.
UNSEEN = 4.0
# Messages of a text settle when none changes by more than this, in log odds.
SETTLED = 1e-3
# Rounds that a text may take beyond two for each of its edges, if its messages swing.
ROUNDS = 100
DAMPING = 0.5
# Log odds of the label of a base span, which is evidence.
GIVEN = 50.0
# Fewest digits by which two different tokens count as similar.
SAME_DIGITS = 4

_ACTIVE = re.compile("[0-9@]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
_TOKEN = re.compile(r"\S+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|[\W_]")
_EDGE = ".,;:!?\"'()[]{}<>|*#&$%"

# start, rank of the kind, end
Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[Span]:
    """Leftmost, not overlapping: the @ that a match needs is the first one after its start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        # The part after an @ is never part of an earlier, failed match.
        done = m.end() if m else at + 1
        if m:
            yield start, 0, m.end()
        at = text.find("@", max(done, at + 1))


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and passes_luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        # The match goes back to its last digit and needs a character before it.
        whole = m[0].rstrip(" ().-")
        if len(whole) >= 4 and 10 <= len(_digits(whole)) <= 15:
            out.append((m.start(), 3, m.start() + len(whole)))
    return sorted(out)


@dataclass
class Tokens:
    """Active tokens of one text: spans, features, label by the base spans, edges, and tokens that only repeat a labelled one."""

    spans: list[tuple[int, int]]
    features: list[tuple[int, int]]
    labels: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    tied: list[bool]


def _bucket(n: int) -> int:
    return min(n, 4) if n < 5 else 5 if n < 10 else 6 if n < 14 else 7


def _shape(core: str) -> int:
    parts = [f"9{_bucket(len(r))}{len(r) > 19}" if r[0] in "0123456789" else "a" if r[0].isalpha() else r for r in _RUN.findall(core)]
    return zlib.crc32("".join(parts).encode("utf-8", "replace")) % SHAPES


def tokens(text: str, base: list[Span]) -> Tokens:
    spans, cores = [], []
    for m in _TOKEN.finditer(text):
        if _ACTIVE.search(m[0]):
            start = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
            core = m[0].strip(_EDGE)
            if core:
                spans.append((start, start + len(core)))
                cores.append(core)
    near = [len(text[a[1] : b[0]].strip(_EDGE + " ")) == 0 and b[0] - a[1] <= 4 for a, b in zip(spans, spans[1:], strict=False)]
    chain = [(k, k + 1) for k, x in enumerate(near) if x]
    numbers = [_digits(c) for c in cores]
    features = []
    for core, digits in zip(cores, numbers, strict=True):
        luhn = 14 <= len(digits) <= 19 and passes_luhn(digits)
        lettered = any(c.isalpha() for c in core)
        features.append((_shape(core), 4 * _bucket(len(digits)) + 2 * lettered + luhn))
    labels, at = [], 0
    for start, end in spans:
        while at < len(base) and base[at][2] <= start:
            at += 1
        over = [s for s in base[at : at + 4] if s[0] < end and s[2] > start]
        labels.append(1 + over[0][1] if over else 0)
    skip, last = [], {}
    for k, (core, digits) in enumerate(zip(cores, numbers, strict=True)):
        earlier = {last.get(x) for x in _keys(core, digits)} - {None, k - 1 if k and near[k - 1] else None}
        skip += [(x, k) for x in sorted(earlier)]
        last.update(dict.fromkeys(_keys(core, digits), k))
    known = {x for core, digits, y in zip(cores, numbers, labels, strict=True) if y for x in _keys(core, digits)}
    tied = [not y and not known.isdisjoint(_keys(core, digits)) for core, digits, y in zip(cores, numbers, labels, strict=True)]
    return Tokens(spans, features, labels, chain, skip, tied)


def _keys(core: str, digits: str) -> list[tuple[str, str]]:
    return [("word", core.lower()), *([("digits", digits)] if len(digits) >= SAME_DIGITS else [])]


# Kinds of counted rows.
_UNARY, _CHAIN, _SKIP = range(3)
_COUNTS = "kind int, a int, b int, label int, n bigint"


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of features with labels, and of label pairs along chain and skip edges, over all texts.

    Tied tokens have no label and are left out, with their edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for whole in texts_of(batch, text):
                if _ACTIVE.search(whole):
                    t = tokens(whole, base_spans(whole))
                    found.update((_UNARY, *f, y) for f, y, tied in zip(t.features, t.labels, t.tied, strict=True) if not tied)
                    found.update((_CHAIN, t.labels[a], 0, t.labels[b]) for a, b in t.chain if not (t.tied[a] or t.tied[b]))
                    found.update((_SKIP, t.labels[a], 0, t.labels[b]) for a, b in t.skip if not (t.tied[a] or t.tied[b]))
        rows = np.array([(*k, n) for k, n in found.items()], np.int64).reshape(-1, 5).T
        columns = [pa.array(x.astype(np.int32)) for x in rows[:4]] + [pa.array(rows[4])]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "label", "n"])

    done = docs.select(F.col(text)).mapInArrow(run, _COUNTS)
    return done.groupBy("kind", "a", "b", "label").agg(F.sum("n").alias("n"))


@dataclass
class Weights:
    shape: np.ndarray
    number: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _lift(pairs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """How much more often two labels meet than by chance, as a bounded log."""
    pairs = pairs + prior
    chance = pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / pairs.sum()
    return np.clip(np.log(pairs / chance), -4, 4)


def train(rows: list[tuple[int, int, int, int, int]], steps: int = 400) -> Weights:
    """Piecewise training: a logistic model of the features, and the lift of label pairs on each kind of edge."""
    rows = np.array(rows, np.int64).reshape(-1, 5)
    rows = rows[np.lexsort(rows.T[::-1])]
    size, unary = len(LABELS), rows[rows[:, 0] == _UNARY]
    pairs = []
    for kind in (_CHAIN, _SKIP):
        own, table = rows[rows[:, 0] == kind], np.zeros((size, size))
        np.add.at(table, (own[:, 1], own[:, 3]), own[:, 4])
        pairs.append(table)
    # A shape that was never seen leans to none.
    means = [np.zeros((n, size)) for n in (SHAPES, NUMBERS)]
    means[0][:, 0] = UNSEEN
    w = [x.copy() for x in means]
    speed = [np.zeros_like(x) for x in w]
    where, label, n = unary[:, 1:3].T, unary[:, 3], unary[:, 4].astype(float)
    aim = np.eye(size)[label]
    for step in range(steps if len(unary) else 0):
        chance = np.exp(_log_softmax(sum(x[i] for x, i in zip(w, where, strict=True))))
        pull = (aim - chance) * n[:, None]
        for x, mean, s, i in zip(w, means, speed, where, strict=True):
            slope = 0.05 * (mean - x)
            np.add.at(slope, i, pull)
            s *= 0.9
            s += 0.1 * slope**2
            x += 0.3 * 0.99**step * slope / (np.sqrt(s) + 1e-6)
    # Where no text repeats a token, similar tokens still lean to the same label.
    flat, same = np.full((size, size), 0.5), np.eye(size) * 4
    return Weights(*w, _lift(pairs[0], flat), _lift(pairs[1] + pairs[1].T, flat + same))


def marginals(weights: Weights, parts: list[Tokens]) -> np.ndarray:
    """Label probabilities of all tokens of some texts, by loopy message passing. Labels of base spans are given."""
    features = np.array([f for t in parts for f in t.features], np.int64).reshape(-1, 2).T
    shape = weights.shape[features[0]]
    # A tied token brings evidence of its own; a shape without examples says nothing about it.
    tied = np.array([x for t in parts for x in t.tied], bool)
    shape[tied & (shape == UNSEEN * (np.arange(len(LABELS)) == 0)).all(axis=1)] = 0
    unary = _log_softmax(shape + weights.number[features[1]])
    given = np.array([y for t in parts for y in t.labels], np.int64)
    unary[given > 0] = np.where(np.eye(len(LABELS))[given[given > 0]] > 0, 0.0, -GIVEN)
    before = np.cumsum([0] + [len(t.spans) for t in parts])
    edges, potential, text = [], [], []
    for kind, table in (("chain", weights.chain), ("skip", weights.skip)):
        own = [(a + k, b + k) for t, k in zip(parts, before, strict=False) for a, b in getattr(t, kind)]
        edges += own
        text += [k for k, t in enumerate(parts) for _ in getattr(t, kind)]
        potential += [table] * len(own)
    if not edges:
        return np.exp(unary)
    a, b = np.array(edges, np.int64).T
    table = np.array(potential)
    # Every edge in both directions; the reverse of message k is k + E modulo 2E.
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    table = np.concatenate((table, table.transpose(0, 2, 1)))
    text = np.array(text)
    last = 2 * np.bincount(text) + ROUNDS
    text = np.concatenate((text, text))
    back = np.roll(np.arange(2 * len(a)), len(a))
    message = np.zeros((2 * len(a), len(LABELS)))
    # Texts leave once settled; their messages stay.
    moving, turn = np.arange(2 * len(a)), 0
    while len(moving):
        turn += 1
        belief = unary.copy()
        np.add.at(belief, target, message)
        sent = (belief[source[moving]] - message[back[moving]])[:, :, None] + table[moving]
        top = sent.max(axis=1, keepdims=True)
        fresh = _log_softmax(np.log(np.exp(sent - top).sum(axis=1)) + top[:, 0])
        change = np.zeros(len(last))
        np.maximum.at(change, text[moving], np.abs(fresh - message[moving]).max(axis=1))
        message[moving] = DAMPING * message[moving] + (1 - DAMPING) * fresh
        moving = moving[((change > SETTLED) & (turn < last))[text[moving]]]
    belief = unary.copy()
    np.add.at(belief, target, message)
    return np.exp(_log_softmax(belief))


def added_spans(t: Tokens, chance: np.ndarray, base: list[Span], sure: float = SURE) -> list[Span]:
    """Spans of neighbouring tokens of one sure label that touch no base span."""
    label = chance.argmax(axis=1)
    label[chance.max(axis=1) < sure] = 0
    linked, out = {b for _, b in t.chain}, []
    for k, (start, end) in enumerate(t.spans):
        if not label[k] or t.labels[k]:
            continue
        rank = int(label[k]) - 1
        if out and k in linked and label[k - 1] == label[k] and out[-1][2] == t.spans[k - 1][1]:
            out[-1] = (out[-1][0], rank, end)
        else:
            out.append((start, rank, end))
    return [s for s in out if not any(s[0] < e and s[2] > b for b, _, e in base)]


_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
_SPANS = "array<struct<start: int, rank: int, kind: string, end: int>>"


def personal_data(docs: DataFrame, weights: Weights, id: str = "doc_id", text: str = "text", sure: float = SURE) -> DataFrame:
    """Per row: id, base and spans (base and added), arrays of (start, rank, kind, end) in order.

    Offsets are code points, the end is exclusive. A NULL or empty text has no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(weights).values()))

    def as_rows(spans: list[Span]) -> list[dict]:
        return [{"start": s, "rank": k, "kind": KINDS[k], "end": e} for s, k, e in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(*shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            base: list[list[Span]] = [[] for _ in texts]
            whole: list[list[Span]] = [[] for _ in texts]
            active = [k for k, x in enumerate(texts) if _ACTIVE.search(x)]
            for k in active:
                base[k] = base_spans(texts[k])
            parts = [tokens(texts[k], base[k]) for k in active]
            chance = marginals(own, parts) if parts else np.zeros((0, len(LABELS)))
            at = 0
            for k, t in zip(active, parts, strict=True):
                end = at + len(t.spans)
                whole[k] = base[k] + added_spans(t, chance[at:end], base[k], sure)
                at = end
            columns = [pa.array([as_rows(x) for x in spans], pa.list_(_SPAN)) for spans in (base, whole)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "base", "spans"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, base {_SPANS}, spans {_SPANS}").withColumnRenamed("id", id)


def fit(docs: DataFrame, text: str = "text") -> Weights:
    """Weights from the counts of all documents. Their rows are bounded by the feature space."""
    return train([tuple(r) for r in counts(docs, text).collect()])
