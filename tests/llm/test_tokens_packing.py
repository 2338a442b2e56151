import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from signalmill.llm import packing, token_counts
from signalmill.llm.tokens import Encoder, vocabulary_path

from .cases import ODD, table

SMALL = Encoder(known_words=5)
LIBRARY = Tokenizer.from_file(vocabulary_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sT 9\n\t\r.!|é東  ​\x1c<|>endoftext"), max_size=40), max_size=8))
def test_encoder_is_the_library(texts):
    found = SMALL.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [ids_of(t) for t in texts]


def test_a_mark_behind_words_is_encoded_once():
    asked = []
    encoder = Encoder()
    encode = encoder.words.encode_ordinary
    known = type(encoder.later)(lambda x: asked.append(x) or encode(x), " ", 100)
    words = ["alpha.", "beta.", "gamma,", "delta.", "beta,"]
    assert [np.frombuffer(known[w], "<u4").tolist() for w in words] == [ids_of(" " + w) for w in words]
    assert asked.count(".") == 1 and asked.count(",") == 1


def test_special_token(spark):
    text = "a <|endoftext|> b<|endoftext|>"
    assert np.frombuffer(Encoder().encode([text])[0], "<u4").tolist() == ids_of(text)


def test_answers_for_every_limit(spark):
    rows = [(i, "word " * (i * 37 % 2500)) for i in range(60)] + ODD
    found = token_counts.answers(token_counts.lengths(table(spark, rows)), block=64).collect()
    sizes = [len(ids_of(t)) for _, t in rows]
    assert {r["length"]: r["n_docs"] for r in found} == Counter(sizes)
    for r in found:
        limit = r["length"]
        assert r["docs_at_least"] == sum(s >= limit for s in sizes)
        assert r["tokens_at_least"] == sum(s for s in sizes if s >= limit)
        assert r["docs_up_to"] == sum(s <= limit for s in sizes)
        assert r["truncated_tokens"] == sum(min(s, limit) for s in sizes)
        assert r["total_tokens"] == sum(sizes)
    assert token_counts.answers(token_counts.lengths(table(spark, []))).count() == 0


def check_packing(spark, rows, capacity=1024):
    found = packing.packed(packing.pieces(table(spark, rows).repartition(3), capacity=capacity, with_ids=True), capacity)
    got = found.collect()
    by_sequence, texts = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in by_sequence.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = Counter()
    for i, t in rows:
        ids = [*ids_of(t), 2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        wanted.update((i, p, a, b - a, tuple(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert wanted == Counter((r["doc_id"], r["piece"], r["start"], r["length"], tuple(r["ids"])) for r in got)
    whole = packing.sequences(found).collect()
    assert len(whole) == len(by_sequence)
    return len(by_sequence)


def test_packing(spark):
    check_packing(spark, [(i, "word " * (i * 37 % 2500)) for i in range(120)] + ODD)
    check_packing(spark, [(1, "")] * 9, 4)
    assert packing.packed(packing.pieces(table(spark, []))).count() == 0


def optimum(sizes, capacity):
    """Fewest sequences, by trying everything."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(sizes):
            return
        if i == len(sizes):
            best = min(best, len(rooms))
            return
        for room in set(rooms):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    random.seed(8)
    fixed_any = 0
    for _ in range(300):
        capacity = random.choice([10, 17, 30])
        sizes = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 9))), reverse=True)
        fixed, rest = packing.reduced(Counter(sizes), capacity)
        assert all(sum(p) <= capacity for p, _ in fixed)
        left = [s for s, n in rest.items() for _ in range(n)]
        fixed_any += bool(fixed)
        assert sum(n for _, n in fixed) + optimum(sorted(left, reverse=True), capacity) == optimum(sizes, capacity)
    assert fixed_any > 200


def best_fit_one_by_one(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - s)
    return len(rooms)


def test_best_fit_is_the_plain_one():
    random.seed(9)
    for _ in range(200):
        capacity = random.choice([10, 64])
        counts = Counter(random.choices(range(1, capacity + 1), k=random.randint(0, 120)))
        done = packing.best_fit(counts, capacity)
        used = Counter()
        for pattern, times in done:
            assert sum(pattern) <= capacity
            for s in pattern:
                used[s] += times
        assert used == counts
        assert sum(n for _, n in done) == best_fit_one_by_one(list(counts.elements()), capacity)
