import ast
import random

import numpy as np
import pyarrow as pa
import pytest

from signalmill.llm import line_dedup
from signalmill.llm.common import words

from .cases import LONG, ODD, table


def brute(rows):
    """(id, lines, removed lines) per row."""
    lines = sorted(
        {(i, t or "", k, frozenset(words(x))) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n"))},
        key=lambda x: (x[0], x[1], x[2]),
    )
    # One text per id in these tests, so ids and lines give the order.
    gone = set()
    for n, (i, t, k, s) in enumerate(lines):
        if s and any(5 * len(s & o) >= 4 * len(s | o) for _, _, _, o in lines[:n] if o):
            gone.add((i, t, k))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        out.append((i, len(own), [k for k in range(len(own)) if (i, t or "", k) in gone]))
    return sorted(map(repr, out))


def texts(seed, n):
    rng = random.Random(seed)
    common = ["the", "of", "and"]
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary if rng.random() < 0.7 else common) for _ in range(rng.choice([1, 2, 4, 5, 9, 30, 80, 300]))] for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1 + len(line) // 12])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "  ", ", "]).join(line))
            lines += rng.choice([[], [], [""], ["---"], ["the common line of all"]])
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("block", [400, 6])
def test_against_brute_force(spark, block):
    rows = texts(1, 60) + [(1000 + i if i is not None else None, t) for i, t in ODD]
    rng = random.Random(2)
    rng.shuffle(rows)
    found = line_dedup.removed_lines(table(spark, rows).repartition(3), block=block)
    got = sorted(repr((r["doc_id"], r["n_lines"], list(r["lines"]))) for r in found.collect())
    assert got == brute(rows)


def test_texts_without_the_lines(spark):
    rows = texts(3, 20) + [(500, None), (None, "the common line of all")]
    docs = table(spark, rows)
    left = line_dedup.without_lines(docs)
    assert left.columns == docs.columns
    gone = {r[0]: r[2] for r in map(ast.literal_eval, brute(rows)) if r[0] is not None}
    for r in left.collect():
        whole = dict(rows)[r["doc_id"]]
        if r["doc_id"] is None or whole is None:
            assert r["text"] == whole
        else:
            assert r["text"] == "\n".join(x for k, x in enumerate(whole.split("\n")) if k not in gone[r["doc_id"]])


def test_long_lines_and_empty_table(spark):
    found = {r["doc_id"]: r for r in line_dedup.removed_lines(table(spark, [(1, LONG), (2, LONG + " x"), (3, "x")])).collect()}
    assert [list(found[i]["lines"]) for i in (1, 2, 3)] == [[], [0], []]
    assert line_dedup.removed_lines(table(spark, [])).count() == 0


def test_bitmaps_never_bound_too_low():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 5, 60, 64, 65, 200, 256, 257, 1000)]
    sets += [np.unique(np.concatenate((s[: len(s) * 9 // 10 + 1], rng.integers(0, 2**63, 9, dtype=np.uint64)))) for s in sets]
    bits = line_dedup.Bitmaps(*zip(*map(line_dedup.bitmaps, sets), strict=True))
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    true = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)])
    found = bits.differences(a, b)
    assert (found <= true).all() and (found[true == 0] == 0).all()


def test_words_of_texts_as_the_plain_rule():
    rng = random.Random(4)
    parts = ["a", "B", "Word9", "ünï東京", "\U0001f600", "x" * 7, "x" * 8, "y" * 64, "y" * 65, "z" * 500, "\n", "\n\n", " ", "--", "\x00", "\t"]
    rows = [None, "", "\n", "a", "b\n", None, "", "B\na", " "] + ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)]
    for column, texts_in in ((pa.array(rows), rows), (pa.array(rows).slice(3, 200), rows[3:203])):
        own, of, line = line_dedup.text_words(column)
        plain = [(t, k, w) for t, x in enumerate(texts_in) for k, part in enumerate((x or "").split("\n")) for w in words(part)]
        assert [(t, k) for t, k, _ in plain] == list(zip(of.tolist(), line.tolist(), strict=True))
        pairs = {(w, h) for (_, _, w), h in zip(plain, own.tolist(), strict=True)}
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
        sets = line_dedup.line_sets(column)
        found = [(int(t), int(k), frozenset(sets.words[a:b].tolist())) for t, k, a, b in zip(sets.text, sets.line, sets.starts, sets.starts[1:], strict=False)]
        of_word = dict(pairs)
        true = {}
        for t, k, w in plain:
            true.setdefault((t, k), set()).add(of_word[w])
        assert found == [(t, k, frozenset(v)) for (t, k), v in true.items()]
        assert len({tuple(d) for d in sets.digests().tolist()}) == len({f for _, _, f in found})


def test_order_of_words_whose_sort_keys_tie():
    top = np.uint64(77) << np.uint64(32)
    own = np.array([top | np.uint64(5), top | np.uint64(3), top | np.uint64(5), np.uint64(1)], np.uint64)
    order = line_dedup._ordered(own, np.zeros(4, np.int64), np.zeros(4, np.uint8))
    assert own[order].tolist() == sorted(own.tolist())


def test_meeting_rows():
    rng = np.random.default_rng(3)
    key, sizes = np.sort(rng.integers(0, 40, 500)), rng.integers(1, 60, 500)
    order = np.lexsort((sizes, key))
    key, sizes = key[order], sizes[order]
    got = [x for a, b in line_dedup._meeting(key, sizes, 0.8) for x in zip(a.tolist(), b.tolist(), strict=True)]
    want = [(a, b) for a in range(500) for b in range(a + 1, 500) if key[a] == key[b] and 5 * sizes[a] >= 4 * sizes[b]]
    assert sorted(got) == want


def test_lines_of_texts():
    rows = [None, "", "a\nb", "\n", "ünï\n\nx", "", "last", None]
    for column, own in ((pa.array(rows), rows), (pa.array(rows).slice(2, 4), rows[2:6]), (pa.array([], pa.string()), [])):
        raw, of, line, begin, end = line_dedup.text_lines(column)
        found = [(int(t), int(k), raw[a:b].decode()) for t, k, a, b in zip(of, line, begin, end, strict=True)]
        assert found == [(t, k, x) for t, r in enumerate(own) for k, x in enumerate((r or "").split("\n"))]


@pytest.mark.parametrize("n", [0, 5, 40_000])
def test_filter_passes_its_members_and_few_others(spark, n):
    def keys(batch):
        return line_dedup.place_keys(*(c.to_numpy() for c in batch.columns))

    rows = spark.range(n).selectExpr("id", "xxhash64(id) AS text_hash", "cast(id % 7 AS int) AS line").repartition(3)
    bits = line_dedup.filter_of(rows, keys)
    assert 8 * len(bits) >= 16 * n
    if n:
        table = rows.toArrow().combine_chunks().to_batches()[0]
        assert line_dedup.passes(bits, keys(table)).all()
    others = spark.range(10**6, 10**6 + 20_000).selectExpr("id", "xxhash64(id) AS text_hash", "0 AS line").toArrow()
    assert line_dedup.passes(bits, keys(others.combine_chunks().to_batches()[0])).mean() < 0.03


def test_hot_words_are_counted_by_word(spark):
    # 3 and 3 + TABLE share a place; only the second one is hot.
    hot = 3 + line_dedup.TABLE
    sets = spark.createDataFrame([([3, k + 100],) for k in range(4)] + [([hot],)] * 9, "prefix array<int>").repartition(3)
    counts = line_dedup._listings(sets)
    assert counts[3] == 13
    word, blocks = line_dedup._hot_words(sets, counts, 5)
    assert word.tolist() == [hot] and blocks.tolist() == [2]
    assert line_dedup._hot_words(sets, counts, 50)[0].tolist() == []


def test_small_groups_are_verified_together_as_alone():
    rng = np.random.default_rng(8)
    groups, members = [], []
    for k in range(60):
        n, base = int(rng.integers(1, 9)), rng.choice(10**6, int(rng.integers(1, 160)), replace=False)
        sets = [np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 10**6, len(base)), base)).astype(np.uint64) for _ in range(n)]
        place = [int(x) for x in rng.permutation(n)]
        groups.append(
            pa.table({"words": pa.array([s.tobytes() for s in sets], pa.binary()), "line": place, "text_hash": place, "id": place,
                      "first": [0] * n, "second": [k % 2] * n, "side": pa.array(rng.integers(0, 2, n))})
        )
        members.append(n)
    starts = np.concatenate(([0], np.cumsum(members)))
    want = [int(at + x) for at, g in zip(starts, groups, strict=False) for x in line_dedup._later(g, 0.8)]
    assert want and line_dedup._later_in_few(pa.concat_tables(groups), np.array(members), 0.8).tolist() == want


def test_listings_come_out_of_their_buckets():
    rng = np.random.default_rng(9)
    records = np.zeros(500, line_dedup._RECORD)
    records["key"], records["node"] = rng.integers(0, 60, 500), np.arange(500)
    records["meta"], records["bits"] = rng.integers(1, 300, 500) << 33, rng.integers(0, 2**63, (500, 2))
    longer = {int(x["node"]): rng.integers(0, 2**63, 8).astype(np.uint64) for x in records if x["meta"] >> 33 > line_dedup.LONG}
    rows = pa.Table.from_batches([line_dedup._packed(records, np.stack([*longer.values()]), 7)])
    assert rows.column("bucket").to_pylist() == list(range(7))
    seen = []
    for k in range(7):
        found, bits = line_dedup._unpacked(rows.slice(k, 1))
        assert [(x["key"], x["meta"]) for x in found] == sorted((x["key"], x["meta"]) for x in records if x["key"] % 7 == k)
        for at, x in enumerate(found):
            assert bits.has[at] == (int(x["node"]) in longer) and (bits.bits[at] == records["bits"][x["node"]]).all()
            assert not bits.has[at] or (bits.more[bits.place[at]] == longer[int(x["node"])]).all()
        seen += found["node"].tolist()
    assert sorted(seen) == list(range(500))
