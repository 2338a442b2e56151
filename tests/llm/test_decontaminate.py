import random
import re

import pytest

from signalmill.llm import decontaminate

from .cases import ODD, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, n=13):
    out = []
    for i, t in rows:
        w, marks, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            size = min(n, len(v))
            windows = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            for k in range(len(w) - size + 1):
                if size and tuple(w[k : k + size]) in windows:
                    marks.update(range(k, k + size))
                    found.add(item)
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(marks), found, bool(marks) and 20 * len(marks) >= len(w)))
    return sorted(map(repr, out))


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


random.seed(4)
VOCABULARY = [f"w{i}" for i in range(6)] + ["É", "ü9"]
ITEMS = [(i, " ".join(random.choices(VOCABULARY, k=random.choice([1, 3, 13, 14, 40])))) for i in range(12)]
ITEMS += [(3, ITEMS[3][1]), (None, "alpha beta gamma"), (50, None), (51, ""), (52, "!!"), (100, "same text")]
DOCS = [(i, ", ".join(random.choices(VOCABULARY, k=random.choice([0, 5, 60])))) for i in range(40)]
DOCS += [(100, "filler " * 300 + ITEMS[4][1]), (101, "ALPHA-beta\ngamma delta"), *ODD]


@pytest.mark.parametrize("block_words", [2_000_000, 200])
def test_against_brute_force(spark, block_words):
    found = decontaminate.report(table(spark, DOCS), items_table(spark, ITEMS), block_words=block_words)
    assert sorted(repr((r[0], r[1], r[2], list(r[3]), r[4])) for r in found.collect()) == brute(DOCS, ITEMS)


def test_documents_and_spans_go(spark):
    docs, items = table(spark, DOCS), items_table(spark, ITEMS)
    clean = [(i, t) for i, t in DOCS if not eval(brute([(i, t)], ITEMS)[0])[4]]
    left = decontaminate.without_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in left.collect()) == sorted(map(repr, clean))
    assert len(clean) < len(DOCS)
    cut = decontaminate.without_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    one = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert one[101] == "delta"
    assert one[100] == "filler " * 300
    assert one[3] is None


def test_empty_tables(spark):
    assert decontaminate.report(table(spark, []), items_table(spark, ITEMS)).count() == 0
    rows = decontaminate.report(table(spark, ODD), items_table(spark, [])).collect()
    assert len(rows) == len(ODD) and not any(r["contaminated"] for r in rows)


def test_blocks_keep_their_bound(spark):
    """Repeated rows count once and a long item is cut; the windows of all blocks are those of the items."""
    from signalmill.llm import decontaminate

    long = " ".join(f"w{k}" for k in range(1000))
    rows = [(1, "one two three " * 10)] * 300 + [(2, long), (3, "a b"), (None, "c d")]
    items = spark.createDataFrame(rows, "item_id int, text string")
    blocks = [[tuple(r) for r in b.collect()] for b in decontaminate._blocks(items, "item_id", "text", 13, 200)]
    assert len(blocks) > 5 and all(sum(len(t.split()) for _, t in b) <= 200 for b in blocks)

    def windows(listed):
        out = set()
        for item, text in listed:
            w = text.split()
            size = min(13, len(w))
            out |= {(item and str(item), tuple(w[k : k + size])) for k in range(len(w) - size + 1)}
        return out

    assert windows(r for b in blocks for r in b) == windows(rows)
