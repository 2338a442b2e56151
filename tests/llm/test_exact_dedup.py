import hashlib
import re
from collections import defaultdict

from signalmill.llm import exact_dedup

from .cases import ODD, table


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if i is not None:
            groups[text].append(i)
    out = []
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        for k, i in enumerate(sorted(ids)):
            out.append((i, min(ids), len(ids), k == 0, sha))
    for i, t in rows:
        if i is None:
            sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
            out.append((None, None, 1, True, sha))
    return sorted(map(repr, out))


def check(spark, rows, parts, fan_in):
    df = table(spark, rows).repartition(parts) if rows else table(spark, rows)
    found = exact_dedup.copies(df, fan_in=fan_in)
    assert sorted(repr(tuple(r)) for r in found.collect()) == expected(rows)


def test_odd_rows(spark):
    check(spark, ODD, 3, 8)


def test_many_rounds_and_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 97}") for i in range(900, 0, -1)]
    check(spark, rows, 13, 2)


def test_empty(spark):
    check(spark, [], 1, 8)


def test_rows_that_stay(spark):
    docs = table(spark, ODD)
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in left.collect() if r["text"] is not None)
    assert [i for i, _ in ids] == [-1, 1, 5, 6, 7, 9]
    assert sorted(repr(r["doc_id"]) for r in left.collect() if r["text"] is None) == ["3", "None"]
