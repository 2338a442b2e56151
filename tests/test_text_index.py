"""The stored index against the scan of all texts."""

import random

import pytest

from signalmill.operators import evidence, text_index

DOCS = "path string, text string, lang string"


def made(seed=4, n=120):
    """Texts of which a third hold one word, words inside words, other scripts, empty and missing values."""
    rnd = random.Random(seed)
    words = [f"word{k}" for k in range(60)] + ["gate", "gateway", "gateways_x", "ünïgate9", "retry", "Retry_2", "東京tower", "ab", "x" * 500]
    out = []
    for k in range(n):
        own = rnd.choices(words, k=rnd.randint(0, 12)) + (["common"] if k % 3 == 0 else [])
        out.append((f"d{k:03}", rnd.choice([" ", ", ", "\n", "-"]).join(own), "en"))
    return [*out, ("none", None, "en"), (None, "gateway word1", "en"), ("empty", "", "de")]


def stored(spark, tmp_path, rows, buckets=8):
    root = str(tmp_path / "index")
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        text_index.add_documents(spark.createDataFrame(part, DOCS), root, buckets=buckets)
    return root


def test_documents_that_hold_a_word(spark, tmp_path):
    rows = made()
    root = stored(spark, tmp_path, rows)
    words = ["gate", "ateway", "way", "common", "xxxx", "tower", "word1", "absent", "ab", "retry_", "ünï", "x" * 501, None]
    found = text_index.matches(spark, root, spark.createDataFrame([(w,) for w in words], "word string"), 8)
    wanted = {(w, p) for w in words for p, t, _ in rows if w and len(w) > 2 and w.isascii() and p and t and w in t.lower()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


@pytest.mark.parametrize("limit", [1, 3, 500])
def test_related_documents_as_the_scan(spark, tmp_path, limit):
    rows = made()
    root = stored(spark, tmp_path, rows)
    rnd = random.Random(9)
    tickets = [(f"t{k}", " ".join(rnd.choices(["common", "gateway", "retry", "absent"] + [f"word{j}" for j in range(60)], k=rnd.randint(0, 14))), None) for k in range(30)]
    # All words in one document: its ticket is closed by the rarer half.
    tickets += [("same", rows[0][1].replace(",", " "), rows[3][1]), ("no", None, None), (None, "gateway", "")]
    asked = spark.createDataFrame(tickets, "ticket_id string, title string, description string")
    scan = evidence.related_documents(spark.createDataFrame(rows, DOCS), asked, limit)
    found = text_index.related_documents(spark, root, asked, limit, buckets=8)
    columns = ["ticket_id", "path", "score", "place"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, scan.select(columns).collect()))


@pytest.mark.parametrize("query", ["GATEWAY", "gate, word", "common", "word1 w", "ab", "東京", "no such", "xx"])
def test_search_as_the_scan(spark, tmp_path, query):
    rows = made()
    root = stored(spark, tmp_path, rows)
    docs = spark.createDataFrame([r for r in rows if r[0]], DOCS)
    found = text_index.search(spark, root, docs, query, buckets=8)
    assert found.columns == docs.columns
    assert sorted(r["path"] for r in found.collect()) == sorted(p for p, t, _ in rows if p and t and query.lower() in t.lower())


def test_only_folders_of_the_question_are_read(spark, tmp_path):
    root = stored(spark, tmp_path, made(), 64)
    wanted = spark.createDataFrame([("retry",)], "term string")
    schema = spark.read.parquet(f"{root}/columns").schema
    assert schema.names == ["term", "path"]
    plan = text_index._read(spark, f"{root}/postings", schema, wanted, "term", 64)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_empty_index(spark, tmp_path):
    root = stored(spark, tmp_path, [("a", "", "en"), ("b", None, "en")])
    words = spark.createDataFrame([("gate",)], "word string")
    assert text_index.matches(spark, root, words, 8).count() == 0


def test_tasks_follow_the_postings(spark, tmp_path, monkeypatch):
    # Joins and sorted writes get more tasks with more rows, so a task does not grow with the texts.
    monkeypatch.setattr(text_index, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(text_index, "TEXT_PER_TASK", 50)
    docs = [(k, f"alpha beta term{k}") for k in range(60)]
    text_index.add_documents(spark.createDataFrame(docs, "path bigint, text string"), str(tmp_path), buckets=8)
    found = text_index.matches(spark, str(tmp_path), spark.createDataFrame([("alp",), ("erm1",)], "word string"), 8)
    assert {tuple(r) for r in found.collect()} == {("alp", k) for k in range(60)} | {("erm1", k) for k in range(60) if f"term{k}".startswith("term1")}
    assert found.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
