"""Item files, cluster files, Markdown documents, reports."""

import json

import pytest
from pyspark.sql import functions as F

from signalmill.operators import rollup, tickets
from signalmill.sources import documents as docs
from signalmill.sources import items as item_files

ITEM = {
    "schema_version": 1, "item_id": "sha256:1", "session_id": "s1", "source": {"file_hint": "s1", "chunk_id": "s1/chunk:0"},
    "kind": "error", "summary": "gateway timeout", "severity": "high", "confidence": 0.4, "tags": ["incident"],
    "span": {"start_i": 3, "end_i": 4}, "evidence": [{"event_i": 3, "role": "user", "field_path": "text", "quote": "é"}],
    "proposed_fix": None,
}


@pytest.fixture()
def item_file(tmp_path):
    rows = [ITEM, ITEM | {"item_id": "sha256:2", "session_id": "s2", "severity": "low", "tags": ["b", "incident"]}, ITEM | {"kind": "user_delight", "summary": "nice"}]
    path = tmp_path / "items.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    return path


def test_items_round_trip(spark, item_file, tmp_path):
    items = item_files.read_items(spark, str(item_file))
    item_files.write_items(items, str(tmp_path / "out"))
    back = item_files.read_items(spark, str(tmp_path / "out"))
    assert back.drop("pos").exceptAll(items.drop("pos")).count() == 0 and back.count() == 3
    assert "é" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_bad_lines(spark, item_file):
    item_file.write_text(item_file.read_text() + "{bad\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        item_files.read_items(spark, str(item_file)).collect()
    assert item_files.read_items(spark, str(item_file), strict=False).count() == 3


def test_clusters_report_and_ticket(spark, item_file):
    clusters = rollup.rollups(item_files.read_items(spark, str(item_file))).cache()
    top = rollup.in_rank_order(clusters).first()
    assert (top.tier, top.tier_reasons, top.max_severity, top.count_items) == (1, ["incident", "severity:high"], "high", 1)
    lines = [r.line for r in item_files.cluster_report(clusters).orderBy("place").collect()]
    assert len(lines) == 3 and lines[0].startswith("## Tier 1 score=5.99\n\n- summary: gateway timeout\n- kinds: error:1")
    body = tickets.ticket_ir(clusters).orderBy("tier", F.desc("score")).first().body
    assert "span={'start_i': 3, 'end_i': 4} source={'file_hint': 's1', 'chunk_id': 's1/chunk:0'}" in body
    assert "kind_v2: {'reliability_perf': 1}\n" in body and "reasons=['incident', 'severity:high']" in body


def test_cluster_file(spark, tmp_path):
    row = {
        "signature_id": "sig1:a", "signature_text": "error|x|", "kind_v2_counts": {"ux_friction": 2, "defect": 2},
        "tags_top": [["incident", 3], ["b", 1]], "tier": 1, "score": 2.5, "count_items": 4, "canonical_summary": "x",
    }
    for key in ("rollups", "clusters"):
        path = tmp_path / f"{key}.json"
        path.write_text(json.dumps({key: [row, row | {"signature_id": "sig1:b", "kind_v2_counts": {}}]}, indent=1))
        got = item_files.read_clusters(spark, str(path)).orderBy("first_pos").collect()
        assert [r.signature_id for r in got] == ["sig1:a", "sig1:b"]
        assert got[0].kind_v2_primary == "ux_friction" and got[1].kind_v2_primary == "unknown"
        assert [(t.value, t.n) for t in got[0].tags_top] == [("incident", 3), ("b", 1)]


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.md").write_text("intro\n\n## First \nbody a\r\nbody b\n\n## Second\n### not a section\n")
    (tmp_path / "two.md").write_text("## Only\n")
    (tmp_path / "x.txt").write_text("no")
    read = docs.read_documents(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([a-z]+)[.]md", 1))
    got = [(r.path, r.section, r.heading, r.body) for r in docs.sections(read).orderBy("path", "section").collect()]
    assert got == [
        ("one", 0, None, "intro"), ("one", 1, "## First", "body a\nbody b"), ("one", 2, "## Second", "### not a section"),
        ("two", 1, "## Only", ""),
    ]
    rows = spark.createDataFrame([("k", n, "x" * 10) for n in range(5)] + [("l", 0, "short")], "k string, n int, text string")
    packed = {(r.k, r.n): r.text for r in docs.packed(rows, 25, ["k"], ["n"]).collect()}
    assert packed == {("k", 0): "x" * 10, ("k", 1): "x" * 10, ("k", 2): "x" * 5 + docs.CUT_MARK, ("l", 0): "short"}
