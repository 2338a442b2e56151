"""Request and answer tables, and the streaming jobs."""

import json

from pyspark.sql import functions as F

from signalmill.operators import requests, signals
from signalmill.sources import sessions
from signalmill.streaming import live


def test_answers_are_validated(spark):
    views = spark.createDataFrame(
        [("s", i, i, "user", t) for i, t in enumerate(["say hello", "x" * 300, "incident here"])],
        "session_id string, i bigint, v bigint, role string, text string",
    )
    bounds = spark.createDataFrame([("s", 0, 0, 2), ("s", 1, 2, 3)], "session_id string, chunk_idx bigint, start_v bigint, end_v bigint")

    def item(event_i, quote, **more):
        return {"kind": " error ", "summary": "s" * 130, "evidence": [{"event_i": event_i, "quote": quote}], **more}

    first = [
        item(0, " hello ", severity=" HIGH ", confidence=0.9, tags=[" A ", "", "b" * 70]),
        item(1, "x" * 250, confidence=3),
        item(2, "incident"),  # a view of another chunk
        item(0, "not said"),
        {"kind": "error", "summary": "late proof", "evidence": [{"event_i": 0, "quote": "no"}] * 2 + [{"event_i": 0, "quote": "say"}]},
        {"kind": "nonsense", "summary": "x", "evidence": [{"event_i": 0, "quote": "say"}]},
    ]
    answers = [("s", 0, "Sure! " + json.dumps({"items": first}) + " bye"), ("s", 1, json.dumps({"items": [item(2, "incident")]})), ("s", 1, "none")]
    candidates = signals.answers_to_candidates(spark.createDataFrame(answers, "session_id string, chunk_idx bigint, answer string"))
    got = signals.validated(candidates, views, bounds).orderBy("chunk_idx", "rank").collect()
    assert [(r.chunk_idx, r.rank, r.span.start_i) for r in got] == [(0, 1, 0), (0, 2, 1), (1, 1, 2)]
    assert (got[0].severity, got[0].confidence, got[0].tags) == ("high", 0.9, ["a", "b" * 64])
    assert got[0].summary == "s" * 117 + "..." and got[0].evidence[0].role == "user" and got[0].evidence[0].quote == "hello"
    assert got[1].confidence == 0.5 and got[1].evidence[0].quote == "x" * 200 and got[1].severity == "unknown"
    assert got[2].tags == ["incident"]


def test_ask_keeps_rows_of_failing_calls(spark):
    asked = spark.createDataFrame([("a", "one"), ("b", "boom")], "id string, user string")

    def complete(system, user):
        if user == "boom":
            raise ValueError(user)
        return f"```json\n{{\"class\": \"defect\", \"confidence\": \"low\"}}\n``` {system}"

    answered = requests.ask(asked, complete).cache()
    assert {r.id: r.error for r in answered.collect()} == {"a": None, "b": "ValueError: boom"}
    assert tuple(requests.failed_requests(answered).first()) == (2, 1)
    got = {r.id: r for r in requests.class_answers(answered).collect()}
    assert (got["a"]["class"], got["a"].confidence, got["a"].reasoning) == ("defect", "low", "")
    assert (got["b"]["class"], got["b"].confidence) == ("unknown", "none")
    raw = [('{"is_real_issue": false}',), ("```\n{\"is_real_issue\": true, \"severity\": \"high\"}```",), ("??",)]
    judged = requests.validity_answers(spark.createDataFrame(raw, "answer string")).collect()
    assert [(r.is_real_issue, r.confidence, r.severity) for r in judged] == [(False, "low", "none"), (True, "low", "high"), (False, "none", "none")]


def test_session_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for n in range(2):
        (logs / f"{n}.jsonl").write_text(json.dumps({"message": {"role": "user", "content": f"hello {n}"}}) + "\n\nbad {\n")
        live.run_available(live.session_stream(spark, str(logs)), mark, live.parquet_writer(out), "append")
        rows = spark.read.parquet(out)
        assert rows.count() == 2 * (n + 1) and rows.filter("role = 'user'").count() == n + 1
    batch = sessions.read_sessions(spark, str(logs))
    assert {r.session_id for r in rows.collect()} == {r.session_id for r in batch.collect()}


def test_session_stream_in_batches_of_bytes(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for n in range(6):
        (logs / f"{n}.jsonl").write_text(json.dumps({"message": {"role": "user", "content": "hello" * 20}}) + "\n")
    size = (logs / "0.jsonl").stat().st_size
    for limit, batches in ((1 << 20, 1), (2 * size, 3)):
        out, mark = str(tmp_path / f"out{limit}"), str(tmp_path / f"mark{limit}")
        stream = live.session_stream(spark, str(logs), bytes_per_trigger=limit)
        live.run_available(stream, mark, live.parquet_writer(out), "append")
        rows = spark.read.parquet(out)
        assert rows.count() == 6 and rows.select("batch_id").distinct().count() == batches


def test_one_bad_entry_costs_one_entry(spark):
    from signalmill.operators import signals

    bodies = [
        '{"items": ["oops", 5, null, [1], {"kind": "other", "summary": "good", "tags": "x", "confidence": 0.7}]}',
        'text {"items": {"kind": "other"}} text',
        '{"items": [{"kind": "other", "summary": "a \\"b\\"\\n", "evidence": [{"event_i": 1, "quote": "q"}]}]',
        "none",
    ]
    answers = spark.createDataFrame([("s", n, b) for n, b in enumerate(bodies)], "session_id string, chunk_idx bigint, answer string")
    got = signals.answers_to_candidates(answers).collect()
    assert [(r.chunk_idx, r.item_no, r.kind, r.summary, r.tags, r.confidence) for r in got] == [(0, 5, "other", "good", None, 0.7)]


def test_ticket_writer(spark, tmp_path):
    from signalmill.operators import rollup

    items = spark.createDataFrame(
        [(f"i{n}", "s", kind, "gateway timeout", "high", ["incident"], n) for n, kind in enumerate(["error", "other"])],
        "item_id string, session_id string, kind string, summary string, severity string, tags array<string>, pos int",
    )
    items = items.withColumn("span", F.expr("named_struct('start_i', 0L, 'end_i', 1L)")).withColumn(
        "source", F.expr("named_struct('file_hint', 's', 'chunk_id', 'c')")
    )
    clusters = rollup.rollups(items).cache()
    known = clusters.filter("kind_v2_primary = 'ux_friction'").first().fingerprint_id
    tickets = spark.createDataFrame([(7, "p", "old", f"x {known} y", 1)], "id bigint, phid string, name string, description string, pos int")
    write = live.ticket_writer(lambda: tickets, str(tmp_path), min_sessions=1)
    for _ in range(2):  # a repeated batch replaces itself
        write(clusters, 0)
    assert [(r.ticket_id, r.fingerprint_id) for r in spark.read.parquet(str(tmp_path / "updates")).collect()] == [(7, known)]
    made = spark.read.parquet(str(tmp_path / "creates")).collect()
    assert [r.title for r in made] == ["Signal: gateway timeout"] and made[0].fingerprint_id != known
