"""Hand-written session files with every row shape."""

import json

import pytest

from signalmill.operators import events, inspect
from signalmill.sources import sessions

LONG = "\n".join(["start of run", *[f"filler line {i} " + "x" * 40 for i in range(30)], "fatal error: disk", "last line"])
LINES = [
    json.dumps({"type": "session", "id": "x"}),
    "",
    '{"broken": ',
    "[1, 2]",
    "17",
    json.dumps({"type": "message", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hello there"}}),
    json.dumps({"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, "b", {"type": "thinking", "n": 1}, 5, None]}}),
    json.dumps({"type": "message", "message": {"role": "toolResult", "toolName": "", "toolCallId": "c1", "content": [{"type": "text", "text": "out"}], "details": {"status": 3, "exitCode": 2, "stderr": "bad"}}}) + "\r",
    json.dumps({"message": {"role": "toolResult", "toolName": "exec", "details": {"status": "error", "error": {"m": 1}}, "content": "c"}}),
    json.dumps({"message": {"role": "toolCall", "toolName": "read", "input": {"action": "open", "output": "payload"}}}),
    json.dumps({"tool": "bash", "status": "ok", "exitCode": 0, "input": {"action": "run"}, "content": "killed by signal", "error": ""}),
    json.dumps({"type": "tool_call", "name": "web", "error": "boom", "code": "E7"}),
    json.dumps({"role": "system", "text": LONG}),
    json.dumps({"type": "noise"}),
    json.dumps({"type": "message", "message": {"role": "user", "content": {"text": "", "stdout": "from dict"}}}),
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    (base / "sub dir").mkdir()
    (base / "a.jsonl").write_text("\n".join(LINES) + "\n")
    (base / "sub dir" / "b+c.jsonl").write_text("\n".join(json.dumps({"role": "user", "content": f"n{i}"}) for i in range(5)))
    (base / "skip.jsonl").write_text('{"role": "user", "content": "skipped"}\n')
    (base / "note.txt").write_text("not a session")
    return str(base)


@pytest.fixture(scope="module")
def read(spark, root):
    return sessions.read_sessions(spark, root, include=["*.jsonl"], exclude=["sk?p*"]).cache()


def test_discovery_and_numbering(spark, root, read):
    rows = read.orderBy("rel_path", "i").collect()
    assert sorted({r.rel_path for r in rows}) == ["a.jsonl", "sub dir/b+c.jsonl"]
    a = [r for r in rows if r.rel_path == "a.jsonl"]
    assert [r.line_no for r in a] == [n for n in range(1, len(LINES) + 1) if n != 2]
    assert [r.i for r in a] == list(range(len(a)))
    assert [r.line_no for r in a if r.parse_error] == [3] and a[1].raw == '{"broken":'
    assert sessions.read_sessions(spark, root, max_sessions=1).select("rel_path").distinct().collect()[0][0] == "a.jsonl"
    assert sessions.read_sessions(spark, root, max_events=2).filter("rel_path = 'a.jsonl'").count() == 2


def test_excluded_files_are_not_opened(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"s{k:02d}.jsonl.gz").write_bytes(b"no gzip at all")
    (tmp_path / "ok.jsonl").write_text('{"role": "user", "content": "x"}\n')
    options = {"name_glob": "*.jsonl*"}
    assert sessions.read_sessions(spark, str(tmp_path), include=["ok*"], **options).count() == 1
    assert sessions.read_sessions(spark, str(tmp_path), exclude=["s*"], **options).count() == 1
    assert sessions.read_sessions(spark, str(tmp_path), max_sessions=1, **options).count() == 1
    with pytest.raises(Exception, match="(?i)gzip|gz|not in"):
        sessions.read_sessions(spark, str(tmp_path), include=["s03*"], **options).count()


def test_files_are_opened_once(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"s{k}.jsonl").write_text('{"role": "user", "content": "x"}\n\nbad {\n')
    read = sessions.read_sessions(spark, str(tmp_path))
    for k in range(3):
        (tmp_path / f"s{k}.jsonl").write_text("other\n" * 9)
    assert sorted((r.rel_path, r.line_no, r.i) for r in read.collect()) == [(f"s{k}.jsonl", n, i) for k in range(3) for n, i in ((1, 0), (3, 1))]


def test_folders_are_not_listed_by_a_task_each(spark):
    before = spark.conf.get(sessions._LISTING)
    with sessions.listing_in_parts(spark):
        assert int(spark.conf.get(sessions._LISTING)) == 8 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(sessions._LISTING) == before


def test_session_folder_has_one_folder_per_file(spark):
    import os

    from signalmill.plans.queries import _session_folder

    root = _session_folder(spark, "/root/testdata/sf0.001").removeprefix("file:")
    folders = [d for d in os.listdir(root) if d.startswith("session_id=")]
    assert all(any(f.endswith(".txt") for f in os.listdir(f"{root}/{d}")) for d in folders) and len(folders) > 10


def test_a_stream_lists_the_files_of_one_folder_only(spark, tmp_path, monkeypatch):
    import os
    from collections import Counter
    from datetime import datetime, timedelta

    from signalmill.plans import queries
    from signalmill.streaming import live

    # 40 users and one without a name, 5 events each, of which the 23rds are heartbeats.
    start = datetime(2026, 1, 1)
    rows = [(n, start + timedelta(seconds=n), n % 41 or None, "click", 1.0, '{"k": 1}') for n in range(205)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    views = Counter(f"s{r[2]}" if r[2] else "__HIVE_DEFAULT_PARTITION__" for r in rows if r[0] % 29 == 0 or r[0] % 23)

    def files(root):
        return [os.path.basename(d) for d, _, names in os.walk(root.removeprefix("file:")) if any(f.endswith(".txt") for f in names)]

    seen, stream = [], live.session_stream
    monkeypatch.setattr(queries, "_FOLDER_FILES", 8, raising=False)
    monkeypatch.setattr(live, "session_stream", lambda spark, root, **options: seen.append(files(root)) or stream(spark, root, **options))
    got = queries.stream_sessions(spark, str(tmp_path)).collect()
    assert {r.session_id: r.views for r in got} == views and len(got) == 41
    assert sorted(name for some in seen for name in some) == sorted(f"session_id={name}.0" for name in views)
    assert len(seen) > 3 and max(map(len, seen)) < 20


def test_listings_are_not_kept_by_the_driver(spark):
    before = spark.conf.get(sessions._LISTINGS_KEPT)
    with sessions.listing_in_parts(spark):
        assert spark.conf.get(sessions._LISTINGS_KEPT) == "0"
    assert spark.conf.get(sessions._LISTINGS_KEPT) == before


def test_a_changed_file_ends_in_an_error(spark, tmp_path):
    from pyspark.sql import functions as F

    row = "rel_path string, block_start bigint, seq bigint, value string"
    lines = spark.createDataFrame([("a", 0, 5, "x"), ("a", 0, 6, "y"), ("a", 90, 9, "z")], row)
    assert [r.line_no for r in sessions.with_line_numbers(lines).orderBy("line_no").collect()] == [1, 2, 3]
    # The first scan saw one line less than the second.
    seen = iter([lines.filter("seq <> 6"), lines])

    class Changing:
        def groupBy(self, *keys):
            return next(seen).groupBy(*keys)

        def join(self, *args):
            return next(seen).join(*args)

    with pytest.raises(Exception, match="changed while it was read"):
        sessions.with_line_numbers(Changing()).select(F.sum("line_no")).collect()


def test_views(read):
    got = {r.line_no: r for r in events.event_views(read).filter("line_no > 1 OR text <> 'n0'").collect() if not r.text.startswith("n")}
    assert 1 not in got and 4 not in got and 5 not in got and 14 not in got
    assert (got[3].role, got[3].raw_shape) == ("parse_error", "_parse_error")
    assert (got[6].role, got[6].text, got[6].ts) == ("user", "hello there", "2026-01-01T00:00:00Z")
    assert got[7].text == 'a\nb\n{"n":1,"type":"thinking"}\n5\nNone'
    assert (got[8].tool, got[8].status, got[8].error_code, got[8].text) == ("", None, "EXIT_2", "exitCode=2\nbad\nout")
    assert (got[9].tool, got[9].status) == ("exec", "error") and got[9].text == 'tool=exec\nstatus=error\nerror={"m":1}\nc'
    assert (got[10].role, got[10].text) == ("toolCall", "payload")
    assert (got[11].role, got[11].tool, got[11].status, got[11].text) == ("other", "bash", "ok", "killed by signal")
    assert (got[12].tool, got[12].error_code, got[12].text) == ("web", "E7", "boom")
    assert got[13].text == "start of run\nlast line\nfatal error: disk" and got[13].text_truncated
    assert got[15].text == "from dict"


def test_tool_calls(read):
    got = {r.line_no: r for r in events.tool_calls(read).collect()}
    assert set(got) == {9, 11, 12}
    assert (got[9].tool_name, got[9].status, got[9].error, got[9].preview) == ("exec", "error", '{"m":1}', "c")
    assert (got[11].action, got[11].status, got[11].exit_code, got[11].error) == ("run", "ok", "0", None)
    assert (got[12].tool_name, got[12].error) == ("web", "boom")


def test_failures(read):
    got = {r.line_no: r for r in events.failures(read).collect()}
    assert {n: r.kind for n, r in got.items()} == {3: "parse_error", 8: "tool_error", 9: "tool_error", 11: "pattern", 12: "error_field", 13: "pattern"}
    assert (got[8].status, got[8].exit_code, got[8].detail) == ("3", 2, "out")
    assert events.failures(read, limit=2).count() == 2


def test_search_and_span(read):
    assert [r.line_no for r in inspect.search(read, "HELLO").collect()] == [6]
    assert [r.line_no for r in inspect.search(read, "broken").collect()] == [3]
    assert inspect.search(read, "^n[0-9]$", fields=["content"], regex=True, limit=3).count() == 3
    hit = inspect.search_hits(read, "payload").first()
    assert hit["keys"] == ["message"] and hit.preview.startswith('{"message"')
    span = {r.events: r for r in inspect.span_summary(read, 0, 100).collect()}
    assert span[14].tool_calls == 1 and span[14].errors == 1
    assert span[5].summary.startswith("Span [0,100) events=5 tool_calls=0 errors=0\nExamples:\n- n0\n- n1")


def test_messages(spark, root):
    got = {r.idx: r for r in sessions.read_messages(spark, root).collect()}
    assert set(got) == {5, 6, 7, 14}
    assert (got[6].text, got[7].text, got[5].text) == ("a", "out", "")


def test_views_of_files(spark, root, read):
    """Parsing inside the scan gives the views of the two-step path."""
    from signalmill.operators.events import event_views, numbered_views

    direct = sessions.read_views(spark, root, include=["*.jsonl"], exclude=["sk?p*"])
    steps = numbered_views(event_views(read).drop("line_no"))
    assert direct.drop("rel_path").select(*steps.columns).exceptAll(steps).count() == 0
    assert direct.count() == steps.count()


def test_flow(spark, root, tmp_path):
    from signalmill.plans import flows
    from signalmill.sources.items import read_items

    items, summary = flows.mine_sessions(spark, root, str(tmp_path / "items"), chunk_events=4, chunk_overlap=1)
    row = summary.first()
    assert (row.sessions_scanned, row.items) == (3, items.count()) and row.items > 0
    assert read_items(spark, str(tmp_path / "items")).count() == row.items
    clusters = flows.roll_up(items, merge_similar=True, complete=lambda system, user: '{"decision": "merge", "confidence": 1}')
    assert clusters.agg({"count_items": "sum"}).first()[0] == row.items

    def answer(system, user):
        events = json.loads(user)["events"]
        quote = events[0]["text"][:5]
        item = {"kind": "other", "summary": "seen", "evidence": [{"event_i": events[0]["i"], "quote": quote}]}
        return json.dumps({"items": [item]})

    told, _ = flows.mine_sessions(spark, root, complete=answer)
    assert told.count() == 3 and {r.kind for r in told.collect()} == {"other"}


def test_sql_helpers_agree_with_the_functions(spark):
    from signalmill.sources import tables

    events = sessions.parse_events(tables.trace_json(spark, "/root/testdata/sf0.001")).cache()
    inspect.register_sql(events)

    def same(sql, df):
        rows = lambda x: sorted(repr(tuple(r)) for r in x.collect())
        assert rows(spark.sql(sql)) == rows(df) and df.count()

    same("SELECT session_id, i, line_no FROM trace_window(5, 30)", inspect.window(events, 5, 30).select("session_id", "i", "line_no"))
    same("SELECT session_id, i FROM trace_search('GATEWAY', 3)", inspect.search(events, "GATEWAY", limit=3).select("session_id", "i"))
    same("SELECT * FROM trace_search_hits('gateway', 30)", inspect.search_hits(events, "gateway"))
    summary = inspect.span_summary(events, 0, 40).select("session_id", "events", "tool_calls", "errors")
    same("SELECT * FROM trace_span(0, 40)", summary)
    cut = spark.sql("SELECT max(length(json)) AS most FROM trace_compact(0, 10, 20)").first()
    assert cut.most == 21
