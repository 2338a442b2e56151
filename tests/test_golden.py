"""Published values: hashes, scores, ids, metrics and latency figures."""

import pytest
from pyspark.sql import functions as F

from signalmill.functions import text as tx
from signalmill.functions.classify import group_score, group_tier, kind_v2
from signalmill.operators import cron, evaluate, latency
from signalmill.operators.signals import item_id

# kind_v2, kind, summary, item tags, ranked tags, items, max severity, tier, score, fingerprint, signature.
CLUSTERS = [
    ("reliability_perf", "error", "Cron Gateway API is not responding, causing timeout errors in cron.list and subsequent calls.",
     ["incident"], ["incident"], 1, "high", 1, 5.993147180559945, "e9bb39f9", "eca75583"),
    ("defect", "error", "System repeatedly logs 'Cron (error)' despite normal reminder interactions.",
     ["error", "incident"], ["incident", "error", "cron", "reminder"], 5, "low", 1, 5.091759469228054, "547b740c", "146c0f5f"),
    ("ux_friction", "improvement_suggestion", "System repeatedly issues 'Cron (error)' messages indicating potential issues with task handling or state management.",
     ["error", "incident"], ["error", "incident"], 2, "medium", 1, 5.098612288668109, "3d13a00f", "4fcf1ed4"),
    ("capability_gap", "improvement_suggestion", "Assistant should avoid unnecessary tool calls when HEARTBEAT.md content is unchanged.",
     ["heartbeat", "efficiency"], ["heartbeat", "efficiency"], 1, "low", 3, 1.6931471805599454, "e85ba8a8", "83416aeb"),
    ("proactive_opportunity", "proactive_opportunity", "System can proactively draft outreach messages once user provides contact channels and context.",
     ["proactive_opportunity"], ["proactive_opportunity", "proactive", "drafting", "automation"], 14, "medium", 2, 4.7080502011022105, "61d0165a", "fa5de7ed"),
    ("process_tooling", "improvement_suggestion", "System should better handle dependency on HEARTBEAT.md and avoid repeated error messages if no tasks need attention.",
     ["process", "incident"], ["process", "incident"], 1, "low", 1, 3.6931471805599454, "6880fa3c", "174bf78a"),
    ("user_delight", "user_delight", "Assistant correctly replies HEARTBEAT_OK promptly when no attention is needed.",
     [], [], 1, "low", 3, 1.6931471805599454, "a14f4710", "a14f4710"),
]


def test_cluster_values(spark):
    columns = "kind_v2 string, kind string, summary string, tags array<string>, ranked array<string>, n bigint, sev string, tier int, score double, fp string, sig string"
    rows = spark.createDataFrame(CLUSTERS, columns)
    flags = ("array_contains(ranked, 'incident')", "kind = 'error'", "kind = 'user_frustration'")
    got = rows.select(
        "*",
        F.expr(tx.hashed("", tx.signature_text("kind", "summary", "tags"))).alias("sig_got"),
        F.expr(tx.hashed("", tx.fingerprint_text("kind_v2", tx.redact("summary"), "ranked"))).alias("fp_got"),
        F.expr(group_score("n", "sev", *flags)).alias("score_got"),
        F.expr(group_tier("sev", *flags)).alias("tier_got"),
        F.expr(kind_v2("kind", "summary", "tags")).alias("kind_got"),
    ).collect()
    for r in got:
        assert r.sig_got.startswith(r.sig) and r.fp_got.startswith(r.fp)
        assert r.score_got == pytest.approx(r.score, abs=1e-12) and r.tier_got.tier == r.tier
        if r.kind_v2 not in ("ux_friction", "process_tooling"):  # those are modes over several items
            assert r.kind_got.label == r.kind_v2


def test_session_id(spark):
    name = "0001_31e89d3b-7e8b-40d6-9ec1-61a5722a4000.jsonl"
    got = spark.createDataFrame([(name,)], "p string").select(F.expr(tx.session_key("p"))).first()[0]
    assert got.startswith("sha256:b237572f")


def test_item_id_is_the_hash_of_sorted_json(spark):
    import hashlib
    import json

    odd = 'tab\t "quoted" back\\slash \u0001\u001f é \n end'
    rows = [("s", "error", odd, [odd, "b"]), ("s", "error", "\\u001F", [])]
    got = spark.createDataFrame(rows, "s string, k string, m string, q array<string>").select(F.expr(item_id("s", "k", "m", "q"))).collect()
    for (session, kind, summary, quotes), row in zip(rows, got, strict=True):
        seed = json.dumps(
            {"session_id": session, "kind": kind, "summary": summary, "quotes": quotes}, sort_keys=True, ensure_ascii=False
        )
        assert row[0] == "sha256:" + hashlib.sha256(seed.encode()).hexdigest()


# Ten measured calls and their published figures.
CALLS = [3435.426712036133, 3243.8018321990967, 3245.9139823913574, 3347.630023956299, 3327.549934387207,
         3245.931386947632, 3151.2298583984375, 3481.2910556793213, 3404.0775299072266, 3200.833559036255]


def test_latency(spark):
    rows = [("a", i, float(i), v, True, None) for i, v in enumerate(CALLS)]
    rows += [("a", 99, 99.0, 1.0, False, "TIMEOUT after 35s"), ("b", 0, 0.0, 5.0, False, "x")]
    samples = spark.createDataFrame(rows, "phase string, call_id int, start_ts double, latency_ms double, success boolean, error string")
    got = {r.phase: r for r in latency.latency_stats(samples).collect()}
    a, b = got["a"], got["b"]
    assert (a.n_calls, a.n_success, a.n_failures, a.timeouts) == (11, 10, 1, 1)
    assert (a.p50_ms, a.p95_ms, a.p99_ms, a.max_ms) == (3327.549934387207, *[3481.2910556793213] * 3)
    assert a.mean_ms == pytest.approx(3308.3685874938965)
    assert b.n_success == 0 and b.p50_ms is None and b.mean_ms is None
    assert latency.last_samples(samples, limit=3).filter("phase = 'a'").count() == 3


def test_class_metrics(spark):
    # Ten published label pairs (automatic, judged).
    pairs = [("ux_friction", "ux_friction")] * 6 + [
        ("proactive_opportunity", "user_delight"), ("proactive_opportunity", "ux_friction"),
        ("ux_friction", "process_tooling"), ("defect", "ux_friction"),
    ]
    labels = spark.createDataFrame(pairs, "auto string, judged string")
    got = {r.label: r for r in evaluate.class_metrics(labels, "auto", "judged").collect()}
    assert len(got) == 7
    ux = got["ux_friction"]
    assert (ux.tp, ux.fp, ux.fn, ux.precision, ux.recall, ux.f1) == (6, 2, 1, 0.75, 0.857, 0.8)
    assert (got["proactive_opportunity"].fn, got["defect"].fn, got["user_delight"].fp) == (2, 1, 1)
    assert evaluate.accuracy(labels, "auto", "judged").first().accuracy == 0.6


def test_gaps(spark):
    # Published timestamps and gaps of one session.
    stamps = ["2026-01-31T16:02:10.881Z", "2026-01-31T16:02:23.530Z", "2026-01-31T17:00:06.535Z", "2026-01-31T19:00:16.258Z"]
    rows = [("s", i, t, "user", "Cron (error): here") for i, t in enumerate(stamps)] + [
        ("s", 4, None, "user", "Cron x"), ("s", 5, "bad", "user", "cron (OK): y"), ("s", 6, "2026-01-31T19:00:30.477Z", "user", "Cron z")
    ]
    messages = spark.createDataFrame(rows, "session_id string, idx bigint, timestamp string, role string, text string")
    for block in (2, 1 << 16):
        gaps = cron.with_gaps(cron.cron_events(messages), block).orderBy("idx").collect()
        assert [g.gap_ms for g in gaps] == [None, 12649.0, 3463005.0, 7209723.0, None, None, None]
    stats = cron.gap_stats(cron.with_gaps(cron.cron_events(messages))).first()
    assert (stats.total_cron_events, stats.error_labeled, stats.false_errors, stats.rapid_fire_count) == (7, 4, 4, 0)
