"""The answer store: nothing is asked twice, over repeats, runs and stopped runs."""

import os

import pytest

from signalmill.operators.answers import AnswerStore

SCHEMA = "id string, system string, user string, key string, round int"


def asked(spark, rows):
    return spark.createDataFrame([(f"r{n}", s, u, "k", 1) for n, (s, u) in enumerate(rows)], SCHEMA)


def counting(folder, stops=(), fails=()):
    """A model that notes each call as a file, stops its run at some questions and fails at others."""

    def complete(system, user):
        calls = len([f for f in os.listdir(folder) if f.startswith(f"{user}-")])
        open(f"{folder}/{user}-{calls}", "w").close()
        if user in stops:
            raise SystemExit("killed")
        if user in fails:
            raise ValueError(f"no {user}")
        return f"{system}|{user}"

    return complete


def test_repeats_and_later_runs_ask_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = AnswerStore(spark, str(tmp_path / "store"))
    rows = [("s", f"q{n % 7}") for n in range(40)] + [(None, "q1"), (None, None), ("", "")] + [("s", "hot")] * 60
    got = store.ask(asked(spark, rows), counting(calls), per_round=3, per_task=2)
    assert got.columns == ["id", "system", "user", "key", "round", "answer", "error"]
    found = {r.id: (r.answer, r.error) for r in got.collect()}
    assert found == {f"r{n}": (f"{s or ''}|{u or ''}", None) for n, (s, u) in enumerate(rows)}
    assert len(os.listdir(calls)) == 7 + 3  # q0 to q6 and hot of `s`, q1 and nothing of no system

    again = AnswerStore(spark, str(tmp_path / "store"))
    got = again.ask(asked(spark, rows + [("s", "new")]), counting(calls)).collect()
    assert len(got) == len(rows) + 1 and len(os.listdir(calls)) == 11
    assert again.ask(asked(spark, []), counting(calls)).count() == 0


def test_a_stopped_run_goes_on_where_its_last_round_ended(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    path = str(tmp_path / "store")
    rows = asked(spark, [("s", f"q{n}") for n in range(30)])
    with pytest.raises(Exception):
        AnswerStore(spark, path).ask(rows, counting(calls, stops=["q17"]), per_round=5, per_task=2)
    kept = spark.read.parquet(path).count()
    before = len(os.listdir(calls))
    got = AnswerStore(spark, path).ask(rows, counting(calls), per_round=5, per_task=2).collect()
    assert sorted(r.answer for r in got) == sorted(f"s|q{n}" for n in range(30))
    # What was written is not asked again.
    assert len(os.listdir(calls)) == before + 30 - kept


def test_failed_requests_are_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    path = str(tmp_path / "store")
    rows = asked(spark, [("s", "good"), ("s", "bad")])
    got = AnswerStore(spark, path).ask(rows, counting(calls, fails=["bad"]), attempts=3, pause=0.0).collect()
    assert {r.user: (r.answer, r.error) for r in got} == {"good": ("s|good", None), "bad": (None, "ValueError: no bad")}
    assert sorted(os.listdir(calls)) == ["bad-0", "bad-1", "bad-2", "good-0"]
    got = AnswerStore(spark, path).ask(rows, counting(calls)).collect()
    assert {r.user: (r.answer, r.error) for r in got} == {"good": ("s|good", None), "bad": ("s|bad", None)}
    assert len(os.listdir(calls)) == 5
