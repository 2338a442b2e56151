import random
import re

import pytest

from signalmill.llm import common, periodic_runs

from .cases import LONG, ODD, table


def brute(words):
    """Every maximal run by its smallest period, tried lag by lag."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = p
        while i < n:
            if words[i] != words[i - p]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - p]:
                i += 1
            start, length = first - p, i - first + p
            if length >= max(6, 4 * p):
                found.setdefault((start, length), p)
    return sorted((s, length, p) for (s, length), p in found.items())


def collapsed(words, runs):
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def told(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = brute(words)
    return repr((i, len(words), runs, collapsed(words, runs)))


def check(spark, rows, parts=2):
    df = table(spark, rows).repartition(parts) if rows else table(spark, rows)
    found = periodic_runs.runs(df).collect()
    got = sorted(repr((r[0], r[1], [tuple(x) for x in r[2]], r[3])) for r in found)
    assert got == sorted(told(*r) for r in rows)


def texts():
    rnd, out = random.Random(5), []
    for letters in (1, 2, 3, 6):
        out += [" ".join(rnd.choice("abcdef"[:letters]) for _ in range(rnd.randrange(90))) for _ in range(60)]
    for _ in range(80):
        unit = [rnd.choice("abc") for _ in range(rnd.randrange(1, 12))]
        around = [rnd.choice("abcd") for _ in range(rnd.randrange(8))]
        other = [rnd.choice("abc") for _ in range(rnd.randrange(1, 5))]
        out.append("\t".join([*around, *(unit * 9)[: rnd.randrange(1, 9 * len(unit) + 1)], *other * 6, *around]))
    for unit in ("a", "a b", "a a b", "a b a c", "a b c d e f g h i j k l m n o p q"):
        out.append(" ".join([unit] * 50))
    return out


def test_random_and_periodic_texts(spark):
    check(spark, list(enumerate(texts())))


def test_odd_rows(spark):
    check(spark, [r for r in ODD if r[1] is not LONG] + [(20, "\n x\x0by\x0cx y x y x y\r\nx  y "), (21, "a\x1cb " * 9)])


def test_empty(spark):
    check(spark, [])


@pytest.mark.parametrize("unit", [["x"], ["x", "y", "x", "z"], [f"w{i}" for i in range(4999)]])
def test_long_texts_take_no_quadratic_work(spark, unit):
    words = ["start", *(unit * (120_000 // len(unit))), "end"]
    (row,) = periodic_runs.runs(table(spark, [(1, " ".join(words))])).collect()
    assert [tuple(x) for x in row["runs"]] == [(1, len(words) - 2, len(unit))]
    assert row["collapsed"] == " ".join(["start", *unit, "end"])


def test_pieces_do_not_matter(spark, monkeypatch):
    rows = list(enumerate([*texts()[::9], LONG, "a b c " * 30]))
    whole = sorted(map(repr, periodic_runs.runs(table(spark, rows)).collect()))
    monkeypatch.setattr(common, "PIECE", 50)
    assert sorted(map(repr, periodic_runs.runs(table(spark, rows)).collect())) == whole
