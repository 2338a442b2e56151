import random
import re
from collections import Counter, defaultdict

from signalmill.llm import license_scan

from .cases import ODD, table


def bigrams(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return Counter(zip(w, w[1:], strict=False))


def brute(rows, known, threshold=0.8):
    known = [(licence, bigrams(t)) for licence, t in known if bigrams(t)]
    seen, best = set(), defaultdict(list)
    for i, text in rows:
        for unit in [] if text is None else {text, *re.split(r"\n\s*\n", text), *text.split("\n")}:
            if (i, unit) in seen:
                continue
            seen.add((i, unit))
            own = bigrams(unit)
            scores = []
            for licence, other in known:
                common = sum((own & other).values())
                dice = 2.0 * common / (own.total() + other.total()) if own else 0
                if dice >= threshold:
                    scores.append((-dice, licence))
            if scores:
                best[i, min(scores)[1]].append(-min(scores)[0])
    return sorted(repr((i, licence, len(d), max(d))) for (i, licence), d in best.items())


def test_against_brute_force(spark):
    rng = random.Random(2)
    known = license_scan.templates()
    rows = []
    for i in range(150):
        words = rng.choice(known)[1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = "other"
        wrapped = " ".join(words) if rng.random() < 0.6 else "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        rows.append((i, rng.choice(["", "prose of a page\n", "prose.\n\n"]) + wrapped + rng.choice(["", "\n\nmore prose", "\nend"])))
    rows += [(5, rows[5][1]), (5, rows[6][1]), (900, "\n".join(["Released under the MIT License."] * 400)), *[(1000 + (i or 0), t) for i, t in ODD]]
    found = license_scan.licences(table(spark, rows)).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows, known)
    assert len({r["licence"] for r in found}) > 8


def test_whole_texts_and_empty_tables(spark):
    text = " ".join(license_scan.NOTICES["MIT"].split())
    found = license_scan.licences(table(spark, [(1, text), (None, text), (2, None)])).collect()
    assert sorted(map(repr, map(tuple, found))) == ["(1, 'MIT', 1, 1.0)", "(None, 'MIT', 1, 1.0)"]
    assert license_scan.licences(table(spark, [])).count() == 0
    assert license_scan.licences(table(spark, ODD), known=[("x", "one")]).count() == 0


def test_whole_licences_and_standard_headers(spark):
    """The texts as their publishers give them, also inside a file that holds more."""
    texts = {f.stem: f.read_text() for f in license_scan.TEXTS.glob("*.txt")}
    apache = texts["Apache-2.0"][texts["Apache-2.0"].rindex('   Licensed under the Apache License') :]
    gnu = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    prose = "words of a page " * 300
    cases = [(k, f"Copyright (c) 2020 Some One\n\n{t}") for k, t in texts.items()]
    cases += [("Apache-2.0", f"Copyright 2020 Some One\n\n{apache}\n\n{prose}")]
    cases += [("AGPL-3.0", gnu.format("This program", "Affero ") + f"\n\n{prose}"), ("LGPL-3.0", gnu.format("This program", "Lesser ") + f"\n\n{prose}")]
    cases += [("BSD-3-Clause", f"{prose}\n\n{texts['BSD-3-Clause']}\n\n{prose}")]
    found = license_scan.licences(table(spark, [(i, t) for i, (_, t) in enumerate(cases)])).collect()
    for i, (licence, _) in enumerate(cases):
        mine = {r["licence"]: r["dice"] for r in found if r["doc_id"] == i}
        assert mine.get(licence, 0) > 0.9, (licence, mine)
        assert licence != "BSD-3-Clause" or "BSD-2-Clause" not in mine
        assert licence not in ("AGPL-3.0", "LGPL-3.0") or "GPL-3.0" not in mine
