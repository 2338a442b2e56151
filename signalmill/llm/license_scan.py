"""Licence scans by Dice coefficient over word bigrams, in DataFrame operations only.

A text is compared as a whole, by paragraphs and by lines (its units). A unit
and a template are multisets of word bigrams; their Dice coefficient is twice
the common bigrams over the sum of both sizes. With sizes u and t it cannot
exceed 2 min(u, t) / (u + t), so only templates with
u * s <= t <= u / s for s = threshold / (2 - threshold) are candidates, and
units that fit no template are dropped before their bigrams are built. A unit
shares at least s * t bigrams with a template that it matches, so one without
any of the words that hold more than (1 - s) * t of them is dropped as well;
this keeps the templates of whole texts cheap. The rest
meet the templates in a join on bigrams; the template table has a fixed size
and is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Bigrams from which on a template is looked up by its words first.
LONG = 90

# Licences, the names they go by, and texts of notices.
NAMES = {
    "MIT": ["the MIT License", "the MIT license terms"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "ISC": ["the ISC License"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "Unlicense": ["the Unlicense"],
}
FORMS = [
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under {}.",
    "This work is licensed under {}.",
    "This project is licensed under {}.",
]
NOTICES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    # The clauses of both start with it; the whole texts and the third clause tell them apart.
    "BSD-2-Clause OR BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:""",
    "Unlicense": """This is free and unencumbered software released into the public domain.""",
}


# More notices, a licence may have several: the Apache header by paragraph, the third BSD clause, the GNU notices.
MORE_NOTICES = [
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License.""",
    ),
    (
        "Apache-2.0",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    ),
    (
        "BSD-3-Clause",
        """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.""",
    ),
    (
        "CC0-1.0",
        """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to
this software to the public domain worldwide. This software is distributed without any warranty.""",
    ),
]
# Licence, its name in notices, version, the word for the work and how the version is set off.
GNU = [
    ("GPL-2.0", "GNU General Public License", "2", "program", ";"),
    ("GPL-3.0", "GNU General Public License", "3", "program", ":"),
    ("LGPL-2.0", "GNU Library General Public License", "2", "library", ";"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library", ";"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "program", ":"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "program", ":"),
]
GNU_NOTICE = [
    """This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published
by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version.""",
    """This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.""",
    """You should have received a copy of the {name} along with this {work}. If not, see <https://www.gnu.org/licenses/>.""",
]
CREATIVE = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CREATIVE_NOTICE = """This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this
license, visit http://creativecommons.org/licenses/{code}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View,
CA 94042, USA."""
# Whole texts by licence. That of AGPL-3.0 is made of the terms of GPL-3.0, without most of the preamble.
TEXTS = Path(__file__).parent / "licence_texts"


def templates() -> list[tuple[str, str]]:
    """(licence, text): each name in each form, the notices, then the whole texts."""
    short = [(k, form.format(name)) for k, names in NAMES.items() for name in names for form in FORMS]
    notices = [*NOTICES.items(), *MORE_NOTICES]
    for k, name, version, work, mark in GNU:
        parts = [x.format(work=work, mark=mark, name=name, version=version) for x in GNU_NOTICE]
        notices += [(k, parts[0]), (k, " ".join(parts))]
    notices += [(f"CC-{k}-4.0", CREATIVE_NOTICE.format(name=name, code=k.lower())) for k, name in CREATIVE.items()]
    notices += [(f.stem, f.read_text("ascii")) for f in sorted(TEXTS.glob("*.txt"))]
    return list(dict.fromkeys(short + [(k, " ".join(v.split())) for k, v in notices]))


def template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _template_bigrams(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """One row per template and bigram: template, licence, size, bigram, times."""
    rows = []
    for k, (licence, text) in enumerate(known):
        words = template_words(text)
        bigrams = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        rows += [(k, licence, len(words) - 1, bigram, n) for bigram, n in bigrams.items()]
    return spark.createDataFrame(rows, "template int, licence string, size bigint, bigram string, times bigint")


def _telling_words(text: str, share: float) -> list[str]:
    """Words that a text must have one of to share `share` of the bigrams of a template, long ones first."""
    words, out, held = template_words(text), [], 0
    times = Counter(words)
    pairs = list(zip(words, words[1:], strict=False))
    need = len(pairs) * (1 - share) + 1e-6
    for word in sorted(times, key=lambda w: (-min(len(w), 8), -times[w], w)):
        rest = [p for p in pairs if word not in p]
        held += len(pairs) - len(rest)
        pairs = rest
        out.append(word)
        if held > need:
            break
    return out


def units(docs: DataFrame, id: str = "doc_id", text: str = "text", able: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, unit, words): the different units of each text as lists of words, those that are `able`."""
    cut = f"array_distinct(concat(array(`{text}`), split(`{text}`, r'\\n\\s*\\n', -1), split(`{text}`, r'\\n', -1)))"
    parts = docs.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.expr(cut).alias("parts"))

    def worded(part: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(F.lower(part), "[^a-z0-9]+", " ")), " ")
        return F.struct(F.xxhash64(part).alias("unit"), words.alias("words"))

    # In one array, so that a filter does not make the words again.
    made = F.transform("parts", worded)
    made = made if able is None else F.filter(made, lambda u: able(u["words"]))
    return parts.select("id", F.explode(made).alias("u")).select("id", "u.unit", "u.words")


def licences(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    known: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per document and licence: id, licence, n_units, dice.

    A unit counts for the template with the highest coefficient of at least
    `threshold`, of equal ones the first licence by name; `dice` is the highest
    of the document. Texts without words, empty and NULL texts match nothing;
    equal units of one id count once, also over repeated rows.
    """
    known = templates() if known is None else known
    known = [(licence, t) for licence, t in known if len(template_words(t)) > 1]
    spark = docs.sparkSession
    sizes = [len(template_words(t)) - 1 for _, t in known] or [0]
    short = [n for n in sizes if n <= LONG]
    share = threshold / (2 - threshold)
    telling = sorted({w for n, (_, t) in zip(sizes, known, strict=False) if n > LONG for w in _telling_words(t, share)})

    def fitting(words: Column) -> Column:
        # A little room for rounding; the coefficient itself decides.
        n = F.size(words) - 1
        fits = (n >= min(sizes) * share - 1e-6) & (n <= max(sizes) / share + 1e-6) & (n >= 1)
        if telling:
            fits &= (n <= max(short, default=0) / share + 1e-6) | F.arrays_overlap(words, F.array(*map(F.lit, telling)))
        return fits

    able = units(docs, id, text, fitting).withColumn("n", F.size("words").cast("bigint") - 1)
    pairs = "zip_with(slice(words, 1, size(words) - 1), slice(words, 2, size(words) - 1), (a, b) -> concat_ws(' ', a, b))"
    rows = able.select("id", "unit", "n", F.expr(f"explode({pairs})").alias("bigram"))
    terms = F.broadcast(_template_bigrams(spark, known))
    fits = (F.col("size") >= F.col("n") * share - 1e-6) & (F.col("size") <= F.col("n") / share + 1e-6)
    met = rows.join(terms, "bigram").filter(fits)
    common = met.groupBy("id", "unit", "n", "template", "licence", "size", "bigram", "times").count()
    common = common.groupBy("id", "unit", "n", "template", "licence", "size").agg(F.sum(F.least("count", "times")).alias("common"))
    scored = common.withColumn("dice", 2.0 * F.col("common") / (F.col("n") + F.col("size"))).filter(F.col("dice") >= threshold)
    # At most as many rows in a unit as there are templates.
    best = Window.partitionBy("id", "unit").orderBy(F.desc("dice"), "licence", "template")
    chosen = scored.withColumn("place", F.row_number().over(best)).filter("place = 1")
    return chosen.groupBy(F.col("id").alias(id), "licence").agg(F.count("*").alias("n_units"), F.max("dice").alias("dice"))
