import random

import brute
import pytest

from tracemill.llm import licences as l

SCHEMA = "doc_id long, text string, licence string, dice int"
SMALL = {"short": "Released under the MIT License.", "long": "Permission to use, copy and change this work is granted to all who ask, free of charge", "one": "word"}


def grams(words):
    return {tuple(words[k : k + 2]) for k in range(len(words) - 1)}


def plain(text, templates, least):
    """Best Dice of each template over all stretches of a text."""
    words, out = brute.tokens(text), {}
    for name, template in templates.items():
        own = grams(brute.tokens(template))
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                both = grams(words[i:j])
                dice = 2 * len(both & own) / (len(both) + len(own))
                if own and dice >= least and dice > out.get(name, 0):
                    out[name] = dice
    return out


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_best_dice_against_all_stretches(spark, least):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        noise = [rng.choice(["the", "under", "copy", "is", "and", "x", "MIT"]) for _ in range(rng.randrange(25))]
        part = rng.choice(list(SMALL.values())[:2]).split()
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = rng.choice(["zz", "to", "License"])
        noise[rng.randrange(len(noise) + 1) : 0] = part
        rows.append((k, " ".join(noise), "", 0))
    got = {}
    for r in l.scan(spark.createDataFrame(rows, SCHEMA), SMALL, least).collect():
        got[r.doc_id] = max(got.get(r.doc_id, 0), r.dice)
    want = {k: max(p.values()) for k, t, *_ in rows if (p := plain(t, SMALL, least))}
    assert got == pytest.approx(want)


def test_spans_and_edges(spark):
    rows = [(1, "text\nReleased under the\nMIT license!\n" * 2 + "Ærø", None, None), (None, SMALL["long"].upper(), "", 0), (3, None, "", 0), (4, "", "", 0), (5, "word", "", 0), (6, "x " * 50_000 + SMALL["long"], "", 0), (6, "x " * 50_000 + SMALL["long"], "", 0)]
    got = l.scan(spark.createDataFrame(rows, SCHEMA), SMALL).collect()
    n = len(SMALL["long"].split())
    assert sorted([(r.doc_id, r.licence, r.dice, r.word_at, r.n_words) for r in got], key=str) == sorted(
        [(1, "short", 1.0, 1, 5), (1, "short", 1.0, 7, 5), (None, "long", 1.0, 0, n), (6, "long", 1.0, 50_000, n), (6, "long", 1.0, 50_000, n)], key=str
    )
    assert {r.quote for r in got if r.doc_id == 1} == {"released under the mit license"}
    assert l.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_templates_match_themselves(spark):
    rows = [(k, f"before {t} after", "", 0) for k, t in enumerate(l.TEMPLATES.values())]
    got = {r.doc_id: r.licence for r in l.scan(spark.createDataFrame(rows, SCHEMA)).orderBy("word_at").collect()}
    assert got == dict(enumerate(l.TEMPLATES))


def test_similar_licences_are_told_apart(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
    bsd3 = l.TEMPLATES["BSD-3-Clause-numbered"]
    want = {
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        gnu.format("General Public License", 2): "GPL-2.0",
        gnu.format("General Public License", 3): "GPL-notice",
        gnu.format("Lesser General Public License", 3): "LGPL-3.0",
        gnu.format("Affero General Public License", 3): "AGPL-3.0",
        bsd3.replace("the copyright holder nor", "Some Company Inc. nor"): "BSD-3-Clause",
        bsd3.replace("the copyright holder nor", "Some Company Inc. nor").replace("1. ", "").replace("2. ", "").replace("3. ", ""): "BSD-3-Clause",
        l.TEMPLATES["BSD-2-Clause"] + l.TEMPLATES["BSD-3-Clause"].split("WARRANTIES", 1)[1]: "BSD-2-Clause",
        l.TEMPLATES["GPL-3.0"].replace("Preamble", "Foreword"): "GPL-3.0",
        l.TEMPLATES["GPL-2.0"]: "GPL-2.0",
        l.TEMPLATES["MPL-2.0"]: "MPL-2.0",
    }
    rows = [(k, t, "", 0) for k, t in enumerate(want)]
    got = {}
    for r in l.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r.licence)
    for k, (text, name) in enumerate(want.items()):
        assert len(got.get(k, [])) == 1 and got[k][0].startswith(name), (text[:80], got.get(k))
