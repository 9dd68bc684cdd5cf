"""Operator 3: which family texts are confirmed as, against plain comparisons."""

import os
import re

import pytest

from greffe.llm import licences

SF = "/root/testdata/sf0.001/documents.parquet"
PROBE = {
    "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    "CC BY-ND 4.0.": "cc-by-nd",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa",
    "Licensed under CC BY 4.0.": "cc-by",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "SPDX-License-Identifier: BSD-2-Clause": "bsd",
    "SPDX-License-Identifier: GPL-2.0-only": "gpl",
    "SPDX-License-Identifier: CC-BY-4.0": "cc-by",
    "SPDX-License-Identifier: CC0-1.0": "public-domain",
    "MIT License": "mit",
    "Mozilla Public License Version 2.0": "mpl",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "lgpl",
    "This work is licensed under the GNU Affero General Public License, version 3.": "agpl",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by": "lgpl",
    "                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE": "apache-2.0",
    "All rights reserved.": "proprietary",
    "The zoning board reserved all rights for parking on the north side of the street.": "",
    "He applied for a fishing license in June and the office said that the licence was free of charge to any person.": "",
    "The creative commons of the village was licensed to the shepherds by the council.": "",
}


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text))


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        after = [0]
        for j, y in enumerate(b):
            after.append(row[j] + 1 if x == y else max(row[j + 1], after[j]))
        row = after
    return row[-1]


def plainly_confirmed(piece, family):
    """licences.confirmed() on words instead of hashes, with a table instead of bits."""
    every = {f: [plain_words(x) for x in own] for f, own in licences.NOTICES.items()}
    others = {w for f, own in every.items() if f != family for x in own for w in x}
    long, short = set(licences.CHANGERS.split()), set(licences.SHORT_CHANGERS.split())
    best = 0.0
    for notice in every[family]:
        own, words = set(piece), set(notice)
        if len(own & words) < licences.HELD * len(words) or words - others and not own & (words - others):
            continue
        if words & (long | short) - own or own & (long | short) - words:
            continue
        held = common(piece, notice)
        least = len(notice) if len(notice) <= licences.SHORT_NOTICE else licences.HELD * len(notice)
        if held >= least and held >= licences.FILLED * len(piece):
            best = max(best, held / len(notice))
    return best


@pytest.fixture(scope="module")
def texts(spark):
    if not os.path.isfile(SF):
        pytest.skip("no test tables here")
    return [r.text or "" for r in spark.read.parquet(SF).select("text").collect()]


def test_confirmation_is_the_plain_one(texts):
    """On all lines of the smallest table and on texts about licences, for every family."""
    lines = {" ".join(own[at : at + licences.PIECE]) for t in [*texts, *PROBE] for line in t.split("\n") if (own := line.split()) for at in range(0, len(own), licences.PIECE)}
    lines |= {x for own in licences.NOTICES.values() for x in own} | {f"{x} ShareAlike" for x in licences.NOTICES["cc-by"]} | {" ".join(x.split()[::-1]) for own in licences.NOTICES.values() for x in own}
    lines = sorted(lines)
    seen = set()
    for text, hashed in zip(lines, licences.word_lists(lines)):
        own = plain_words(text)
        assert len(own) == len(hashed)
        for family in licences.NOTICES:
            found = licences.confirmed(hashed, family)
            assert found == pytest.approx(plainly_confirmed(own, family)), (text, family)
            seen |= {family} if found else set()
    assert seen == set(licences.NOTICES)


def test_probe(spark, texts):
    model = licences.fit(spark.read.parquet(SF).select("doc_id", "text"))
    own = list(PROBE.items())
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(own)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan(docs, model)[1].collect()}
    assert {t: got[i] for i, (t, _) in enumerate(own)} == PROBE
    # Families stay what they are in a longer line, within a very long text, and beside other columns.
    filler = " ".join(" ".join(t.split()) for t in texts if len(t) < 9000 and not re.search("(?i)licen[sc]|reserved|copyright|CC BY", t))[:400_000]
    wide = "task int, found int, family string, doc_id long, text string"
    rows = [(0, 1, "x", 0, f"{filler[:60_000]}\nReleased under the MIT License.\n{filler}"), (0, 1, "x", 1, None), (0, 1, "x", 1, "")]
    counts = sorted((r.doc_id, r.families) for r in licences.scan(spark.createDataFrame(rows, wide), model)[1].collect())
    assert counts == [(0, "mit"), (1, ""), (1, "")]
