"""Operator 3: licence scan by a trained paragraph classifier.

A paragraph's number is its line. A multinomial logistic regression on hashed word 1- and 2-grams, trained in numpy, gives
a piece of text a licence family or none. It learns from the notices below, varied, and from a bounded sample of the
corpus's own paragraphs as background. A prediction is confirmed by aligning the piece with its family's notices: enough of
a notice's words must stand there in the notice's order, all of them if it is short, and no word may stand there or beside
it that makes another licence of it (ShareAlike, Lesser and the like). Two kinds of pieces are looked at: windows of each notice's own length that hold enough of its words, anywhere in a
run of lines up to a line without words; and then lines, and runs of several lines, cut into pieces of PIECE words that
overlap by half. Of pieces that overlap, the window that holds most counts, or else the first. A piece of the second kind
that the model takes for a licence, but with less than the calibrated probability or without a confirming notice, counts
as unknown.

Null and empty texts have no paragraphs. The model needs no labels; without background it learns from notices alone.
Repeated rows are scanned alike; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words, work
from .toxicity import PUNCTUATED

#: Notices of licence families.
NOTICES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This project is licensed under the MIT license.", "The MIT License (MIT)", "MIT License", "SPDX-License-Identifier: MIT"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GNU General Public License version 2."),
    "lgpl": ("Licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "BSD 3-Clause License", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright; CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
}
#: Words that make another licence of a notice, and their short forms.
CHANGERS, SHORT_CHANGERS = "sharealike noderivatives noderivs noncommercial lesser affero", "sa nd nc"
NONE = "none"
FAMILIES = (NONE, *NOTICES)
#: Words of a piece at most; bounds of the background sample; buckets; copies of a notice; rounds and rate of training.
PIECE, SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_PIECES = 48, 1_000, 16_384, 8_000
BUCKETS, COPIES, ROUNDS, RATE, SEED = 1 << 16, 30, 4, 0.3, 3
#: Share of a notice's words that a piece must hold, of a piece's words that the notice must hold, and the share of varied
#: notices held back that the calibrated probability must let through.
HELD, FILLED, LET_THROUGH = 0.75, 0.4, 0.98
#: Words of a notice up to which all must be held; words on both sides of a piece in which a changing word counts.
SHORT_NOTICE, BESIDE = 8, 2
#: Parts of the families that are held back in turn, to calibrate what unknown families look like.
FOLDS = 3


def pieces(texts: pa.Array) -> tuple[words.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the line of each counted from 0 in its text, and where lines and runs of lines start among them (and an end)."""
    split = words.split(texts, lower=True, gaps=PUNCTUATED)
    lines = np.concatenate([[0], np.cumsum(split.data == 10)])
    line = lines[split.starts] if len(split) else np.zeros(0, np.int64)
    owner = split.owner()
    new = np.ones(len(split), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    apart = np.ones(len(split), dtype=bool)
    apart[1:] = (line[1:] > line[:-1] + 1) | (owner[1:] != owner[:-1])
    base = lines[words.flat(texts)[1][:-1]] if len(texts) else np.zeros(0, np.int64)
    ends = lambda marks: np.append(np.flatnonzero(marks), len(split))
    return split, (line - base[owner] if len(split) else line), ends(new), ends(apart)


def overlapping(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces of PIECE words, one each half a piece, of the parts between cuts."""
    sizes = np.diff(cuts)
    many = -(-sizes // (PIECE // 2))
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    starts = np.repeat(cuts[:-1], many) + within * (PIECE // 2)
    return starts, np.minimum(starts + PIECE, np.repeat(cuts[1:], many))


def windows(hashed: np.ndarray, cuts: np.ndarray) -> list[tuple[float, int, int, int]]:
    """(held, start, end, label) of windows as long as a notice that hold enough of it; of a notice's own none overlap."""
    place = np.minimum(np.searchsorted(VOCABULARY, hashed), len(VOCABULARY) - 1)
    at = np.flatnonzero(VOCABULARY[place] == hashed)  # Words that some notice has; a window starts and ends with one.
    place = place[at]
    seen, out = np.bincount(place, minlength=len(VOCABULARY)) > 0, []
    for label, family in enumerate(NOTICES, 1):
        for notice in TEMPLATES[family]:
            if not (seen & ANCHORED[notice]).any():
                continue
            # A window that holds enough of the notice holds one of its anchors.
            hits = at[ANCHORED[notice][place]]
            many, least = len(notice.order), HELD * len(notice.words)
            mine = at[HAS[notice][place]]
            mine = mine[np.searchsorted(hits, mine + many) > np.searchsorted(hits, mine)]
            run = np.searchsorted(cuts, mine, side="right")
            high, low = cuts[run], cuts[run - 1]
            every = at[HAS[notice][place]]
            first = np.searchsorted(every, mine)
            stop = np.searchsorted(every, np.minimum(mine + many, high))
            rows = []
            for i in np.flatnonzero(stop - first >= least).tolist():
                a, b = int(mine[i]), int(every[stop[i] - 1]) + 1
                held = notice.held(hashed[a:b].tolist(), hashed[max(int(low[i]), a - BESIDE) : min(int(high[i]), b + BESIDE)].tolist())
                if held:
                    rows.append((held, a, b, label))
            out += apart_from(rows, np.zeros(len(hashed), dtype=bool)) if rows else []
    return out


def apart_from(rows: list, taken: np.ndarray) -> list:
    """Of (held, start, end, ...) those, the most held and then the longest first, that overlap with none taken; they are taken then."""
    kept = []
    for row in sorted(rows, key=lambda x: (-x[0], x[1] - x[2], x[1])):
        if not taken[row[1] : row[2]].any():
            taken[row[1] : row[2]] = True
            kept.append(row)
    return kept


def grams(hashed: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, and of each word with the next of its piece (or an end mark)."""
    ends = np.zeros(len(hashed), dtype=bool)
    ends[starts[1:][np.diff(starts) > 0] - 1] = True
    after = np.append(hashed[1:], np.uint64(0))
    after[ends] = np.uint64(1)
    pair = words.mix(hashed * np.uint64(3) + after)
    return (hashed >> np.uint64(40)).astype(np.int64) % BUCKETS, (pair >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS x families
    bias: np.ndarray
    least: float = 0.5

    def probabilities(self, hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros((0, len(self.bias)))
        one, two = grams(hashed, starts)
        sums = np.add.reduceat(self.weights[one] + self.weights[two], starts[:-1], axis=0)
        return softmax(sums / np.sqrt(np.diff(starts))[:, None] + self.bias)

    def holds_once(self, piece: np.ndarray) -> bool:
        """Whether some family is likelier than none, and none less than even, if each word and pair of the piece counts once:
        what is repeated over and over must not add up to a licence."""
        one, two = (np.unique(x) for x in grams(piece, np.array([0, len(piece)])))
        chance = softmax(((self.weights[one].sum(axis=0) + self.weights[two].sum(axis=0)) / np.sqrt(len(one)) + self.bias)[None])[0]
        return chance[0] < 0.5 and chance.argmax() > 0

    def of_ranges(self, hashed: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of pieces that may overlap, none of them empty."""
        sizes = ends - starts
        turn, out = np.cumsum(sizes) // AT_ONCE, [np.zeros((0, len(self.bias)))]
        cuts = np.append(np.flatnonzero(np.diff(turn, prepend=-1)), len(starts)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            where = np.concatenate([[0], np.cumsum(sizes[a:b])])
            own = np.arange(where[-1]) + np.repeat(starts[a:b] - where[:-1], sizes[a:b])
            out.append(self.probabilities(hashed[own], where))
        return np.concatenate(out)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def word_lists(texts: list[str]) -> list[list[int]]:
    split = words.split(pa.array(texts, pa.string()), lower=True, gaps=PUNCTUATED)
    hashed = words.hashes(split)
    return [hashed[a:b].tolist() for a, b in zip(split.docs[:-1].tolist(), split.docs[1:].tolist())]


def word_set(text: str) -> frozenset[int]:
    return frozenset(word_lists([text])[0])


CHANGING, SHORT_CHANGING = word_set(CHANGERS), word_set(SHORT_CHANGERS)


@dataclass(frozen=True)
class Notice:
    order: tuple[int, ...]  # hashes of its words
    words: frozenset[int]
    marks: frozenset[int]  # words that no other family's notices have; one of them must be there, if there are any

    def in_order(self, piece: list[int]) -> int:
        """The most words of the notice that the piece holds in the notice's order: a longest common subsequence, in bits."""
        masks: dict[int, int] = {}
        for i, word in enumerate(self.order):
            masks[word] = masks.get(word, 0) | 1 << i
        full = row = (1 << len(self.order)) - 1
        for word in piece:
            both = row & masks.get(word, 0)
            row = ((row + both) | (row - both)) & full
        return len(self.order) - row.bit_count()

    def held(self, piece: list[int], around: list[int]) -> float:
        """The share of the notice that the piece holds; 0 if that is too little or the piece is of another licence.
        around: the piece and the words beside it."""
        many, own = len(self.order), set(piece)
        if len(own & self.words) < HELD * len(self.words) or self.marks and not own & self.marks:
            return 0.0
        if not (self.words & (CHANGING | SHORT_CHANGING)) <= own or not (CHANGING & set(around) | SHORT_CHANGING & own) <= self.words:
            return 0.0
        found = self.in_order(piece)
        return found / many if found >= (many if many <= SHORT_NOTICE else HELD * many) else 0.0


def templates() -> dict[str, list[Notice]]:
    lists = {family: word_lists(list(texts)) for family, texts in NOTICES.items()}
    of = {family: frozenset(x for own in every for x in own) for family, every in lists.items()}
    others = {family: frozenset().union(*(x for other, x in of.items() if other != family)) for family in of}
    return {family: [Notice(tuple(x), frozenset(x), frozenset(x) - others[family]) for x in every] for family, every in lists.items()}


TEMPLATES = templates()
VOCABULARY = np.array(sorted(set().union(*(x.words for own in TEMPLATES.values() for x in own))), dtype=np.uint64)
HAS = {x: np.isin(VOCABULARY, list(x.words)) for own in TEMPLATES.values() for x in own}


def anchors() -> dict[Notice, np.ndarray]:
    """For each notice its longest words, of which a window that holds enough of it must hold one: all words are needed of a
    short notice, so one does; of others so many words may be missing, and one more."""
    out = {}
    for family, every in TEMPLATES.items():
        for notice, text in zip(every, NOTICES[family]):
            split = words.split(pa.array([text]), lower=True, gaps=PUNCTUATED)
            sizes = dict(zip(notice.order, (split.ends - split.starts).tolist()))
            rare = sorted(notice.words, key=lambda x: (-sizes[x], x))
            missing = 0 if len(notice.order) <= SHORT_NOTICE else int((1 - HELD) * len(notice.words))
            out[notice] = np.isin(VOCABULARY, rare[: missing + 1])
    return out


ANCHORED = anchors()
#: A short piece with one of these words may be a notice of an unknown family: it doesn't teach what no licence is.
LICENCE_WORDS = word_set("license licence licensed licenced spdx copyright")
#: Words whose pieces are judged at once.
AT_ONCE = 200_000


def confirmed(piece: list[int], family: str) -> float:
    """How much of the best notice of the family the piece holds in order; 0 if too little either way."""
    own = set(piece)
    near = (x for x in TEMPLATES[family] if len(own & x.words) >= HELD * len(x.words))
    return max((held for notice in near if (held := notice.held(piece, piece)) and held * len(notice.order) >= FILLED * len(piece)), default=0.0)


def varied(background: list[str], rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Notices with words left out, in other cases, and with background words around them."""
    pool = " ".join(background[:400]).split() or ["the", "and", "of"]
    texts, labels = [], []
    for label, family in enumerate(FAMILIES):
        for notice in NOTICES.get(family, ()):
            for copy in range(COPIES):
                own = notice.split()
                if copy % 3 == 1 and len(own) > 6:
                    own = [w for w in own if rng.random() > 0.1]
                extra = rng.integers(0, 5, 2) if copy % 2 else (0, 0)
                text = " ".join([*rng.choice(pool, extra[0]), *own, *rng.choice(pool, extra[1])])
                texts.append(text.upper() if copy % 7 == 3 else text)
                labels.append(label)
    return texts, labels


def train(background: list[str]) -> Model:
    rng = np.random.default_rng(SEED)
    own = zip(background, word_lists(background)) if background else ()
    clean = [x for x, s in own if not any(confirmed(s, f) for f in NOTICES) and not (len(set(s)) <= PIECE // 2 and LICENCE_WORDS.intersection(s))]
    texts, labels = varied(clean, rng)
    texts, labels = [*texts, *clean], np.array([*labels, *[0] * len(clean)])
    split = words.split(pa.array(texts, pa.string()), lower=True, gaps=PUNCTUATED)
    full = np.flatnonzero(np.diff(split.docs))
    starts, labels = np.append(split.docs[:-1][full], split.docs[-1]), labels[full]
    hashed = words.hashes(split)
    back = rng.random(len(labels)) < 0.2
    model = learn(hashed, starts, labels, ~back)
    model.least = calibrated(model, hashed, starts, labels, back)
    return model


def learn(hashed: np.ndarray, starts: np.ndarray, labels: np.ndarray, use: np.ndarray) -> Model:
    """Stochastic gradient descent, with Adagrad's rates, on the rows that use marks."""
    rng = np.random.default_rng(SEED)
    one, two = grams(hashed, starts)
    model = Model(np.zeros((BUCKETS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES)))
    squares, square_bias = np.full(model.weights.shape, 1e-2, np.float32), np.full(len(FAMILIES), 1e-2)
    for _ in range(ROUNDS):
        for i in rng.permutation(np.flatnonzero(use)).tolist():
            at = np.concatenate([one[starts[i] : starts[i + 1]], two[starts[i] : starts[i + 1]]])
            scale = 1 / np.sqrt(starts[i + 1] - starts[i])
            wrong = softmax((model.weights[at].sum(axis=0) * scale + model.bias)[None])[0]
            wrong[labels[i]] -= 1
            if np.abs(wrong).max() < 1e-3:
                continue
            at = np.unique(at)
            step = (wrong * scale).astype(np.float32)
            squares[at] += step * step
            model.weights[at] -= RATE * step / np.sqrt(squares[at])
            square_bias += wrong * wrong
            model.bias -= RATE * wrong / np.sqrt(square_bias)
    return model


def calibrated(model: Model, hashed: np.ndarray, starts: np.ndarray, labels: np.ndarray, back: np.ndarray) -> float:
    """The probability from which a family counts as known.

    Notices held back say what known families reach. What unknown ones reach, models say that have not seen some of the
    families. The probability is the one that parts the two best, and lets LET_THROUGH of the known through.
    """
    chance = model.probabilities(hashed, starts)
    at = np.flatnonzero(back & (labels > 0))
    known, unknown = chance[at, labels[at]], []
    for fold in range(FOLDS):
        apart = (labels > 0) & (labels % FOLDS == fold)
        seen = learn(hashed, starts, labels, ~back & ~apart).probabilities(hashed, starts)[apart]
        unknown.append(seen[seen[:, 0] < 0.5, 1:].max(axis=1))
    unknown = np.concatenate(unknown)
    if not len(known):
        return 0.5
    tries = np.unique(np.concatenate([known, unknown, [0.5]]))
    cost = np.searchsorted(np.sort(known), tries) / len(known) + (len(unknown) - np.searchsorted(np.sort(unknown), tries)) / max(1, len(unknown))
    return float(min(tries[cost.argmin()], np.quantile(known, 1 - LET_THROUGH)))


def fit(docs: DataFrame) -> Model:
    """A model whose background is a bounded sample of paragraphs of docs(doc_id, text)."""
    # Ids are chosen without their texts; SAMPLE_ROWS of them are broadcast.
    chosen = docs.where("text <> ''").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE_ROWS)
    # Of a longer text a stretch that starts anywhere.
    start = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.greatest(F.length("text") - SAMPLE_BYTES, F.lit(0)) + 1).cast("int") + 1
    stretch = F.when(F.length("text") > SAMPLE_BYTES, F.substring("text", start, F.lit(SAMPLE_BYTES))).otherwise(F.col("text"))
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(stretch).alias("text"))
    return work.fitted(rows, train_on)


def train_on(rows: pa.Table) -> Model:
    """train() on SAMPLE_PIECES pieces of the texts, which a hash chooses, in its order."""
    pieces = {" ".join(own[at : at + PIECE]) for text in rows["text"].to_pylist() for line in text.split("\n") if (own := line.split()) for at in range(0, len(own), PIECE)}
    return train(sorted(pieces, key=lambda x: hashlib.sha256(x.encode()).digest())[:SAMPLE_PIECES])


FOUND = "doc_id long, paragraph int, family string, probability double, held double"


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(found, counts): found has a row for each piece with a licence (doc_id, paragraph, family, probability, held), counts
    a row for each document (doc_id, n_paragraphs, n_licensed, n_unknown, families).
    """
    spark = docs.sparkSession
    work.arrow_batches(spark)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sent = spark.sparkContext.broadcast(fit(docs) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            split, line, by_line, by_run = pieces(batch.column(1))
            hashed, owner = words.hashes(split), split.owner()
            many = np.zeros(batch.num_rows, dtype=np.int64)
            if len(owner):
                np.maximum.at(many, owner, line + 1)
            rows = [[] for _ in range(batch.num_rows)]
            taken = np.zeros(len(split), dtype=bool)

            def add(start: int, family: str, probability: float, held: float):
                rows[owner[start]].append({"paragraph": int(line[start]), "family": family, "probability": float(probability), "held": held})

            seen = windows(hashed, by_run)
            chance = model.of_ranges(hashed, np.array([x[1] for x in seen], np.int64), np.array([x[2] for x in seen], np.int64))
            sure = [(*x, p[x[3]]) for x, p in zip(seen, chance) if p[0] < 0.5 and p[1:].argmax() + 1 == x[3] and p[x[3]] >= model.least]
            for held, start, _, label, probability in apart_from(sure, taken):
                add(start, FAMILIES[label], probability, held)
            for cuts in (by_line, by_run):
                starts, ends = overlapping(cuts)
                chance = model.of_ranges(hashed, starts, ends)
                for i in np.flatnonzero((chance[:, 0] < 0.5) & (chance.argmax(axis=1) > 0)).tolist():  # a family is likelier than none
                    a, b = int(starts[i]), int(ends[i])
                    if taken[a:b].any() or not model.holds_once(hashed[a:b]):
                        continue
                    taken[a:b] = True
                    label = 1 + int(chance[i, 1:].argmax())
                    held = confirmed(hashed[a:b].tolist(), FAMILIES[label])
                    known = held > 0 and chance[i, label] >= model.least
                    add(a, FAMILIES[label] if known else "unknown", chance[i, label], held)
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("held", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), pa.array(rows, kind)], ["doc_id", "n_paragraphs", "found"])

    seen = docs.mapInArrow(run, "doc_id long, n_paragraphs long, found array<struct<paragraph: int, family: string, probability: double, held: double>>")
    found = seen.select("doc_id", F.inline("found"))
    of = lambda test: F.size(F.filter("found", test)).cast("long")
    names = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda x: x["family"]), lambda x: x != "unknown")))
    counts = seen.select("doc_id", "n_paragraphs", of(lambda x: x["family"] != "unknown").alias("n_licensed"), of(lambda x: x["family"] == "unknown").alias("n_unknown"), F.array_join(names, ",").alias("families"))
    return found, counts
