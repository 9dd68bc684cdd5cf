"""Operators on documents, against brute force."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from greffe.llm import bpe, licences, mixing, neardup, repeats, shards, toxicity, words, work

from . import brute


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_word_hashes_agree_with_words():
    texts = ["a b\tc", None, "", "éa b" * 3, "b c a"]
    split = words.split(pa.array(texts))
    hashed = words.hashes(split)
    plain = [w for t in texts for w in brute.WORD.findall(t or "")]
    assert len(plain) == len(hashed)
    assert {(a == b) for a, b in zip(plain, plain)} == {True}
    assert len(set(plain)) == len(set(hashed.tolist()))
    assert Counter(plain).most_common() and sorted(Counter(plain).values()) == sorted(Counter(hashed.tolist()).values())


def test_words_hash_alike_anywhere():
    """A word's hash depends on its bytes alone, whatever its length, place and neighbours."""
    every = ["x" * n for n in range(1, 70)] + ["z" * 5000, "é" * 40]
    alone = [int(words.hashes(words.split(pa.array([w])))[0]) for w in every]
    assert words.hashes(words.split(pa.array(["a " + " b\n".join(every)])))[1::2].tolist() == alone
    assert len(set(alone)) == len(every)
    other = words.hashes(words.split(pa.array([" ".join(every)])), seed=1).tolist()
    assert not set(other) & set(alone)


def thue_morse(n, swap=False):
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_that_polynomials_confuse(spark, n):
    """Two complementary Thue-Morse words collide in every polynomial hash modulo 2^64."""
    own = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join([*own[:6], thue_morse(n, i == 2), *own[6:]])) for i in (1, 2)] + [(3, " ".join([*own[:6], thue_morse(n), *own[6:]]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(table).collect()} == {r[0]: r[1:4] for r in brute.remove_repeats(docs)}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table).collect()}
    assert found == brute.near_duplicates(docs) and found[2][1] == 2 and found[3][1] == 1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (None, 4)] + [(100 + i, 101 + i) for i in range(20)], "a long, b long")
    found = {r.node: r.component for r in work.components(edges, work.WorkTables(spark, "t")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(21)}


def test_near_duplicates(documents, doc_table):
    expected = brute.near_duplicates(documents)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(doc_table).collect()}
    assert found == {i: (n, c, c == i) for i, (n, c) in expected.items()}
    assert sum(i != c for i, (_, c) in expected.items()) > 5


def test_near_duplicates_odd(with_odd_ids, no_docs, documents):
    rows = neardup.near_duplicates(with_odd_ids).collect()
    assert len(rows) == with_odd_ids.count()
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(no_docs).collect() == []


def test_near_duplicates_with_repeated_ids(spark):
    """One id on two texts is a node with the links of both."""
    one, two, three = ([f"{c}{i}" for i in range(60)] for c in "xyz")
    docs = [(5, one), (5, two), (2, [*one[:-1], "end"]), (9, [*two[:-1], "end"]), (7, three), (7, three), (8, three), (8, [*one, "more"])]
    docs = [(i, " ".join(w)) for i, w in docs]
    sets = [(i, brute.shingles(t)) for i, t in docs]
    links = [(a, b) for a, x in sets for b, y in sets if 100 * len(x & y) >= 85 * len(x | y)]
    root = brute.roots(sorted({i for i, _ in docs}), links)
    for parts in (1, 5):
        found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted((i, len(s), root[i]) for i, s in sets)
    assert set(root.values()) == {2}


@pytest.mark.parametrize("percent, own, shared", [(85, 15, 170), (80, 20, 160)])
def test_pairs_at_the_threshold_share_a_deepest_leaf(percent, own, shared):
    """Where every node is large only nodes of the last level are leaves, and RECALL holds for them too."""
    rng, many = np.random.default_rng(8), 8_000
    tokens = rng.integers(0, 1 << 63, (many, shared + 2 * own), dtype=np.uint64)
    one, two = tokens[:, : shared + own], np.hstack([tokens[:, :shared], tokens[:, shared + own :]])
    trees = neardup.tree_count(percent)
    starts = np.arange(many + 1) * (shared + own)
    a, b = (neardup.paths(np.ascontiguousarray(x).ravel(), starts, trees) for x in (one, two))
    deepest = slice(neardup.LEVELS - 2, None, neardup.LEVELS - 1)
    missed = int((~(a[:, deepest] == b[:, deepest]).any(axis=1)).sum())
    assert missed <= 3  # 0.4 are expected


def test_blocks_of_open_leaves_lose_no_link(spark, monkeypatch):
    """A chain whose members are not all like the smallest: leaves stay open and blocks find the rest."""
    base = [f"w{i}" for i in range(200)]
    docs = [(k, " ".join(base[k * 3 : k * 3 + 100])) for k in range(30)]
    monkeypatch.setattr(neardup, "BLOCK", 4)
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {i: c for i, (_, c) in brute.near_duplicates(docs).items()}
    assert set(found.values()) == {0}


def test_repeats(documents, doc_table):
    expected = {r[0]: r[1:4] for r in brute.remove_repeats(documents)}
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(doc_table).collect()}
    assert found == expected
    assert sum(n > 0 for _, n, _ in expected.values()) > 5


def test_repeats_in_many_batches_with_compaction(documents, doc_table, monkeypatch):
    monkeypatch.setattr(repeats, "FAN_IN", 3)
    expected = {r[0]: (r[1], r[2], r[3], " ".join(r[4]) if r[2] else dict(documents)[r[0]]) for r in brute.remove_repeats(documents)}
    rows = repeats.remove_repeats(doc_table, batches=5, extra=["source"], with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in rows} == expected
    assert {r.doc_id: r.extra.source for r in rows} == {r.doc_id: r.source for r in doc_table.collect()}


def test_an_index_outlives_its_session(documents, doc_table, tmp_path):
    """Two later batches, each in a session that knows nothing but the index's folder, equal one run over all rows."""
    expected = {r[0]: (r[1:4], r[4]) for r in brute.remove_repeats(documents)}
    ids = sorted(i for i, _ in documents)
    cuts = [ids[len(ids) // 3], ids[2 * len(ids) // 3]]
    folder = str(tmp_path / "index")
    got = {}
    for r in repeats.remove_repeats(doc_table.where(F.col("doc_id") < cuts[0]), index_folder=folder, batches=1).collect():
        got[r.doc_id] = (r.n_words, r.n_removed, r.kept_sha256)
    for low, high in ((cuts[0], cuts[1]), (cuts[1], ids[-1] + 1)):
        own = doc_table.sparkSession
        for name in [t.name for t in own.catalog.listTables() if t.name.startswith("fingerprints_")]:
            own.sql(f"DROP TABLE {name}")  # runs are external: their files stay, as for a session that has ended
        batch = doc_table.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        rows = repeats.remove_repeats_of_batch(doc_table.where(F.col("doc_id") < low), batch, folder, extra=["source"], with_text=True).collect()
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
        assert all(r.kept_text.split() == " ".join(expected[r.doc_id][1]).split() for r in rows if r.n_removed)
    assert got == {i: x for i, (x, _) in expected.items()}
    index = repeats.FingerprintIndex.open(doc_table.sparkSession, folder)
    assert len(index.numbers) < repeats.FAN_IN and index.last == ids[-1]
    with pytest.raises(ValueError):
        repeats.remove_repeats_of_batch(doc_table, doc_table.where(F.col("doc_id") == ids[0]), folder)


def test_repeats_odd(with_odd_ids, no_docs):
    rows = repeats.remove_repeats(with_odd_ids).collect()
    assert len(rows) == with_odd_ids.count()
    assert [(r.n_words, r.n_removed) for r in rows if r.doc_id is None] == [(5, 0)]
    assert repeats.remove_repeats(no_docs).collect() == []


def test_bpe_equals_merges(tokenizer):
    path, pattern, plain = tokenizer
    code = bpe.coder(path, pattern)
    texts = ["", "Hello world's", "aaaa" * 400, "  \n\n x\t", "naïve café 日本語 <|endoftext|>", "!?" * 300, "".join(chr(c) for c in range(32, 400)), "aaaaab" * 90]
    for text in texts:
        ids = code.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert code.decode(ids) == text.encode()


def test_bpe_round_trip(tokenizer, documents, with_odd_ids, no_docs):
    path, pattern, plain = tokenizer
    rows = bpe.round_trip(with_odd_ids, path, pattern, keep=["source"], with_ids=True).collect()
    texts = dict(documents)
    assert len(rows) == with_odd_ids.count()
    for r in rows:
        if r.doc_id in texts and r.doc_id:
            ids = np.array(plain.encode_ordinary(texts[r.doc_id] or ""), dtype="<u4").tobytes()
            assert (r.token_ids, r.n_tokens, r.ids_sha256) == (ids, len(ids) // 4, hashlib.sha256(ids).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(no_docs, path, pattern).collect() == []
    coded = bpe.decode(bpe.encode(with_odd_ids.where("doc_id > 0"), path, pattern), path, pattern)
    assert {r.doc_id: bytes(r.decoded).decode() for r in coded.collect()} == {i: t or "" for i, t in texts.items() if i}


def test_shards(with_odd_ids, no_docs, documents):
    import zlib

    rows = shards.shard_documents(with_odd_ids, 4).collect()
    assert len(rows) == with_odd_ids.count()
    texts = dict(documents)
    for r in rows:
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
        assert (r.law, r.shard, r.grown_shard) == ("key", brute.jump(key, 4), brute.jump(key, 5))
        if r.doc_id:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for s in range(4):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert {r.size for r in rows if r.text_crc32 == 0} == {1}
    assert shards.shard_documents(no_docs).collect() == []


def test_slots_are_gapless_over_cells(spark, monkeypatch):
    monkeypatch.setattr(shards, "ROWS_A_CELL", 10)
    rows = shards.shard_documents(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 3).collect()
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own))) and len(own) > 100


@pytest.mark.parametrize("in_one_task", [True, False])
def test_mixing_equals_plain_raking(doc_table, no_docs, monkeypatch, in_one_task):
    if not in_one_task:
        monkeypatch.setattr(mixing, "CELLS_A_TASK", 1)
        monkeypatch.setattr(mixing, "ROUNDS_A_LOOK", 3)
        monkeypatch.setattr(mixing, "TOLERANCE", 1e-3)
    clashing = doc_table.select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "?").otherwise(F.col("source")).alias("source"), "lang", "component", F.lit("mine").alias("__source"), F.lit(7).alias("cell"))
    rows = [r.asDict() for r in mixing.mix(clashing, 0.5).collect()]
    assert {r["__source"] for r in rows} == {"mine"} and {r["cell"] for r in rows} == {7}
    dims = [sorted({r[c] for r in rows}, key=repr) for c in ("source", "lang", "topic")]
    assert None in dims[0] and "?" in dims[0]
    tokens = np.zeros([len(d) for d in dims])
    weight, chance = np.zeros_like(tokens), np.zeros_like(tokens)
    for r in rows:
        at = tuple(d.index(r[c]) for d, c in zip(dims, ("source", "lang", "topic")))
        tokens[at] += r["n_tokens"]
        weight[at], chance[at] = r["weight"], r["probability"]
    shares = [tokens.sum(axis=tuple(j for j in range(3) if j != i)) / tokens.sum() for i in range(3)]
    targets = [0.5 * s + 0.5 / len(s) for s in shares]
    assert np.allclose(weight, brute.raked(tokens, targets), atol=1e-4 if in_one_task else 1e-2)
    full = tokens > 0
    assert np.allclose(chance[full], brute.chances(tokens[full], weight[full], 0.5), atol=1e-6)
    if in_one_task:
        draws = {r.doc_id: (r.k % (1 << 64) >> 11) / (1 << 53) for r in doc_table.select("doc_id", F.xxhash64("doc_id", F.lit(1)).alias("k")).collect()}
        assert all(r["sampled"] == (draws[r["doc_id"]] < r["probability"]) for r in rows)
        assert mixing.mix(no_docs).collect() == []
    assert len(rows) == doc_table.count() and {r["component"] for r in rows} == {None}


def test_mixing_says_when_targets_cannot_be_met(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "ab"[i % 2], ["en", "fr"][i % 2]) for i in range(40)], "doc_id long, text string, source string, lang string")
    make = lambda **x: spark.createDataFrame(list(x.items()), "value string, target double")
    rows = mixing.mix(docs, 0.5, {"source": make(a=0.9, b=0.1), "lang": make(en=0.1, fr=0.9)}).collect()
    assert len(rows) == 40 and {r.error > 1 for r in rows} == {True}
    assert {r.error < 1e-6 for r in mixing.mix(docs, 0.5, {"source": make(a=0.9, b=0.1), "lang": make(en=0.9, fr=0.1)}).collect()} == {True}


def test_mixing_targets_and_draws(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "concat('w ', repeat('x y ', int(id % 5))) text", "if(id % 3 = 0, 'a', 'b') source", "if(id % 2 = 0, 'en', 'fr') lang")
    targets = {"source": spark.createDataFrame([("a", 0.8), ("b", 0.2), ("unseen", 3.0)], "value string, target double").where("value <> 'unseen'")}
    rows = mixing.mix(docs, 0.3, targets).collect()
    total = sum(r.n_tokens for r in rows)
    taken = {s: sum(r.n_tokens for r in rows if r.sampled and r.source == s) for s in "ab"}
    assert taken["a"] / sum(taken.values()) == pytest.approx(0.8, abs=0.04)
    assert sum(taken.values()) / total == pytest.approx(0.3, abs=0.03)


def labelled(spark, n=700):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        own = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if bad:
            for _ in range(2):
                own[rng.randrange(len(own))] = rng.choice(["idiot", "loser", "zulp" + rng.choice("abcdef"), "scum,"])
        rows.append((i, " ".join(own), "en" if i % 3 else "fr", int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_toxicity_on_held_out_rows(spark, with_odd_ids, no_docs):
    data = labelled(spark)
    labels = data.select("doc_id", "toxic").unionByName(spark.createDataFrame([(3, None), (None, 1)], "doc_id long, toxic int"))
    rows = {r.doc_id: r for r in toxicity.score(data.drop("toxic"), labels).collect()}
    truth = {r.doc_id: r.toxic for r in data.collect()}
    out = [i for i in truth if rows[i].held_out]
    import zlib

    assert out == [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(rows[i].predicted == truth[i] for i in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    odd = toxicity.score(with_odd_ids, labels)
    assert odd.count() == with_odd_ids.count()
    assert {r.held_out for r in odd.where("doc_id is null").collect()} == {False}
    kept = toxicity.without_toxic(data.drop("toxic"), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}
    assert toxicity.score(no_docs, labels).collect() == []
    nothing = toxicity.score(data.drop("toxic"), labels.where("toxic = 0")).select("score").distinct().collect()
    assert [r.score for r in nothing] == [0.0]


def test_toxicity_scores_equal_a_plain_network(spark):
    """The scores of a trained model against a forward pass word by word."""
    rows = labelled(spark, 200).collect()
    model = toxicity.train([r.text for r in rows], np.array([r.toxic for r in rows]), [r.lang for r in rows])
    texts = ["", "one", *[r.text for r in rows[:20]], " ".join(r.text for r in rows[:60])]
    found = model.scores(pa.array(texts))

    def bucket(word):
        return int(words.hashes(words.split(pa.array([word])))[0] >> np.uint64(40)) % toxicity.BUCKETS

    for text, score in zip(texts, found):
        own = [w for w in re.split(r"[\x00-\x20,.]+", text.lower()) if w]
        vectors = [sum(table[bucket(w[:n])] for table, n in zip(model.tables, (None, 6, 4))) for w in own]
        vectors += [np.zeros(toxicity.DIMS)] * max(0, 3 - len(vectors))
        pooled = []
        for width, kernel, bias in zip(toxicity.WIDTHS, model.kernels, model.biases):
            sums = [bias + sum(vectors[i + j] @ kernel[j] for j in range(width)) for i in range(len(vectors) - width + 1)]
            pooled += np.maximum(np.max(sums, axis=0), 0).tolist()
        logit = float(np.dot(pooled, model.weights) + model.bias)
        known = [sum(float(model.languages[bucket(w) % toxicity.LANGUAGE_BUCKETS, k]) for w in own) for k in range(model.languages.shape[1])]
        expected = 1 / (1 + np.exp(-(logit - model.thresholds[int(np.argmax(known)) if own else 0])))
        assert score == pytest.approx(expected, abs=1e-4)


def test_licences(spark, with_odd_ids, no_docs, documents):
    notices = [(f, x) for f, own in licences.NOTICES.items() for x in own]
    filler = [" ".join(t.split()) for _, t in documents if t and len(t) > 200]
    rows = [(1000 + i, f"{filler[i % len(filler)][:300]}\n{text}\n{filler[0][:50]}", family) for i, (family, text) in enumerate(notices)]
    docs = with_odd_ids.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(a, b, "x") for a, b, _ in rows], "doc_id long, text string, score string"))
    found, counts = licences.scan(docs)
    got = {r.doc_id: r for r in counts.collect()}
    right = sum(got[i].families == f for i, _, f in rows)
    assert right >= len(rows) - 1
    assert all(not r.families for i, r in got.items() if i is not None and i < 1000)
    assert got[1000].n_paragraphs == 3
    where = {(r.doc_id, r.paragraph, r.family) for r in found.collect()}
    assert sum((i, 1, f) in where for i, _, f in rows) >= len(rows) - 1
    assert counts.count() == docs.count()
    assert licences.scan(no_docs)[1].collect() == []


def test_licences_of_unknown_families(spark):
    """Licences that no notice is of count as unknown, and paragraphs are the lines with words."""
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    notices = [" ".join(x.split()[:3]).lower() for own in licences.NOTICES.values() for x in own]
    every = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    documents = [(r.doc_id, r.text) for r in every if not any(x in " ".join((r.text or "").lower().split()) for x in [*notices, "copyright"])]
    texts = ["Licensed under the European Union Public Licence, Version 1.2.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: ISC", "Licensed under the Open Software License version 3.0", "Released under the zlib License.", "Use of this source code is governed by the Artistic License 2.0", "Licensed under the Microsoft Public License."]
    filler = [" ".join(t.split()) for _, t in documents if t and len(t) > 200]
    docs = [(500_000 + i, f"{filler[i % len(filler)][:200]}\n\n{t}\n{filler[-1 - i % len(filler)][:90]}") for i, t in enumerate(texts)] + documents
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string"))[1].collect()}
    unknown = [got[500_000 + i] for i in range(len(texts))]
    assert not any(r.families for r in unknown) and sum(r.n_unknown > 0 for r in unknown) >= len(texts) - 2
    assert not any(got[i].families or got[i].n_unknown for i, _ in documents)

    def lines(text):
        """The number of the last line that has words; punctuation alone is none."""
        full = [k for k, line in enumerate((text or "").split("\n")) if any(c.isalnum() or ord(c) > 127 for c in line)]
        return full[-1] + 1 if full else 0

    assert {i: got[i].n_paragraphs for i, _ in docs} == {i: lines(t) for i, t in docs}


def test_licences_in_wrapped_and_long_paragraphs(spark, documents):
    """Notices over several lines, within longer lines and across the cut of a long line."""
    filler = " ".join(" ".join(t.split()) for _, t in documents if t and 200 < len(t) < 9_000).split()
    around = lambda text, before, after: " ".join([*filler[:before], text, *filler[500 : 500 + after]])
    texts = [
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"),
        ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
        ("gpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License"),
        ("mit", around("Released under the MIT License.", 20, 20)),
        *(("apache-2.0", around(licences.NOTICES["apache-2.0"][1], before, 60)) for before in (30, 36, 44)),
    ]
    docs = spark.createDataFrame([(5000 + i, t) for i, (_, t) in enumerate(texts)] + [(i, t) for i, t in documents], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan(docs)[1].collect()}
    assert [got[5000 + i] for i in range(len(texts))] == [f for f, _ in texts]
    assert not any(got[i] for i, _ in documents)


def test_stars_take_no_round(spark):
    """Each round is several jobs and broadcasts of the driver; components that are stars need none."""
    tables = work.WorkTables(spark, "t")
    edges = spark.createDataFrame([(1, 2), (3, 1), (9, 8), (2, 1), (5, 5), (None, 4)], "a long, b long")
    found = {r.node: r.component for r in work.components(edges, tables).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} and tables.names == {"components-0"}
    assert work.components(edges.limit(0), work.WorkTables(spark, "t")).collect() == []
