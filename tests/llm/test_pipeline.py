"""The corpus pipeline against plain versions of its stages."""

import hashlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from greffe.llm import mixing, toxicity  # noqa: E402

from . import brute  # noqa: E402


def test_stages(spark, doc_table, tmp_path):
    import base64

    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    sf = str(tmp_path)
    toxic = [(9000 + i, f"you utter idiot number {i} and more words", "en", "s0", 5) for i in range(40)]
    clean = [(9500 + i, f"a kind remark number {i} with other words", "en", "s1", 5) for i in range(40)]
    docs = doc_table.select(corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(toxic + clean, "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, *_ in toxic] + [(i, 0) for i, *_ in clean], "doc_id long, toxic int").withColumnRenamed("toxic", "toxic").write.parquet(f"{sf}/labels.parquet")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")

    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    left = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect() if not scores[r.doc_id]]
    assert not any(9000 <= i < 9040 for i, *_ in left) and sum(9500 <= i for i, *_ in left) >= 38
    near = brute.near_duplicates([x[:2] for x in left], corpus_pipeline.SIMILAR)
    left = [x for x in left if near[x[0]][1] == x[0]]
    cut = {r[0]: r for r in brute.remove_repeats([x[:2] for x in left])}
    left = [(i, " ".join(cut[i][4]) if cut[i][2] else t, g, s) for i, t, g, s in left if cut[i][2] < cut[i][1] or not cut[i][1]]
    table = spark.createDataFrame(left, "doc_id long, text string, lang string, source string")
    sampled = {r.doc_id for r in mixing.mix(table, corpus_pipeline.SHARE).where("sampled").collect()}
    left = [x for x in left if x[0] in sampled]
    assert left

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {i: hashlib.sha256(np.array(plain.encode_ordinary(t or ""), dtype="<u4").tobytes()).hexdigest() for i, t, *_ in left}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == expected


def test_near_duplicates_from_80_percent_on(spark):
    """Two of 100 words edited: 86 of 106 shingles are shared, and with three 81 of 111."""
    words = [f"w{i}" for i in range(100)]
    edited = lambda *at: " ".join("new" + str(i) if i in at else w for i, w in enumerate(words))
    docs = [(1, edited()), (2, edited(20, 60)), (3, edited(30, 50, 70)), (4, None)]
    table = spark.createDataFrame([(*d, "en", "s0", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()}
    near = brute.near_duplicates(docs, 80)
    assert left == {i for i, (_, c) in near.items() if i == c} == {1, 3, 4}


def write_tables(spark, docs, folder):
    docs.select(corpus_pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_tables(spark, with_odd_ids, no_docs, tmp_path):
    """Null and repeated ids pass all stages, and an empty table gives an empty one."""
    pytest.importorskip("public_tokenizers")
    rows = corpus_pipeline.run(spark, write_tables(spark, with_odd_ids, tmp_path / "odd")).collect()
    assert rows and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(rows[0].asDict())
    assert {r.doc_id for r in rows} <= {r.doc_id for r in with_odd_ids.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, write_tables(spark, no_docs, tmp_path / "none")).collect() == []


def test_stages_keep_rows_without_an_id(spark, with_odd_ids):
    """A null id is never a near duplicate, and nothing is cut from it."""
    docs = with_odd_ids.select(corpus_pipeline.COLUMNS)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert near.where("doc_id is null").count() == docs.where("doc_id is null").count()
    cut = corpus_pipeline.cut_repeats(spark, docs, "")
    assert {r.text for r in cut.where("doc_id is null").collect()} == {"no id here at all"}
    assert cut.columns == near.columns == corpus_pipeline.COLUMNS
