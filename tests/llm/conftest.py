import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, nodes string, task int, component string, score string, found int, shard string, windows int"


def invented(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(n))


def odd_rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, and a repeated row."""
    rng = random.Random(1)
    base = [invented(rng, rng.choice([3, 8, 40, 120, 300])) for _ in range(30)]
    passage = invented(rng, 60)
    texts = list(base)
    texts += [base[4], base[4], base[5] + " end", base[6].upper()]
    for i in range(6):
        words = base[9].split() + invented(rng, 150).split()[:40]
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += [f"{invented(rng, 20)}\n{passage}\t{invented(rng, 15)}" for _ in range(5)]
    texts += [None, "", "  \n\t ", "one", "one", "a b c d", "a b c d", "é ü 日本 \u00a0x", invented(rng, 30_000), passage]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def documents():
    return odd_rows()


@pytest.fixture(scope="session")
def doc_table(spark, documents):
    """The odd documents with columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", "fr", None][k % 3], [f"s{k % 2}", None][k % 7 == 0], len(t or ""), "x", k, None, "y", 1, "z", 2) for k, (i, t) in enumerate(documents)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def with_odd_ids(spark, doc_table):
    """With a null id and repeated rows too."""
    more = [(None, "no id here at all", "en", "s0", 1, "x", 1, None, "y", 1, "z", 2), (0, None, None, None, None, None, None, None, None, None, None, None)]
    twice = doc_table.where("doc_id in (6, 12)")
    return doc_table.unionByName(twice).unionByName(spark.createDataFrame(more, DOCS))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
