"""Ranges of alinéas and falls by vote against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from greffe.operators import doctrine, ranking


@pytest.mark.parametrize("text, want", [("Supprimer les alinéas 31 à 33", (31, 33)), ("Rédiger ainsi les alinéas 2 et 3", (2, 3)), ("Rédiger ainsi l'alinéa 58", (58, 58)), ("Supprimer l'alinéa 1er", (1, 1)), ("De l'alinéa 4 à l'alinéa 9", (4, 9)), ("alinéas 9 à 7", (7, 9)), ("Supprimer cet article 12", None), (None, None), ("les alinéas", None)])
def test_impact_range(spark, text, want):
    found = spark.createDataFrame([(text,)], "t string").select(doctrine.impact_range(F.col("t")).alias("x")).first().x
    assert (tuple(found) if found else None) == want
    given = spark.createDataFrame([(text, 5)], "t string, a int").select(doctrine.impact_range(F.col("t"), F.col("a")).alias("x")).first().x
    assert tuple(given) == (want or (5, 5))


def test_ranges_that_meet(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        low = rng.randint(1, 60)
        own = (low, low + rng.choice([0, 0, 1, 4])) if i % 9 else (None, None)
        rows.append((f"r{i}", rng.choice(["hot", "hot", "a", "b"]), *own))
    df = spark.createDataFrame(rows, "id string, article string, f int, l int").withColumn("impact", F.when(F.col("f").isNotNull(), F.struct(F.col("f").alias("first"), F.col("l").alias("last"))))
    found = {r.id: r for r in doctrine.range_discussions(df).collect()}
    assert len(found) == 400
    meets = lambda x, y: x[1] == y[1] and x[2] is not None and y[2] is not None and x[2] <= y[3] and y[2] <= x[3]
    chain = {r[0]: r[0] for r in rows}
    for x in rows:
        assert found[x[0]].overlaps == sum(meets(x, y) for y in rows) - meets(x, x)
        for y in rows:
            if meets(x, y):
                old, new = chain[y[0]], chain[x[0]]
                chain = {k: new if v == old else v for k, v in chain.items()}
    for x in rows:
        own = [y for y in rows if chain[y[0]] == chain[x[0]]]
        low, high = (min(y[2] for y in own), max(y[3] for y in own)) if x[2] is not None else (0, 0)
        assert found[x[0]].groupe_id == (f"discussion-commune-art{x[1]}-al{low}" + (f"-{high}" if high > low else "") if len(own) > 1 else None)
    assert doctrine.range_discussions(df.where("false")).collect() == []


@pytest.mark.parametrize("shuffled", [False, True])
def test_falls_by_vote(spark, shuffled):
    """In the order of the presort, and in any other."""
    rng = random.Random(7)
    rows = [(f"r{i}", rng.choice(["1", "1", "2", "3", "4"]), rng.choice([None, 1, 2, 3]), rng.choice([1, 2, 3, 4, 5, 5, 5]) if i % 40 else 1) for i in range(300)]
    rows = [r if r[1] != "1" or r[3] > 1 else (*r[:3], 5) for r in rows]
    rows = [r if r[1:3] != ("1", 2) or r[3] != 3 else (*r[:3], 4) for r in rows]  # an alinéa that is rewritten only
    order = rows if shuffled else sorted(rows, key=lambda r: (r[1], r[3]))
    df = spark.createDataFrame([(*r, k + 1) for k, r in enumerate(order)], "id string, article string, alinea int, priorite int, rang int").repartition(3)
    fell, adopted = {}, []
    for own, article, alinea, priority in order:
        hit = next(((c, p) for c, a, al, p in adopted if a == article and (p == 1 or al is not None and al == alinea and (p == 3 or p == 4 and priority == 5))), None)
        if hit:
            fell[own] = (hit[0], {1: "article", 3: "alinea", 4: "redaction"}[hit[1]])
        else:
            adopted.append((own, article, alinea, priority))
    assert {r.id: (r.cause, r.kind) for r in doctrine.falls_in_order(df).collect()} == fell
    assert {k for _, k in fell.values()} == {"article", "alinea", "redaction"}
    assert ranking.ranked(df, [F.col("rang")], "again").where("again <> rang").isEmpty()
