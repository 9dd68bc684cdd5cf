import random

import pytest
from pyspark.sql import functions as F

from greffe.operators import doctrine, groups, ranking


def table(spark, rows):
    return spark.createDataFrame(rows, "_pos long, k string, g string").repartition(5)


@pytest.mark.parametrize("keys", [1, 3, 400])
def test_ranks_whatever_the_keys(spark, keys):
    """One value for all rows, few values, or as many as rows; nulls come first."""
    rng = random.Random(keys)
    rows = [(i, rng.choice([None, *(f"k{x:04}" for x in range(keys))]), rng.choice(["hot", "hot", "a", None])) for i in range(1500)]
    rng.shuffle(rows)
    found = ranking.ranked(table(spark, rows), [F.col("k"), F.col("_pos")])
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert [(r._pos, r.k, r.g, r.rang) for r in found.orderBy("rang").collect()] == [(*r, i + 1) for i, r in enumerate(order)]
    assert found.dtypes == [("_pos", "bigint"), ("k", "string"), ("g", "string"), ("rang", "int")]
    within = ranking.ranked(table(spark, rows), [F.col("k"), F.col("_pos")], "own", {"g": F.col("g")})
    for g in ("hot", "a", None):
        mine = [r[0] for r in order if r[2] == g]
        assert [r._pos for r in within.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("own").collect()] == mine
        assert sorted(r.own for r in within.where(F.col("g").eqNullSafe(F.lit(g))).collect()) == list(range(1, len(mine) + 1))


def test_no_task_gets_the_hot_key(spark):
    """All rows share every key but the position: ranges cut them all the same, and nothing is a window."""
    rows = spark.range(20_000).select(F.col("id").alias("_pos"), F.lit("1").alias("numero"), F.lit("1").alias("article"), F.lit("Supprimer cet article").alias("dispositif"), F.array(F.lit("A")).alias("auteurs"), F.lit(None).cast("boolean").alias("rapporteur"))
    for found in (ranking.presort(rows, "B"), ranking.presort(rows, "A"), groups.identiques(ranking.presort(rows, "B")), doctrine.same_text(rows), doctrine.order_of_identiques(rows)):
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    sizes = [r["count"] for r in ranking.presort(rows, "B").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000
    assert [r.rang for r in ranking.presort(rows, "B").orderBy("_pos").select("rang").collect()] == list(range(1, 20_001))


def test_none(spark):
    assert ranking.ranked(table(spark, []), [F.col("_pos")]).collect() == []
    assert ranking.ranked(table(spark, []), [F.col("_pos")], within={"g": F.col("g")}).columns == ["_pos", "k", "g", "rang"]


@pytest.mark.parametrize("many", [0, 1, 100])
def test_many_moves_are_as_many_splices(spark, many):
    rng = random.Random(many)
    moves = [(rng.randrange(60), rng.randrange(60)) for _ in range(many)]
    plain = [f"k{i}" for i in range(60)]
    for source, target in moves:
        plain.insert(target, plain.pop(source))
    df = spark.createDataFrame([(i, f"k{i}") for i in range(60)], "_pos int, k string").repartition(3)
    found = ranking.moved_many(df, moves)
    assert [(r._pos, r.k) for r in found.orderBy("_pos").collect()] == list(enumerate(plain)) and found.dtypes == df.dtypes
    assert len(ranking.folded(moves, 60)) <= many


def test_moves_of_a_list_of_any_length():
    """Folding looks at the moves alone."""
    assert ranking.folded([(10**12 - 1, 0), (0, 10**12 - 1)], 10**12) == [(10**12 - 1, 10**12 - 2, 1)]
    with pytest.raises(ValueError):
        ranking.folded([(5, 0)], 5)


def test_headers_within_a_hot_key(spark):
    """Sections of lists by key, of which one is much longer than a range, with a key that is null."""
    rows = [(i, ["hot", "hot", "b", None][i % 4], f"{i // 700}") for i in range(6000)]
    df = spark.createDataFrame(rows, "_pos long, g string, article string").repartition(4)
    last, want = {}, {}
    for i, g, article in rows:
        want[i] = last.get(g) != article
        last[g] = article
    assert {r._pos: r.new_section for r in groups.with_headers(df, "_pos", ["g"]).collect()} == want
