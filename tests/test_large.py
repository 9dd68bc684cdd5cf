import json
import random

import pytest
from pyspark.sql import functions as F

from greffe.operators import report
from greffe.sources import documents, large


@pytest.fixture
def small_ranges(spark):
    """Ranges of a kilobyte."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "1024")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


NASTY = ["plain", "a,b", 'quote " inside', "back\\slash", '\\"', "],}{[", '"},{"', "é,\n\t", "", "amendements", '{"amendement": [1,2]}']


def invented(rng, n):
    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 6:
            return {rng.choice([*NASTY, "id", "uid"]) + str(i): value(depth - 1) for i in range(rng.randrange(4))}
        return rng.choice(NASTY) if kind < 3 else None if kind == 3 else rng.random()

    return [{"id": f"r{i}", "v": value(3), "t": rng.choice(NASTY)} for i in range(n)]


def agree(spark, folder):
    def of(read):
        records, bad = read(spark, str(folder))
        return sorted((r.file, r._index, r.raw) for r in records.select("file", "_index", F.to_json("raw").alias("raw")).collect()), sorted((r.file, r.reason) for r in bad.collect())

    found, plain = of(large.read_large_documents), of(documents.read_json_documents)
    for mine, theirs in zip(found, plain):
        assert [x for x in mine if x not in theirs] == [x for x in theirs if x not in mine] == []
    assert found == plain
    return found


def test_envelopes_over_ranges(spark, tmp_path, small_ranges):
    """Each envelope, with other members around it, compact and indented, against reading whole files."""
    rng = random.Random(1)
    own = invented(rng, 60)
    cases = [own, {"amendments": own}, {"amendments": own[0]}, {"amendements": own}, {"amendements": {"amendement": own}}, {"amendements": {"amendement": own[1]}}, {"amendements": own[2]}, {"amendement": own}, {"amendement": own[3]}, {"uid": "u", "x": own}]
    cases += [{"meta": {"amendement": [1, 2], "a": [3]}, "amendements": {"total": 3, "amendement": own, "z": [1]}, "amendement": [5]}, {"n": [1, {"amendments": [9]}], "amendments": own, "later": own[:5]}, {"amendements": own, "amendments": own[:7]}, {"amendment": own, "amendement": own[:3]}]
    cases += [[], {"amendments": []}, {"amendements": {"amendement": []}}, [1, "a,b", None, [1, 2], {"x": [1]}, [[]]], [own[0]], {"x": 1}, [[1, 2], [3, [4]]]]
    for i, case in enumerate(cases):
        (tmp_path / f"c{i:02}.json").write_text(json.dumps(case))
        (tmp_path / f"p{i:02}.json").write_text("\n" + json.dumps(case, indent=3, ensure_ascii=False) + "\n")
    (tmp_path / "bad.json").write_text("not json")
    (tmp_path / "empty.json").write_text("")
    records, bad = agree(spark, tmp_path)
    assert len(records) > 800 and len(bad) >= 3
    blocks = large.pieces(spark, str(tmp_path), "c00.json").select("block").distinct().count()
    assert blocks > 3


def test_a_broken_record_is_alone(spark, tmp_path, small_ranges):
    text = json.dumps([{"id": i, "t": "x" * 50} for i in range(200)]).replace('"id": 77,', '"id": 7x7,')
    (tmp_path / "a.json").write_text(text)
    records, bad = large.read_large_documents(spark, str(tmp_path))
    assert sorted(r._index for r in records.collect()) == [i for i in range(200) if i != 77]
    assert [r.reason for r in bad.collect()] == ["not JSON"]


@pytest.mark.parametrize("cuts", [1, 7, 50])
def test_a_document_cut_anywhere(spark, tmp_path, small_ranges, cuts):
    """Files that end within strings, numbers and names are one document."""
    rng = random.Random(cuts)
    own = invented(rng, 40)
    text = json.dumps({"meta": [1], "amendements": {"n": 2, "amendement": own}}, indent=1)
    at = sorted(rng.sample(range(1, len(text)), cuts))
    for k, (a, b) in enumerate(zip([0, *at], [*at, len(text)])):
        (tmp_path / f"part-{k:03}").write_text(text[a:b])
    records, bad = large.read_large_documents(spark, str(tmp_path), "part-*", joined=True)
    assert bad.isEmpty() and [json.loads(r.raw) for r in records.orderBy("_index").select(F.to_json("raw").alias("raw")).collect()] == json.loads(json.dumps(own))


def test_written_document_is_one(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 10, f"k{i}", rng.choice(NASTY), None if i % 3 else i) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "_pos long, id string, t string, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one file
    report.write_json_document(df, str(tmp_path / "out"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert len(files) > 1 and json.loads(text) == json.loads(report.json_document(df).first().document)
    (tmp_path / "one.json").write_text(text)
    records, _ = large.read_large_documents(spark, str(tmp_path), "one.json")
    assert [r.id for r in records.orderBy("_index").select(F.try_variant_get("raw", "$.id", "string").alias("id")).collect()] == [f"k{i}" for i in range(500)]
    parts, bad = large.read_large_documents(spark, str(tmp_path / "out"), "part-*", joined=True)
    assert bad.isEmpty() and sorted((r.file, r._index, r.raw) for r in parts.select("file", "_index", F.to_json("raw").alias("raw")).collect()) == sorted((str(tmp_path / "out"), r._index, r.raw) for r in records.select("_index", F.to_json("raw").alias("raw")).collect())
    report.write_json_document(df.where("false"), str(tmp_path / "none"))
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "none").glob("part-*")))) == {"amendements": []}


@pytest.mark.parametrize("test", ["envelopes", "cut"])
def test_units_of_four_pieces(spark, tmp_path, small_ranges, monkeypatch, test):
    monkeypatch.setattr(large, "UNIT", 2)
    monkeypatch.setattr(large, "TASK", 2000)
    if test == "cut":
        test_a_document_cut_anywhere(spark, tmp_path, None, 7)
    else:
        test_envelopes_over_ranges(spark, tmp_path, None)


def test_a_text_is_shuffled_twice(spark, tmp_path, monkeypatch):
    """Once by unit, once by record: what is shuffled is less than four times the document, which hardly compresses."""
    monkeypatch.setattr(large, "TASK", 20_000, raising=False)
    rng = random.Random(3)
    text = json.dumps({"amendements": [{"id": f"{i}", "t": f'{rng.getrandbits(64):x}, "{rng.getrandbits(64):x}'} for i in range(30_000)]})
    third = len(text) // 3
    for k in range(3):
        (tmp_path / f"part-{k}").write_text(text[k * third : (k + 1) * third if k < 2 else None])

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    records, _ = large.read_large_documents(spark, str(tmp_path), "part-*", joined=True)
    assert records.select(F.count_distinct("_index")).first()[0] == 30_000
    ratio = (shuffled() - before) / len(text)
    print("shuffled, times the document:", ratio)
    assert ratio < 4
