import json

import pytest
from pyspark.sql import functions as F

from greffe.sources import documents
from greffe.sources.versions import Conflict, Versions
from greffe.streaming import progress


def ids(df):
    return sorted(r.id for r in df.collect())


def numbers(spark, a, b):
    return spark.range(a, b).withColumn("x", F.col("id") * 2)


def test_snapshots(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    assert table.read() is None and table.versions() == [] and table.compact() is None and table.expire(1) == []
    table.append(numbers(spark, 0, 3))
    old = table.read()
    table.append(numbers(spark, 3, 5), {"me": 7})
    assert ids(old) == [0, 1, 2] and ids(table.read()) == [0, 1, 2, 3, 4] and ids(table.read(0)) == [0, 1, 2]
    table.replace(table.read().where("id > 1"))  # reads what it replaces
    assert ids(table.read()) == [2, 3, 4] and ids(table.read(1)) == [0, 1, 2, 3, 4] and table.manifest().notes == {"me": 7}
    table.replace(numbers(spark, 0, 0))
    assert ids(table.read()) == [] and table.read().columns == ["id", "x"]
    with pytest.raises(ValueError):
        table.append(spark.range(2))


def test_writers_that_began_together(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    base = table.append(numbers(spark, 0, 1))
    table.commit(numbers(spark, 1, 2), base, True)
    with pytest.raises(Conflict):
        table.commit(numbers(spark, 2, 3), base, True)
    assert ids(table.read()) == [0, 1]
    assert [name for name, _ in table._listed("commits") if name.startswith(".") and not name.endswith(".crc")] == []


def test_write_that_ends_early_changes_nothing(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    table.append(numbers(spark, 0, 3))
    with pytest.raises(Exception):
        table.replace(numbers(spark, 0, 9).withColumn("x", F.when(F.col("id") == 5, F.raise_error(F.lit("no"))).otherwise(F.col("x")).cast("long")))
    part = table._written(numbers(spark, 5, 6))  # a crash before publishing
    assert ids(table.read()) == [0, 1, 2] and table.versions() == [0]
    assert table.expire(5) == [] and part.name in {n for n, _ in table._listed("data")}
    table.expire(5, unpublished_after_s=-1)
    assert [n for n, _ in table._listed("data")] == [table.manifest().parts[0].name] and ids(table.read()) == [0, 1, 2]


def test_compaction_and_expiry(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    for k in range(9):
        table.append(numbers(spark, k, k + 1))
        table.compact(lambda rows: rows.dropDuplicates(["id"]), fanout=2)
    assert ids(table.read()) == list(range(9)) and sorted(p.rows for p in table.manifest().parts) == [1, 8]
    gone = table.expire(2)
    assert len(table.versions()) == 2 and not set(gone) & set(table.versions()) and ids(table.read()) == list(range(9))
    assert {n for n, _ in table._listed("data")} == {p.name for v in table.versions() for p in table.manifest(v).parts}


def test_sessions_keep_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    first = documents.save_session(numbers(spark, 0, 2), path)
    seen = documents.restore_session(spark, path, "id long, x long")
    documents.save_session(seen.where("id = 1"), path)  # of itself
    assert ids(documents.restore_session(spark, path, "id long, x long")) == [1]
    assert ids(documents.restore_session(spark, path, "id long, x long", first)) == [0, 1] == ids(seen)
    for _ in range(3):
        documents.save_session(numbers(spark, 7, 8), path, keep=2)
    with pytest.raises(Exception):
        documents.restore_session(spark, path, "id long, x long", first)


class Stream:
    """Verdict files, and runs that follow them."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.files = spark, folder, 0
        (folder / "in").mkdir()
        self.records = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")

    def arrive(self, *verdicts):
        self.files += 1
        rows = [json.dumps({"id": i, "statut": s, "seq": n}) for i, s, n in verdicts]
        (self.folder / "in" / f"{self.files}.json").write_text("\n".join(rows))

    def run(self, checkpoint, **how):
        progress.follow_verdicts(self.spark, self.records, str(self.folder / "in"), str(self.folder / "out"), str(self.folder / checkpoint), **how).awaitTermination()

    def now(self):
        return {r.id: (r.resultat_ia and r.resultat_ia.statut, r.seq) for r in progress.latest_records(self.spark, str(self.folder / "out")).collect()}


def test_late_verdicts_and_a_new_checkpoint(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.arrive(("a", "A5", 5), ("b", "B1", 1), ("b", "B2", 2), (None, "x", 9), ("unknown", "U", 1))
    s.run("c1")
    assert s.now() == {"a": ("A5", 5), "b": ("B2", 2), "c": (None, None)}
    s.arrive(("a", "A3", 3))  # late
    s.run("c1")
    assert s.now()["a"] == ("A5", 5)
    before = progress.latest_records(spark, str(tmp_path / "out"))
    (tmp_path / "in" / "1.json").unlink()
    s.arrive(("c", "C1", 1), ("b", "B0", 0))
    s.run("c2")  # a new run on the output, which sees neither file 1 nor the first run's state
    assert s.now() == {"a": ("A5", 5), "b": ("B2", 2), "c": ("C1", 1)}
    assert {r.id: r.seq for r in before.collect()} == {"a": 5, "b": 2, "c": None}  # a snapshot
    s.records = None
    s.arrive(("b", "Z", 2), ("b", "Y", 2))  # ties: the largest by value, whatever the batch
    s.run("c2")
    assert s.now()["b"] == ("Z", 2)


def test_crash_between_writing_and_publishing(spark, tmp_path, monkeypatch):
    s = Stream(spark, tmp_path)
    s.arrive(("a", "A1", 1))
    s.run("c")
    s.arrive(("a", "A2", 2))

    def crash(self, manifest):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(Versions, "_publish", crash)
        with pytest.raises(Exception, match="crash"):
            s.run("c")
    assert s.now()["a"] == ("A1", 1)
    s.run("c")
    assert s.now()["a"] == ("A2", 2)


def test_crash_after_publishing(spark, tmp_path, monkeypatch):
    """The batch is run again, and published once."""
    s = Stream(spark, tmp_path)
    s.arrive(("a", "A1", 1))

    def crash(self, keep):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(Versions, "expire", crash)
        with pytest.raises(Exception, match="crash"):
            s.run("c")
    versions = Versions(spark, str(tmp_path / "out" / "verdicts"))
    assert s.now()["a"] == ("A1", 1) and versions.versions() == [0]
    s.run("c")
    assert versions.versions() == [0] and s.now()["a"] == ("A1", 1)


def test_batches_write_what_they_touch(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.arrive(*((f"k{i}", "x", 1) for i in range(100)))
    s.arrive(("a", "A", 1))
    s.arrive(("b", "B", 1))
    s.run("c", files_a_batch=1)
    parts = Versions(spark, str(tmp_path / "out" / "verdicts")).manifest().parts
    assert sorted(p.rows for p in parts) == [1, 1, 100]
