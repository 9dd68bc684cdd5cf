"""Operator 2: substring dedup with a log-structured fingerprint index.

A word that is covered by a window of WINDOW words goes if the window's word sequence also starts in a document with a
smaller doc_id. Every window is represented by the anchor of least hash among the ANCHOR-word sequences in it, so equal
windows have equal anchors, and neighbouring windows mostly share one: the index holds about a quarter as many
fingerprints as there are windows.

Documents come in batches. A batch's fingerprints are written as an immutable run: a table bucketed and sorted by
fingerprint, which is merge-joined with the runs before it without another shuffle. Fingerprints that several different
texts hold name the documents to look at; there, the windows of just these anchors are verified by two independent
64-bit digests of their full word sequences, down to the bytes. When there are FAN_IN runs, they are compacted into one.
An index can outlive its session: a later batch meets the runs of all batches before it.

A fingerprint or window that many documents of one Arrow batch share leaves it once; the other documents go into the
run's overflow table, or have their words removed on the spot. So a passage that a third of all documents hold meets in
no single task. Exact copies of a text are resolved by its digest and have no fingerprints looked at.

Null and empty texts have no words. A null doc_id is not compared: nothing is removed. Rows with the same doc_id never
remove from each other, as no id is smaller. Further columns pass through or are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words, work

U = np.uint64
WINDOW, ANCHOR = 13, 7
#: Runs after which they are compacted into one.
FAN_IN = 2
#: Batches in which a whole table is fed to the index: the last one meets a compacted run.
BATCHES = 3
#: Bytes of text for each bucket of the runs.
BUCKET_BYTES = 1 << 30
FINGERPRINTS = "fp long, doc_id long, digest long, shared boolean"


def anchors(word: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word positions at which windows start, and the fingerprint of each window's anchor."""
    at = words.inside(docs, WINDOW)
    if not len(at):
        return at, np.zeros(0, U)
    return at, words.sliding_min(words.windows(word, ANCHOR), WINDOW - ANCHOR + 1)[at]


def owners(at: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return np.searchsorted(docs, at, side="right") - 1


def fingerprints(docs: DataFrame, first: bool) -> DataFrame:
    """fp, doc_id, digest, shared of docs(doc_id, text, digest).

    first: for each fingerprint of an Arrow batch its first document; shared says whether other texts of the batch have
    it too. Otherwise those others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = words.split(batch.column(1))
            at, fp = anchors(words.hashes(split), split.docs)
            ids, digest = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            owner = owners(at, split.docs)
            changed = np.ones(len(at), dtype=bool)
            changed[1:] = (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])
            fp, owner = fp[changed], owner[changed]
            by_id = np.empty(len(ids), dtype=np.int64)
            order = np.lexsort((digest, ids))
            by_id[order] = np.arange(len(ids))
            sort = np.lexsort((by_id[owner], fp))
            fp, owner = fp[sort], owner[sort]
            start = np.ones(len(fp), dtype=bool)
            start[1:] = fp[1:] != fp[:-1]
            group = np.cumsum(start) - 1
            lead = owner[np.flatnonzero(start)]
            other = digest[owner] != digest[lead[group]] if len(fp) else np.zeros(0, bool)
            if first:
                shared = np.zeros(len(lead), dtype=bool)
                shared[group[other]] = True
                pick, flag = start, shared
            else:
                pick = other.copy()
                pick[1:] &= (owner[1:] != owner[:-1]) | (fp[1:] != fp[:-1])
                flag = np.ones(int(pick.sum()), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(fp[pick].view(np.int64)), pa.array(ids[owner[pick]]), pa.array(digest[owner[pick]]), pa.array(flag)], ["fp", "doc_id", "digest", "shared"])

    return docs.where("doc_id is not null").select("doc_id", "text", "digest").mapInArrow(run, FINGERPRINTS)


class FingerprintIndex:
    """Sorted immutable runs of fingerprints under a folder: ingest() adds a batch, and finds what it shares with itself and with history.

    save() notes the runs in the folder; open() finds them there again, also in another session.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, numbers: list[int] | None = None, made: int = 0, last: int | None = None):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.numbers, self.made, self.last = list(numbers or []), made, last
        self.label = f"fingerprints_{hashlib.sha256(self.folder.encode()).hexdigest()[:16]}"

    @staticmethod
    def open(spark: SparkSession, folder: str) -> "FingerprintIndex":
        """The index that save() left."""
        noted = spark.read.parquet(f"{folder.rstrip('/')}/noted").orderBy(F.desc("version")).first()
        index = FingerprintIndex(spark, folder, noted["buckets"], noted["numbers"], noted["made"], noted["last"])
        for number in index.numbers:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {index._table(number)} ({FINGERPRINTS}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {index.buckets} BUCKETS LOCATION '{index.folder}/run-{number}'")
        return index

    def save(self) -> None:
        version = self.spark.createDataFrame([(self.buckets, self.numbers, self.made, self.last)], "buckets int, numbers array<int>, made int, last long")
        version.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/noted/version={self.made}")

    def _table(self, number: int) -> str:
        return f"{self.label}_{number}"

    def _run(self, number: int) -> DataFrame:
        return self.spark.table(self._table(number))

    def _overflow(self, number: int) -> DataFrame:
        return self.spark.read.schema(FINGERPRINTS).parquet(f"{self.folder}/overflow-{number}")

    def _write(self, rows: DataFrame, more: DataFrame) -> int:
        number, self.made = self.made, self.made + 1
        sorted_run = rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet")
        sorted_run.option("path", f"{self.folder}/run-{number}").saveAsTable(self._table(number))
        more.write.parquet(f"{self.folder}/overflow-{number}")
        return number

    def ingest(self, batch: DataFrame) -> DataFrame:
        """fp, doc_id of the documents, old or new, whose anchors the batch shares with another text."""
        number = self._write(fingerprints(batch, True), fingerprints(batch, False))
        of_run = lambda n: self._run(n).groupBy("fp").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.max("shared").alias("shared"))
        agreed = of_run(number)
        for old in self.numbers:
            agreed = agreed.join(of_run(old).toDF("fp", "old_low", "old_high", "old_shared"), "fp", "left")
            together = [F.least("low", "old_low").alias("low"), F.greatest("high", "old_high").alias("high"), (F.col("shared") | F.coalesce("old_shared", F.lit(False))).alias("shared")]
            agreed = agreed.select("fp", *together)
        # As a table it is shuffled anew for each join, so that Spark can split a fingerprint with very many documents.
        agreed = keep(agreed.where("shared or low < high").select("fp"), f"{self.folder}/agreed-{number}")
        found = None
        for n in (*self.numbers, number):
            for rows in (self._run(n), self._overflow(n)):
                own = rows.join(agreed, "fp", "left_semi").select("fp", "doc_id")
                found = own if found is None else found.unionByName(own)
        found = keep(found, f"{self.folder}/hits-{number}")
        work.empty(self.spark, f"{self.folder}/agreed-{number}")
        self.numbers.append(number)
        highest = batch.agg(F.max("doc_id")).first()[0]
        self.last = max((x for x in (self.last, highest) if x is not None), default=None)
        if len(self.numbers) >= FAN_IN:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one. Rows of every document stay, as a later window may agree with any of them."""
        rows = more = None
        for n in self.numbers:
            rows = self._run(n) if rows is None else rows.unionByName(self._run(n))
            more = self._overflow(n) if more is None else more.unionByName(self._overflow(n))
        merged = self._write(rows, more)
        self._forget(self.numbers)
        self.numbers = [merged]

    def _forget(self, numbers: list[int]) -> None:
        for n in numbers:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(n)}")
            work.empty(self.spark, f"{self.folder}/run-{n}")
            work.empty(self.spark, f"{self.folder}/overflow-{n}")

    def drop(self) -> None:
        self._forget(self.numbers)
        self.numbers = []


def keep(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cover(at: np.ndarray, many: int) -> np.ndarray:
    """Which of so many words windows that start at these positions cover."""
    edges = np.zeros(many + WINDOW + 1, dtype=np.int32)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return np.cumsum(edges)[:many] > 0


def kept_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray | None = None) -> bytes:
    """The words that stay, joined by one space."""
    if gone is not None:
        starts, ends = starts[~gone], ends[~gone]
    raw = data.tobytes() if len(starts) else b""
    return b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])


def by_window(one: np.ndarray, two: np.ndarray, at: np.ndarray) -> list[dict]:
    """One entry a window, with all places of a document where it starts."""
    order = np.lexsort((at, two, one))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    first = np.flatnonzero(new)
    places = at[order].tolist()
    return [{"one": x, "two": y, "at": places[i:j]} for x, y, i, j in zip(one[order[first]].tolist(), two[order[first]].tolist(), first.tolist(), [*first[1:].tolist(), len(order)])]


def scan(docs: DataFrame, with_text: bool) -> DataFrame:
    """One row a document of docs(doc_id, text, copy, fps, digest, extra): what is settled at once, and the windows to look up elsewhere.

    copy: an earlier document has the same text. fps: the document's shared anchors. Settled documents have
    kept_sha256. The others have text, gone (starts of windows that an earlier document of the Arrow batch has too) and
    windows (digests of the others).
    """
    schema = T.StructType([*docs.select("doc_id", "digest", "extra").schema.fields, *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, text string, gone array<int>, windows array<struct<one: long, two: long, at: array<int>>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            split = words.split(texts)
            hashed = words.hashes(split)
            at, fp = anchors(hashed, split.docs)
            one = words.windows(hashed, WINDOW, seed=1)[at] if len(at) else np.zeros(0, U)
            two = words.windows(words.hashes(split, seed=1), WINDOW, seed=2)[at] if len(at) else np.zeros(0, U)
            owner = owners(at, split.docs)
            lists = batch.column(3)
            asked = np.zeros(len(at), dtype=bool)
            cuts = np.searchsorted(at, split.docs)
            ids = batch.column(0).fill_null(0).to_numpy()
            for i in range(batch.num_rows):
                if lists[i].is_valid and cuts[i] < cuts[i + 1]:
                    wanted = np.sort(lists[i].values.to_numpy(zero_copy_only=False).view(U))
                    own = fp[cuts[i] : cuts[i + 1]]
                    asked[cuts[i] : cuts[i + 1]] = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own if len(wanted) else False
            ask = np.flatnonzero(asked)
            # In the batch, all but the documents of the smallest id lose the window now; one row of it is looked up.
            order = ask[np.lexsort((at[ask], ids[owner[ask]], two[ask], one[ask]))]
            start = np.ones(len(order), dtype=bool)
            start[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
            least = ids[owner[order[np.flatnonzero(start)]]][np.cumsum(start) - 1] if len(order) else ids[:0]
            lost = ids[owner[order]] > least
            gone, look = np.sort(order[lost]), np.sort(order[~lost])
            gone_cuts, look_cuts = np.searchsorted(at[gone], split.docs), np.searchsorted(at[look], split.docs)
            removed, kept, text, gones, looks = [], [], [], [], []
            raw = split.data.tobytes()
            for i in range(batch.num_rows):
                a, b = int(split.docs[i]), int(split.docs[i + 1])
                copy = batch.column(2)[i].as_py()
                mine, theirs = gone[gone_cuts[i] : gone_cuts[i + 1]], look[look_cuts[i] : look_cuts[i + 1]]
                if copy or not len(mine) and not len(theirs):
                    bare = copy and b - a >= WINDOW
                    stays = b"" if bare else b" ".join([raw[x:y] for x, y in zip(split.starts[a:b].tolist(), split.ends[a:b].tolist())])
                    removed.append(b - a if bare else 0)
                    kept.append(hashlib.sha256(stays).hexdigest())
                    text.append(("" if bare else texts[i].as_py()) if with_text else None)
                    gones.append([])
                    looks.append([])
                else:
                    removed.append(None)
                    kept.append(None)
                    text.append(texts[i].as_py())
                    gones.append((at[mine] - a).tolist())
                    looks.append(by_window(one[theirs].view(np.int64), two[theirs].view(np.int64), at[theirs] - a))
            found = [pa.array(np.diff(split.docs)), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(text, pa.string()), pa.array(gones, pa.list_(pa.int32())), pa.array(looks, pa.list_(pa.struct([("one", pa.int64()), ("two", pa.int64()), ("at", pa.list_(pa.int32()))])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(5), *found], schema.names)

    return docs.select("doc_id", "text", "copy", "fps", "digest", "extra").mapInArrow(run, schema)


def finish(rows: DataFrame, with_text: bool) -> DataFrame:
    """rows(doc_id, text, gone, found, n_words, extra): remove the windows that start at gone and found."""
    schema = T.StructType([*rows.select("doc_id", "n_words", "extra").schema.fields, *T.StructType.fromDDL("n_removed long, kept_sha256 string, kept_text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = words.split(batch.column(1))
            removed, sha, texts = [], [], []
            for i in range(batch.num_rows):
                a, b = split.docs[i], split.docs[i + 1]
                at = [x.values.to_numpy(zero_copy_only=False) for x in (batch.column(2)[i], batch.column(3)[i]) if x.is_valid]
                gone = cover(np.concatenate(at).astype(np.int64) if at else np.zeros(0, np.int64), int(b - a))
                low, high = (split.starts[a], split.ends[b - 1]) if b > a else (0, 0)
                stays = kept_text(split.data[low:high], split.starts[a:b] - low, split.ends[a:b] - low, gone)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(stays).hexdigest())
                texts.append((stays.decode() if gone.any() else batch.column(1)[i].as_py()) if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(5), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], schema.names)

    return rows.select("doc_id", "text", "gone", "found", "n_words", "extra").mapInArrow(run, schema)


def prepared(docs: DataFrame, id_col: str, text_col: str, extra: list[str] | None) -> DataFrame:
    carried = F.struct(*[docs[c] for c in extra]) if extra else F.lit(None).cast("boolean")
    text = docs[text_col]
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"), carried.alias("extra"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, extra: list[str] | None = None, with_text: bool = False, index_folder: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    with_text: kept_text too, the text itself where nothing went. extra: columns to carry along in a struct of that name.
    index_folder: a new folder in which the index stays, for remove_repeats_of_batch().
    """
    spark = docs.sparkSession
    work.arrow_batches(spark)
    tables = work.WorkTables(spark, "repeats")
    docs = prepared(docs, id_col, text_col, extra)
    parts, total = in_order(docs, batches)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    index = FingerprintIndex(spark, index_folder or f"{tables.root}/index", buckets)
    hits = None
    for part in parts:
        found = index.ingest(part)
        hits = found if hits is None else hits.unionByName(found)
    if index_folder:
        index.save()
    facts = facts_of(docs, hits, tables)
    if not index_folder:
        index.drop()
    return settled(docs, facts, tables, extra, with_text)


def remove_repeats_of_batch(history: DataFrame, batch: DataFrame, index_folder: str, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """As remove_repeats(), for the rows of a later batch: what is in history, whose index is in the folder, goes from it too.

    The batch's ids are larger than all of history's, so nothing that was decided before changes. The batch is added to
    the index.
    """
    spark = batch.sparkSession
    work.arrow_batches(spark)
    tables = work.WorkTables(spark, "repeats")
    old, new = prepared(history, id_col, text_col, None), prepared(batch, id_col, text_col, extra)
    index = FingerprintIndex.open(spark, index_folder)
    before, lowest = index.last, new.agg(F.min("doc_id")).first()[0]
    if before is not None and lowest is not None and lowest <= before:
        raise ValueError(f"a batch's ids must be above those of the index; {lowest} is not above {before}")
    hits = index.ingest(new)
    index.save()
    every = old.select("doc_id", "text", "digest", F.lit(None).cast(new.schema["extra"].dataType).alias("extra"), F.lit(True).alias("old")).unionByName(new.withColumn("old", F.lit(False)))
    facts = facts_of(every, hits, tables)
    # Of history only documents that share an anchor with the batch are read again.
    named = facts.where("size(fps) > 0").select("doc_id")
    asked = new.unionByName(every.where("old").join(named, "doc_id", "left_semi").drop("old"))
    done = settled(asked, facts, tables, extra, with_text)
    return done if before is None else done.where(F.col("doc_id").isNull() | (F.col("doc_id") > before))


def facts_of(docs: DataFrame, hits: DataFrame, tables: work.WorkTables) -> DataFrame:
    """doc_id, copy, fps of the documents that are copies or hold shared anchors."""
    per_doc = hits.groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
    facts = per_doc.join(copies_of(docs, tables), "doc_id", "full").select("doc_id", "fps", F.coalesce("copy", F.lit(False)).alias("copy"))
    return tables.keep(facts.select("doc_id", "copy", F.when(~F.col("copy"), F.col("fps")).alias("fps")), "facts")


def settled(docs: DataFrame, facts: DataFrame, tables: work.WorkTables, extra: list[str] | None, with_text: bool) -> DataFrame:
    """The result for docs: their shared anchors' windows are looked up among each other, and removed."""
    asked = docs.join(facts, "doc_id", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    seen = tables.keep(scan(asked, with_text), "scan")

    windows = seen.where("size(windows) > 0").select("doc_id", "digest", F.inline("windows"))
    first = windows.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # As a table of its own it is shuffled anew for the join, so that Spark can split a window with very many documents.
    first = tables.keep(first.select("one", "two", "first"), "first-windows")
    found = windows.join(first, ["one", "two"]).where("first < doc_id").groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("found"))
    found = tables.keep(found, "found")
    tables.drop("facts", "first-copies", "first-windows")
    apart = seen.where("kept_sha256 is not null").select("doc_id", "n_words", "extra", "n_removed", "kept_sha256", F.col("text").alias("kept_text"))
    rest = seen.where("kept_sha256 is null").select("doc_id", "digest", "n_words", "text", "gone", "extra").join(found, ["doc_id", "digest"], "left")
    done = apart.unionByName(finish(rest, with_text))
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text, *["extra"] * bool(extra))


def in_order(docs: DataFrame, batches: int) -> tuple[list[DataFrame], int]:
    """The documents cut into batches by quantiles of doc_id, smallest ids first; and the bytes of all texts."""
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit(i / batches) for i in range(1, batches)]), F.lit(1000)) if batches > 1 else F.array()
    row = docs.agg(cuts.alias("cuts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("total")).first()
    out, low = [], None
    for cut in sorted(set(row["cuts"] or [])):
        out.append(docs.where(F.col("doc_id") <= cut) if low is None else docs.where((F.col("doc_id") > low) & (F.col("doc_id") <= cut)))
        low = cut
    return [*out, docs if low is None else docs.where(F.col("doc_id") > low)], row["total"]


def copies_of(docs: DataFrame, tables: work.WorkTables) -> DataFrame:
    """doc_id and copy (true) of documents with one text each, which an earlier document has too."""
    own = docs.where("doc_id is not null and text is not null").select("doc_id", F.unhex(F.md5("text")).alias("md5"))
    first = own.groupBy("md5").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = tables.keep(first, "first-copies")
    flagged = own.join(first, "md5", "left").groupBy("doc_id").agg(F.min(F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).alias("copy"))
    return flagged.where("copy")
