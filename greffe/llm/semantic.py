"""Operator 5: near-duplicate embeddings by spherical k-means and blocked cosines within cells.

Spark runs Lloyd's rounds over all vectors, each length apart; only the centroids (MOST_CELLS at most) pass through the driver. A vector is at
home in its nearest centroid's cell and a guest in each cell whose boundary is within half the distance of the threshold.
Of two linked vectors with different homes, the boundary between them is within that distance of one at least, which is
a guest in the other's home; so no link is lost however the centroids lie, and guests need not meet guests. A cell's
vectors are dealt to blocks, and a pair of blocks is one matrix product. A pair that meets in both homes counts in the
smaller cell. A task returns a row for each vector that has links:
their number, and the smallest vector of its group within the task; so a group's pairs are never emitted.

Equal vectors are one until the end, where their number counts as links. Vectors that are null, zero, or hold null or
non-finite components link with nothing, as do rows without an id; vectors of different lengths do not link. Rows that
repeat an id share its links. Further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sets, vectors, work

#: Vectors a cell that the number of cells aims at, most cells, Lloyd's rounds, and vectors a block.
CELL_SIZE, MOST_CELLS, ROUNDS, BLOCK = 1_024, 1_024, 4, 2_048
#: Products in single precision this near the threshold are taken again in double precision.
DOUBT = 1e-4


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (rows @ centroids.T).argmax(axis=1)


def kmeans(units: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by length from units(node, n, unit: binary float32), over all rows. A length of few vectors is one cell and has none."""
    spark = units.sparkSession
    whole = units.count()
    cells = F.least(F.floor(F.lit(MOST_CELLS) * F.col("count") / F.lit(max(whole, 1))), F.floor(F.col("count") / CELL_SIZE)).cast("int")
    wanted = units.groupBy("n").count().select("n", cells.alias("cells")).where("cells > 1").orderBy("n").collect()  # MOST_CELLS / 2 rows at most
    centroids = {}
    for row in wanted:
        seeds = units.where(F.col("n") == row["n"]).orderBy(F.xxhash64("node", F.lit(3)), "node").limit(row["cells"]).select("unit").toArrow()
        centroids[row["n"]] = vectors.blobs(seeds["unit"], np.float32).copy()
    for _ in range(ROUNDS if centroids else 0):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {n: np.zeros(x.shape) for n, x in sent.value.items()}
            seen = {n: np.zeros(len(x), dtype=np.int64) for n, x in sent.value.items()}
            for batch in batches:
                for n, own in vectors.by_length(batch, 0):
                    if n in total:
                        rows = vectors.blobs(own.column(1), np.float32)
                        cell = nearest(rows, sent.value[n])
                        np.add.at(total[n], cell, rows)
                        seen[n] += np.bincount(cell, minlength=len(seen[n]))
            for n in total:
                full = np.flatnonzero(seen[n])
                cell, dim = np.repeat(full, n), np.tile(np.arange(n), len(full))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), n, np.int32)), pa.array(cell), pa.array(dim), pa.array(total[n][full].ravel())], ["n", "cell", "dim", "value"])

        found = units.select("n", "unit").mapInArrow(sums, "n int, cell long, dim long, value double").groupBy("n", "cell", "dim").agg(F.sum("value").alias("value")).toArrow()
        sent.destroy()
        of, cell, dim, value = (found[c].to_numpy() for c in ("n", "cell", "dim", "value"))
        for n in centroids:
            moved = centroids[n].astype(np.float64)
            moved[cell[of == n], dim[of == n]] = value[of == n]
            lengths = np.linalg.norm(moved, axis=1, keepdims=True)
            centroids[n] = (moved / np.where(lengths > 0, lengths, 1)).astype(np.float32)
    return centroids


def memberships(units: DataFrame, centroids: dict[int, np.ndarray], least: float, tables: work.WorkTables) -> DataFrame:
    """n, node, first, copies, vector, cells (bits), home, cell: a row for each cell that a vector belongs to."""
    reach = math.sqrt(2 - 2 * least) / 2 + 1e-5
    sent = units.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, own in vectors.by_length(batch, 0):
                if n in sent.value:
                    centres = sent.value[n]
                    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
                    near = vectors.blobs(own.column(5), np.float32) @ centres.T
                    home = near.argmax(axis=1)
                    member = near[np.arange(len(near)), home][:, None] - near <= reach * apart[home] + 1e-5
                else:
                    home, member = np.zeros(own.num_rows, np.int64), np.ones((own.num_rows, 1), bool)
                at, cell = np.nonzero(member)
                bits = np.packbits(np.pad(member, ((0, 0), (0, -member.shape[1] % 64))), axis=1, bitorder="little")
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(own.column(i).take(pick) for i in range(5)), vectors.as_blobs(bits).take(pick), pa.array(home[at].astype(np.int32)), pa.array(cell.astype(np.int32))], ["n", "node", "first", "copies", "vector", "cells", "home", "cell"])

    rows = units.select("n", "node", "first", "copies", "vector", "unit").mapInArrow(run, "n int, node long, first long, copies long, vector binary, cells binary, home int, cell int")
    rows = tables.keep(rows, "members")
    sent.destroy()
    return rows


def tasks_of(members: DataFrame) -> DataFrame:
    """members with kind, i and j: pairs of a cell's blocks, of which one at least is of vectors at home there."""
    own = F.col("home") == F.col("cell")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    sizes = members.groupBy("n", "cell").agg(blocks(F.count_if(own)).alias("h"), blocks(F.count_if(~own)).alias("g"))
    placed = members.join(sizes, ["n", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.when(own, F.col("h")).otherwise(F.col("g"))).cast("int"))
    homes, guests = F.sequence(F.lit(0), F.col("h") - 1), F.sequence(F.lit(0), F.col("g") - 1)
    at_home = F.concat(F.transform(homes, lambda j: F.struct(F.lit(0).alias("kind"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))), F.transform(guests, lambda j: F.struct(F.lit(1).alias("kind"), F.col("block").alias("i"), j.alias("j"))))
    visiting = F.transform(homes, lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.col("block").alias("j")))
    dealt = placed.withColumn("t", F.explode(F.when(own, at_home).otherwise(visiting)))
    part = F.when(F.col("t.kind") == 1, own.cast("int")).when(F.col("t.i") == F.col("t.j"), -1).otherwise(F.col("block"))
    return dealt.select("n", "cell", "t.kind", "t.i", "t.j", "node", "first", "copies", "vector", "cells", "home", part.alias("part"))


def linked(rows: np.ndarray, bits: np.ndarray, home: np.ndarray, cell: int, part: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a task that are linked and count in this cell. part: rows of one part don't meet, unless it is -1."""
    units = vectors.unit(rows)
    small = units.astype(np.float32)
    left = np.arange(len(rows)) if part[0] == -1 else np.flatnonzero(part == part.max())
    right = left if part[0] == -1 else np.flatnonzero(part != part.max())
    out = []
    for at in range(0, len(left), 512):
        close = small[left[at : at + 512]] @ small[right].T
        a, b = np.nonzero(close >= least - DOUBT)
        sure = close[a, b] >= least + DOUBT
        a, b = left[at + a], right[b]
        keep = (a < b) | (part[0] != -1)
        a, b, sure = a[keep], b[keep], sure[keep]
        doubtful = np.flatnonzero(~sure)
        sure[doubtful] = np.einsum("ij,ij->i", units[a[doubtful]], units[b[doubtful]]) >= least
        a, b = a[sure], b[sure]
        away = home[b] != cell
        if away.any():  # a is at home here, b is not; the pair may meet in b's home too
            also = (bits[a, home[b] // 64] >> (home[b] % 64).astype(np.uint64)) & np.uint64(1)
            keep = ~away | (also == 0) | (cell < home[b])
            a, b = a[keep], b[keep]
        out.append((a, b))
    return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (left[:0], left[:0])


def smallest_in_group(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the smallest id that pairs lead to."""
    label = ids.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            return label


def block_links(tasks: DataFrame, least: float, dtype) -> DataFrame:
    """node, first, root, links: a row for each vector with links in a task; root is the smallest first of its group there."""
    columns = ["n", "cell", "kind", "i", "j", "node", "first", "copies", "vector", "cells", "home", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sets.groups(batches, keys=5):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            ids, first, copies, home, part = (group[c].combine_chunks().to_numpy() for c in ("node", "first", "copies", "home", "part"))
            rows, bits = vectors.blobs(group["vector"], dtype).astype(np.float64), vectors.blobs(group["cells"], np.uint64)
            a, b = linked(rows, bits, home, group["cell"][0].as_py(), part, least)
            if len(a):
                links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                roots, some = smallest_in_group(first, a, b), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(first[some]), pa.array(roots[some]), pa.array(links[some].astype(np.int64))], ["node", "first", "root", "links"])

    keys = columns[:5]
    return tasks.select(columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, first long, root long, links long")


def near_duplicates(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = df.sparkSession
    work.arrow_batches(spark)
    tables = work.WorkTables(spark, "semantic")
    dtype = np.float32 if df.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64  # as read, without loss
    own = tables.keep(vectors.prepared(df, id_col, vector_col).select("vec_id", *vectors.CLASS, "vector"), "vectors")
    classes = tables.keep(vectors.classes(own), "classes")
    every = own.join(classes, [*vectors.CLASS])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, of in vectors.by_length(batch, 0):
                rows = vectors.matrix(of.column(4))
                yield pa.RecordBatch.from_arrays([*of.columns[:4], vectors.as_blobs(rows.astype(dtype)), vectors.as_blobs(vectors.unit(rows).astype(np.float32))], ["n", "node", "first", "copies", "vector", "unit"])

    heads = every.where("vec_id = first").select("n", "node", "first", "copies", "vector")
    units = tables.keep(heads.mapInArrow(packed, "n int, node long, first long, copies long, vector binary, unit binary"), "units")
    members = memberships(units, kmeans(units), least, tables)
    tables.drop("units")
    links = tables.keep(block_links(tasks_of(members), least, dtype), "links")
    tables.drop("members")
    edges = every.where("copies > 1").select(F.col("vec_id").alias("a"), F.col("first").alias("b")).unionByName(links.select(F.col("first").alias("a"), F.col("root").alias("b")))
    near = links.groupBy("node").agg(F.sum("links").alias("near"))
    counts = every.select("vec_id", "node", (F.col("copies") - 1).alias("same")).join(near, "node", "left")
    counts = counts.groupBy("vec_id").agg(F.sum(F.col("same") + F.coalesce("near", F.lit(0))).cast("long").alias("n"))
    found = tables.keep(work.components(edges, tables), "found").withColumnRenamed("node", "vec_id")
    out = df.select(df[id_col].cast("long").alias("vec_id")).join(counts, "vec_id", "left").join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
