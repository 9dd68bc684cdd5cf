"""Operator 1: approximate nearest neighbours by NN-descent and greedy graph search.

Every distinct vector is a node. Cells of random hyperplanes give each node a first list of neighbours. Then NN-descent:
in each round every node meets the nodes that list it and those it lists (a join of the graph with itself, both ways);
all of a node's visitors are compared with each other, and who improves a visitor's list is sent to it. A query starts
at its own node and repeatedly expands all unexpanded nodes of its beam, over links in both directions, until no hop
improves the beam. The last candidates are scored in double precision on the original vectors.

Lists, beams and rounds are bounded parameters of the method; every vector is a node and can be found. Visitors of a node
that very many list, and the nodes of a cell, are dealt to parts of about PART, and adjacency rows hold PART links of a
node each. Vectors are compared in
single precision until the last step; what single precision cannot tell from the last candidates is scored too.

Equal vectors are one node; the smallest ids of a node (as many as a result can hold, and one) come back with it. Null, zero
and non-finite vectors and rows without an id take no part; a vector meets only those of its own length. With fewer
candidates than asked for, all come back. Rows that repeat an id with the same vector are one; with different vectors
they are candidates, and queries, each for itself. Further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sets, vectors, work

#: Neighbours a node, cells' size, sets of cells, rounds at most and the share of changed lists at which they end.
DEGREE, CELL, TREES, ROUNDS, SETTLED = 20, 192, 4, 4, 0.02
#: Visitors that meet at once, and the most candidates a visitor takes home from one meeting.
PART, TAKEN = 128, 10
#: A query's beam, hops at most, and candidates that are scored again.
BEAM, HOPS, RESCORED = 384, 12, 40
#: Copies of a node's id that salts spread before the smallest are taken.
SALTS = 16


def coded(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    return vectors.unit(rows).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def code_error(length: Column) -> Column:
    """How far a product of codes can be from the true one: rounding of the codes and of each addition."""
    return (length + 4) * 2.0**-24


def best(ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest sims, one a distinct id, largest first."""
    order = np.lexsort((ids, -sims))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:most]


LISTS = "node long, ids array<long>, sims array<float>"


def list_batch(nodes: list, ids: list[np.ndarray], sims: list[np.ndarray], more: dict | None = None) -> pa.RecordBatch:
    where = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = lambda parts, kind, dtype: pa.ListArray.from_arrays(pa.array(where), pa.array(np.concatenate(parts).astype(dtype) if parts else np.zeros(0, dtype), kind))
    columns = {"node": pa.array(nodes, pa.int64()), "ids": flat(ids, pa.int64(), np.int64), "sims": flat(sims, pa.float32(), np.float32)} | (more or {})
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def dealt(visits: DataFrame) -> DataFrame:
    """visits(place, node) with part: a place's visitors are dealt to parts of about PART, whatever their number."""
    parts = visits.groupBy("place").agg(F.ceil(F.count("*") / PART).alias("parts"))
    return visits.join(parts, "place").select("place", F.pmod(F.xxhash64("node", "place"), "parts").alias("part"), "node")


def meet(rows: DataFrame, exclude_known: bool) -> DataFrame:
    """Lists of candidates from rows(place, part, node, code, least): nodes of one part of a place compare with each other.

    A node takes home the TAKEN nearest that are nearer than its least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, ids, sims = [], [], []
        for group in sets.groups(batches, keys=2):
            if group.num_rows < 2:
                continue
            own, least = group.column(2).combine_chunks().to_numpy(), group.column(4).combine_chunks().to_numpy()
            codes = vectors.blobs(group.column(3), np.float32)
            for at in range(0, len(own), 2 * PART):
                part = slice(at, at + 2 * PART)
                near = products(codes[part], codes[part])
                np.fill_diagonal(near, -2)
                take = min(TAKEN if exclude_known else DEGREE, near.shape[0] - 1)
                if take < 1:
                    continue
                top = np.argpartition(-near, take - 1, axis=1)[:, :take]
                found = np.take_along_axis(near, top, axis=1)
                for i in range(near.shape[0]):
                    better = found[i] > least[at + i]
                    if better.any():
                        nodes.append(own[at + i])
                        ids.append(own[part][top[i][better]])
                        sims.append(found[i][better])
            if len(nodes) >= 4096:
                yield list_batch(nodes, ids, sims)
                nodes, ids, sims = [], [], []
        if nodes:
            yield list_batch(nodes, ids, sims)

    return rows.select("place", "part", "node", "code", "least").repartition("place", "part").sortWithinPartitions("place", "part", "node").mapInArrow(run, LISTS)


def merged(lists: DataFrame, most: int) -> DataFrame:
    """node, ids, sims, least, changed: the best of all lists of a node. lists has old: whether a list is the current one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, ids, sims, least, changed = [], [], [], [], []

        def batch():
            return list_batch(nodes, ids, sims, {"least": pa.array(least, pa.float32()), "changed": pa.array(changed, pa.int32())})

        for group in sets.groups(batches):
            group = group.combine_chunks()
            every, near = group.column(1).combine_chunks().flatten().to_numpy(), group.column(2).combine_chunks().flatten().to_numpy()
            keep = best(every, near, most)
            old = group.filter(group.column(3))
            before = old.column(1).combine_chunks().flatten().to_numpy() if old.num_rows else every[:0]
            nodes.append(group.column(0)[0].as_py())
            ids.append(every[keep])
            sims.append(near[keep])
            least.append(near[keep[-1]] if len(keep) == most else -2.0)
            changed.append(len(keep) - len(np.intersect1d(every[keep], before)))
            if len(nodes) >= 4096:
                yield batch()
                nodes, ids, sims, least, changed = [], [], [], [], []
        if nodes:
            yield batch()

    return lists.select("node", "ids", "sims", "old").repartition("node").sortWithinPartitions("node").mapInArrow(run, LISTS + ", least float, changed int")


def both_ways(graph: DataFrame) -> DataFrame:
    """node, other: links of the graph in both directions."""
    out = graph.select("node", F.explode("ids").alias("other"))
    return out.unionByName(out.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def first_lists(nodes: DataFrame) -> DataFrame:
    """Lists from cells of random hyperplanes, TREES times. nodes: node, n, many (nodes of that length), code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            for n, own in vectors.by_length(batch, 1):
                bits = min(32, max(0, math.ceil(math.log2(own.column(2)[0].as_py() / CELL))))
                if n not in planes:
                    planes[n] = np.random.default_rng([5, n]).normal(size=(TREES, bits, n)).astype(np.float32)
                codes = vectors.blobs(own.column(3), np.float32)
                for tree in range(TREES):
                    cell = (codes @ planes[n][tree].T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(codes), np.int64)
                    # A place is one length, one tree and one cell.
                    place = ((np.int64(n) * TREES + tree) << 32) + cell.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(place), own.column(0)], ["place", "node"])

    placed = nodes.select("node", "n", "many", "code").mapInArrow(run, "place long, node long")
    return meet(dealt(placed).join(nodes.select("node", "code"), "node").withColumn("least", F.lit(-2.0).cast("float")), False)


def descend(nodes: DataFrame, tables: work.WorkTables) -> DataFrame:
    """The graph: node, ids, sims, least."""
    found = first_lists(nodes).withColumn("old", F.lit(False))
    graph = tables.keep(merged(found, DEGREE), "graph-0")
    for turn in range(1, ROUNDS + 1):
        visits = both_ways(graph).select(F.col("other").alias("place"), "node").unionByName(graph.select(F.col("node").alias("place"), "node"))
        coded_nodes = nodes.select("node", "code").join(graph.select("node", "least"), "node")
        found = meet(dealt(visits).join(coded_nodes, "node"), True).withColumn("old", F.lit(False))
        now = graph.select("node", "ids", "sims").withColumn("old", F.lit(True))
        after = tables.keep(merged(now.unionByName(found), DEGREE), f"graph-{turn}")
        tables.drop(f"graph-{turn - 1}")
        graph = after
        share = graph.agg(F.sum("changed") / F.sum(F.size("ids"))).first()[0]
        if share is None or share < SETTLED:
            break
    return graph


def adjacency(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, ids, codes: the links of a node with the codes of their ends, PART of them a row."""
    links = both_ways(graph).withColumn("part", F.pmod(F.xxhash64("other"), F.lit(1 << 30)).cast("int"))
    counts = links.groupBy("node").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = links.join(counts, "node").withColumn("part", F.pmod("part", "parts"))
    ends = dealt.join(nodes.select(F.col("node").alias("other"), "code"), "other")
    return ends.groupBy("node", "part").agg(F.collect_list(F.struct("other", "code")).alias("x")).select("node", F.col("x.other").alias("ids"), F.col("x.code").alias("codes"))


def search(queries: DataFrame, nodes: DataFrame, links: DataFrame, tables: work.WorkTables) -> DataFrame:
    """Greedy search from each query's own node: node (the query's), ids, sims of its beam."""
    start = queries.select("node", F.array("node").alias("ids"), F.array(F.lit(-1.5).cast("float")).alias("sims"), F.array().cast("array<long>").alias("done"), F.lit(-2.0).cast("float").alias("least"))
    beams = tables.keep(start, "beams-0")
    codes = queries.select("node", "code")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, least = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            mine, ends, theirs = batch.column(1), batch.column(3), batch.column(4)
            out_nodes, ids, sims = [], [], []
            for i in range(batch.num_rows):
                other = ends[i].values.to_numpy()
                near = products(np.frombuffer(mine[i].as_py(), np.float32)[None], vectors.blobs(theirs[i].values, np.float32))[0]
                better = (near > least[i]) & (other != query[i])
                if better.any():
                    out_nodes.append(query[i])
                    ids.append(other[better])
                    sims.append(near[better])
            if out_nodes:
                yield list_batch(out_nodes, ids, sims)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_nodes, ids, sims, done, least = [], [], [], [], []
        for group in sets.groups(batches):
            group = group.combine_chunks()
            every, near = group.column(1).combine_chunks().flatten().to_numpy(), group.column(2).combine_chunks().flatten().to_numpy()
            before = group.filter(group.column(4))
            keep = best(every, near, BEAM)
            out_nodes.append(group.column(0)[0].as_py())
            ids.append(every[keep])
            sims.append(near[keep])
            # All nodes of the beam before this hop are expanded now.
            done.append(before.column(1).combine_chunks().flatten().to_numpy())
            least.append(near[keep[-1]] if len(keep) == BEAM else -2.0)
        if out_nodes:
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in done])]).astype(np.int32)
            yield list_batch(out_nodes, ids, sims, {"done": pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(done), pa.int64())), "least": pa.array(least, pa.float32())})

    for hop in range(1, HOPS + 1):
        open_ = beams.select("node", "least", F.explode(F.array_except("ids", "done")).alias("at"))
        asked = open_.join(codes, "node").join(links.withColumnRenamed("node", "at").withColumnRenamed("ids", "ends"), "at")
        seen = asked.select("node", "code", "least", "ends", "codes").mapInArrow(expand, LISTS).withColumns({"done": F.array().cast("array<long>"), "old": F.lit(False)})
        now = beams.select("node", "ids", "sims", "done").withColumn("old", F.lit(True))
        rows = now.unionByName(seen.select("node", "ids", "sims", "done", "old"))
        after = rows.select("node", "ids", "sims", "done", "old").repartition("node").sortWithinPartitions("node").mapInArrow(gather, LISTS + ", done array<long>, least float")
        after = tables.keep(after, f"beams-{hop}")
        tables.drop(f"beams-{hop - 1}")
        beams = after
        if beams.where(F.size(F.array_except("ids", "done")) > 0).isEmpty():
            break
    return beams


def smallest_ids(own: DataFrame, most: int) -> DataFrame:
    """node, vec_id: the smallest ids of each node. Each node's ids are dealt to salts first."""
    salted = own.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    few = salted.withColumn("rn", F.row_number().over(Window.partitionBy("node", "salt").orderBy("vec_id"))).where(f"rn <= {most}")
    return few.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(f"rn <= {most}").select("node", "vec_id")


def exact_scores(pairs: DataFrame) -> DataFrame:
    """query_id, asked, node, vec_id, score of pairs(query_id, asked, node, vec_id, n, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in vectors.by_length(batch, 4):
                a, b = vectors.matrix(own.column(5)), vectors.matrix(own.column(6))
                a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
                score = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(score, pa.float64())], ["query_id", "asked", "node", "vec_id", "score"])

    return pairs.select("query_id", "asked", "node", "vec_id", "n", "a", "b").mapInArrow(run, "query_id long, asked long, node long, vec_id long, score double")


def nearest(df: DataFrame, is_query: Column, most: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query (of vec_id) marks, the nearest other rows found."""
    spark = df.sparkSession
    work.arrow_batches(spark)
    tables = work.WorkTables(spark, "neighbours")
    own = tables.keep(vectors.prepared(df, id_col, vector_col), "vectors")
    classes = tables.keep(vectors.classes(own), "classes")
    own = tables.keep(own.join(classes, [*vectors.CLASS]).select("vec_id", "node", "first", "copies", "n", "vector"), "own")
    tables.drop("vectors")
    if own.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in vectors.by_length(batch, 1):
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), vectors.as_blobs(coded(vectors.matrix(rows.column(3))))], ["node", "n", "many", "code"])

    heads = own.where("vec_id = first")  # one row a node
    # As a table its size is known: a row a length, which Spark broadcasts if it is small.
    lengths = tables.keep(classes.groupBy("n").agg(F.count("*").alias("many")), "lengths")
    nodes = tables.keep(heads.join(lengths, "n").select("node", "n", "many", "vector").mapInArrow(encode, "node long, n int, many long, code binary"), "nodes")
    graph = descend(nodes, tables)
    links = tables.keep(adjacency(graph, nodes), "links")
    asked = own.where(is_query)
    queries = tables.keep(nodes.join(asked.select("node").distinct(), "node", "left_semi"), "queries")
    beams = search(queries, nodes, links, tables)
    tables.drop("links")

    alike = own.where("copies > 1").select("vec_id", "node")
    members = own.where("copies = 1").select("node", "vec_id").unionByName(smallest_ids(alike, most + 1).select("node", "vec_id"))
    # Beyond the first RESCORED, those that the codes cannot tell from the last one wanted.
    others = beams.join(queries.select("node", "n"), "node").select("node", "n", F.filter(F.arrays_zip("ids", "sims"), lambda x: x["ids"] != F.col("node")).alias("x"))
    doubt = F.element_at("x", F.least(F.lit(most), F.size("x")))["sims"] - 2 * code_error(F.col("n"))
    others = others.where(F.size("x") > 0).withColumn("x", F.filter("x", lambda x, i: (i < RESCORED) | (x["sims"] >= doubt)))
    alone = beams.select(F.col("node").alias("asked"), F.array("node").alias("ids"))
    few = alone.unionByName(others.select(F.col("node").alias("asked"), F.col("x.ids").alias("ids")))
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("asked"), "n", F.col("vector").alias("a")).join(few, "asked").withColumn("node", F.explode("ids")).drop("ids")
    pairs = pairs.join(heads.select("node", F.col("vector").alias("b")), "node").join(members, "node").where("vec_id <> query_id or node <> asked")
    scored = exact_scores(pairs).dropDuplicates(["query_id", "asked", "node", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id", "node"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
