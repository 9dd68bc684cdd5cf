"""Operator 10: near-duplicate documents by chosen-path set similarity join.

A document is the set of its distinct n-word shingles. In each of several independent trees a document goes down one
path: at every node the document's token of least hash under that node's own hash function names the branch, so that
two documents of similarity s stay together over a level with probability s. Nodes are not kept; a path's hash is its
node, and a document knows its nodes of every level. A node of few documents is a leaf; a larger one branches further.
With the number of trees that tree_count() gives, a pair at the threshold misses every tree with a probability of
1 - RECALL at most, even where all its nodes branch down to the last level.

Candidates are compared on whole sets. First each document of a node is compared with the node's smallest; linked
documents form components. Then, in leaves that still hold several components, all pairs of documents from different
components are compared, block by block: members of the largest component of a leaf never meet each other, as no link
between them can change a component. Documents with equal sets are one class throughout, of which one text is compared,
and are put back at the end. Sets are of 64-bit hashes of shingles down to their bytes (see words).

Null or empty texts have an empty set and link with nothing. A null doc_id links with nothing, and its component is
null. Rows that repeat a doc_id, with the same text or others, are one node that has the links of all its texts, each
row with its own n_shingles. Further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sets, work
from .words import mix

U = np.uint64
#: Chance that a pair at the threshold shares a leaf in some tree.
RECALL = 0.99995
#: Levels of a tree at most; a node of more documents than LEAF branches again, if a level is left.
LEVELS, LEAF = 4, 2_048
#: Documents, and shingles, of one side of a block of comparisons.
BLOCK, BLOCK_SHINGLES = 512, 250_000


def tree_count(percent: int, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** LEVELS))


def paths(tokens: np.ndarray, starts: np.ndarray, trees: int) -> np.ndarray:
    """For each document with tokens: its nodes, trees x (LEVELS - 1) of them, for levels 2 to LEVELS."""
    sizes = np.diff(starts)
    full = np.flatnonzero(sizes)
    firsts, sizes = starts[:-1][full], sizes[full]
    out = np.zeros((len(full), trees * (LEVELS - 1)), dtype=np.uint64)
    if not len(full):
        return out
    for tree in range(trees):
        node = np.full(len(full), mix(np.array([tree + 1], dtype=np.uint64))[0])
        for level in range(LEVELS):
            seen = tokens ^ np.repeat(node, sizes)
            seen *= U(0x9FB21C651E98DF25)
            node = mix(node * U(3) + np.minimum.reduceat(seen, firsts))
            if level:
                out[:, tree * (LEVELS - 1) + level - 1] = node
    return out


def signatures(docs: DataFrame, n: int, trees: int) -> DataFrame:
    """doc_id, digest, n_shingles, two digests of the set, and the nodes of levels 2 and up of every tree, of docs(doc_id, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, starts = sets.shingle_sets(batch.column(2), n)
            full = np.flatnonzero(np.diff(starts))
            one, two = np.zeros(batch.num_rows, U), np.zeros(batch.num_rows, U)
            if len(full):
                one[full] = np.add.reduceat(mix(tokens), starts[:-1][full])
                two[full] = np.add.reduceat(mix(tokens ^ U(0xA0761D6478BD642F)), starts[:-1][full])
            nodes = paths(tokens, starts, trees)
            where = np.zeros(batch.num_rows + 1, dtype=np.int64)
            where[full + 1] = nodes.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(where).astype(np.int32)), pa.array(nodes.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(starts)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], ["doc_id", "digest", "n_shingles", "one", "two", "nodes"])

    return docs.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest long, n_shingles long, one long, two long, nodes array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough. texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            sides = []
            for ids, side in ((batch.column(0), batch.column(2)), (batch.column(1), batch.column(3))):
                _, first, back = np.unique(ids.to_numpy(), return_index=True, return_inverse=True)
                tokens, starts = sets.shingle_sets(side.take(pa.array(first)), n)
                sides.append((tokens, starts, back))
            for i in range(batch.num_rows):
                a, b = (tokens[starts[back[i]] : starts[back[i] + 1]] for tokens, starts, back in sides)
                linked[i] = sets.similar(a, b, percent)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in batch.columns[:2]], ["a", "b"])

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def compare_blocks(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) within each task of members(task, node, component, text), between different components.

    A task holds 2 * BLOCK documents, and 2 * BLOCK_SHINGLES shingles, or so. Within it, a union-find skips pairs that links found before have joined, so
    it returns fewer links than documents. Parities of the tokens' low bits bound how far two sets differ from below;
    only pairs under that bound are compared in full.
    """
    bits = 2_048

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sets.groups(batches):
            group = group.combine_chunks()
            ids, comps = (group.column(k).to_numpy() for k in (1, 2))
            tokens, starts = sets.shingle_sets(group.column(3), n)
            sizes = np.diff(starts)
            cells = np.repeat(np.arange(len(ids)) * bits, sizes) + (tokens % U(bits)).astype(np.int64)
            odd = (np.bincount(cells, minlength=len(ids) * bits) & 1).astype(bool).reshape(len(ids), bits)
            packed = np.packbits(odd, axis=1).view(np.uint64)
            root = {c: c for c in comps.tolist()}

            def top(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            found = []
            for i in range(len(ids) - 1):
                far = np.bitwise_count(packed[i + 1 :] ^ packed[i]).sum(axis=1)
                near = (100 + percent) * far.astype(np.int64) <= (100 - percent) * (sizes[i + 1 :] + sizes[i])
                near &= comps[i + 1 :] != comps[i]
                for j in (np.flatnonzero(near) + i + 1).tolist():
                    one, two = top(comps[i]), top(comps[j])
                    if one != two and sets.similar(tokens[starts[i] : starts[i + 1]], tokens[starts[j] : starts[j + 1]], percent):
                        root[max(one, two)] = min(one, two)
                        found.append((i, j))
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return members.select("task", "node", "component", "text").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def tasks_of_open_leaves(leaves: DataFrame) -> DataFrame:
    """task, node, component for leaves(leaf, node, n_shingles, component) that hold several components.

    In a leaf, B is its largest component and A are the other documents. A is dealt to blocks, as is B; tasks are the
    pairs of A's blocks, and each block of A with each of B. Leaves with the same members count once.
    """
    sides = leaves.groupBy("leaf", "component").agg(F.count("*").alias("many"), F.sum("n_shingles").alias("size"), F.bit_xor(F.xxhash64("node")).alias("sign"))
    largest = F.max(F.struct("many", "component", "size"))
    opened = sides.groupBy("leaf").agg(F.count("*").alias("parts"), F.sum("many").alias("total"), F.sum("size").alias("size"), F.bit_xor("sign").alias("sign"), largest.alias("most")).where("parts > 1")
    once = opened.groupBy("total", "size", "sign", "parts").agg(F.min(F.struct("leaf", "most")).alias("x")).select("x.leaf", "total", "size", "x.most")
    blocks = lambda many, size: F.greatest(F.lit(1), F.ceil(many / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    rows = leaves.join(once, "leaf").withColumns({"a_blocks": blocks(F.col("total") - F.col("most.many"), F.col("size") - F.col("most.size")), "b_blocks": blocks(F.col("most.many"), F.col("most.size"))})
    in_b = F.col("component") == F.col("most.component")
    own = F.pmod(F.xxhash64("node"), F.when(in_b, F.col("b_blocks")).otherwise(F.col("a_blocks"))).cast("int")
    rows = rows.withColumn("own", own)
    a_range, b_range = F.sequence(F.lit(0), F.col("a_blocks") - 1), F.sequence(F.lit(0), F.col("b_blocks") - 1)
    of_b = F.transform(a_range, lambda i: F.xxhash64("leaf", F.lit("ab"), i, "own"))
    of_a = F.concat(F.transform(a_range, lambda i: F.xxhash64("leaf", F.lit("aa"), F.least(i, "own"), F.greatest(i, "own"))), F.transform(b_range, lambda j: F.xxhash64("leaf", F.lit("ab"), "own", j)))
    return rows.select(F.explode(F.when(in_b, of_b).otherwise(of_a)).alias("task"), "node", "component")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (doc_id = component_id)."""
    spark = docs.sparkSession
    work.arrow_batches(spark)
    tables = work.WorkTables(spark, "neardup")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("digest", F.xxhash64("text"))
    trees = tree_count(percent)
    signed = tables.keep(signatures(docs, n, trees), "signatures")
    known = signed.where("doc_id is not null and n_shingles > 0")

    # One text stands for all with the same set: that of the smallest doc_id, and of its smallest digest.
    key = ["n_shingles", "one", "two"]
    classes = known.groupBy(key).agg(F.min(F.struct("doc_id", "digest")).alias("head"), F.max("doc_id").alias("last"))
    # As a table of its own it is shuffled anew for the join, so that Spark can split a set with very many copies.
    classes = tables.keep(work.numbered(classes.select(*key, F.col("head.doc_id").alias("first"), F.col("head.digest").alias("digest"), "last"), *key), "classes")
    copies = tables.keep(known.join(classes.where("first < last").select(*key, "first"), key).where("doc_id > first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct(), "copies")
    row = ["doc_id", "digest", *key]
    heads = known.dropDuplicates(row).join(classes.withColumnRenamed("first", "doc_id").select(*row, "node"), row)
    placed = heads.select("node", "n_shingles", "nodes", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    placed = placed.select("node", "n_shingles", F.slice("nodes", F.col("tree") * (LEVELS - 1) + 1, LEVELS - 1).alias("nodes"))
    by_node = placed.groupBy(F.col("nodes")[0].alias("leaf")).agg(F.min(F.struct("node", "n_shingles")).alias("pivot"), F.count("*").alias("many")).where("many > 1")
    shared = tables.keep(placed.withColumn("leaf", F.col("nodes")[0]).join(by_node, "leaf").select("node", "n_shingles", "nodes", "pivot", "many"), "shared")

    fits = f"100 * least(n_shingles, pivot.n_shingles) >= {percent} * greatest(n_shingles, pivot.n_shingles)"
    pairs = tables.keep(shared.where("node <> pivot.node").where(fits).select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).distinct(), "pairs")
    named = shared.select("node").distinct().join(classes.select("node", F.col("first").alias("doc_id"), "digest"), "node")
    # Tables too, for the same reason. Repeated rows bring a text more than once. What is named grows with the documents,
    # so this is a merge join at every size.
    named = tables.keep(named, "named")
    texts = tables.keep(docs.join(named.hint("merge"), ["doc_id", "digest"]).select("node", "text"), "texts")
    if texts.count() > named.count():
        texts = tables.keep(texts.dropDuplicates(["node"]), "distinct-texts")
    links = tables.keep(confirm(pairs, texts, n, percent), "links")
    tables.drop("pairs")
    settled = tables.keep(work.components(links, tables, "first"), "settled")

    leaves = leaves_of(shared, tables)
    leaves = leaves.join(settled, "node", "left").select("leaf", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    tasks = tables.keep(tasks_of_open_leaves(tables.keep(leaves, "leaves")), "tasks")
    tables.drop("leaves", "settled", "shared", *(f"level-{level}" for level in range(LEVELS)))
    more = tables.keep(compare_blocks(tasks.join(texts, "node"), n, percent), "more")
    tables.drop("tasks", "texts", "distinct-texts", "named")
    a, b = (classes.select(F.col("node").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    between = links.unionByName(more).join(a, "a").join(b, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    final = tables.keep(work.components(between.unionByName(copies), tables, "all"), "found").withColumnRenamed("node", "doc_id")
    tables.drop("links", "more", "copies", "classes")
    found = signed.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def leaves_of(shared: DataFrame, tables: work.WorkTables) -> DataFrame:
    """leaf, node, n_shingles of every tree's leaves with two classes at least: nodes of level 2, or of a deeper one where those hold more than LEAF."""
    rows, out = shared.select("node", "n_shingles", "nodes", "many"), None
    for level in range(LEVELS - 1):
        leaf = F.col("nodes")[level].alias("leaf")
        last = level == LEVELS - 2
        own = rows.where("many > 1") if last else rows.where(f"many between 2 and {LEAF}")
        own = own.select(leaf, "node", "n_shingles")
        out = own if out is None else out.unionByName(own)
        larger = rows.where(f"many > {LEAF}")
        if last or larger.isEmpty():
            break
        counts = larger.groupBy(F.col("nodes")[level + 1].alias("leaf")).agg(F.count("*").alias("many"))
        rows = tables.keep(larger.drop("many").withColumn("leaf", F.col("nodes")[level + 1]).join(counts, "leaf").drop("leaf"), f"level-{level + 1}")
    return out
