"""Work tables in the cluster's shared folder, and connected components built on them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.lineage import new_folder

#: Rows and bytes that one Arrow batch may hold, so that a Python worker's memory is bounded.
ARROW_ROWS, ARROW_BYTES = "1000", "8388608"


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, for texts of very different lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def empty(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, through Spark's own file systems, wherever the path lies: no job, and no plan for the driver to keep."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class WorkTables:
    """Parquet tables of one run of an operator, under one new folder of the shared folder.

    A written table cuts lineage and survives lost executors, as every executor can read it again. The tables that an
    operator's result is read from stay; drop() frees the others.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = new_folder(spark, label)
        self.names: set[str] = set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Free tables that no later step reads."""
        for name in self.names.intersection(names):
            empty(self.spark, f"{self.root}/{name}")
            self.names.discard(name)


def fitted(sample: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What fit makes of a sample of bounded size, in one task: the driver gets the model alone."""
    schema = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        model = pickle.dumps(fit(pa.Table.from_batches(own) if own else schema.empty_table()))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(schema.empty_table())


def numbered(df: DataFrame, *keys: str, name: str = "node") -> DataFrame:
    """Adds a distinct number for each row of a table whose keys are distinct; write it before using it twice."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def ends(one: tuple[Column, Column], other: tuple[Column, Column], names: tuple[str, str]) -> Column:
    """Both of two pairs as rows: explode it and take its fields."""
    return F.explode(F.array(*(F.struct(x.alias(names[0]), y.alias(names[1])) for x, y in (one, other)))).alias("x")


def settled(edges: DataFrame) -> bool:
    """Whether every component of distinct edges(lo, hi) is a star already: each hi has its one edge and is no lo."""
    roles = edges.select(ends((F.col("lo"), F.lit(0)), (F.col("hi"), F.lit(1)), ("node", "up"))).groupBy("x.node").agg(F.sum("x.up").alias("up"), F.count("*").alias("many"))
    return not roles.agg(F.max((F.col("up") > 0) & (F.col("many") > 1))).first()[0]


def components(edges: DataFrame, tables: WorkTables, name: str = "components", most_rounds: int = 40) -> DataFrame:
    """Connected components of edges(a, b) as (node, component): the smallest node reachable.

    Alternating large-star and small-star steps, until all components are stars. A node's smallest neighbour is aggregated
    on the map side first and joined back, so a node with very many neighbours never meets in one group. Edges of a node
    with itself and null ends are ignored; nodes without edges are not returned. Each round is written to the shared folder.
    """
    edges = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    edges = tables.keep(edges, f"{name}-0")
    for turn in range(1, most_rounds + 1):
        if settled(edges):
            break
        both = edges.select(ends((F.col("lo"), F.col("hi")), (F.col("hi"), F.col("lo")), ("u", "v"))).select("x.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        stars = large.join(small, "hi").select(ends((F.col("m"), F.col("lo")), (F.col("m"), F.col("hi")), ("lo", "hi"))).select("x.*")
        edges = tables.keep(stars.where("lo < hi").distinct(), f"{name}-{turn}")
        tables.drop(f"{name}-{turn - 1}")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
