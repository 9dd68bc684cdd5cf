"""Recall of operator 1 against brute force on a table: python -m tests.llm.recall /path/of/tables"""

import sys
import tempfile

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from greffe.llm import queries


def main(sf_dir: str) -> None:
    shared = tempfile.mkdtemp(prefix="spark-")
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"{shared}/checkpoints").getOrCreate()
    found = {}
    for r in queries.op1_nn_descent(spark, sf_dir).collect():
        found.setdefault(r.query_id, []).append(r.score)
    table = pq.read_table(f"{sf_dir}/embeddings.parquet", columns=["vec_id", "embedding"])
    ids, rows = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), dtype=np.float64)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        score = rows @ rows[at]
        score[at] = -2
        least = np.sort(score)[-5]
        hits += sum(x >= least - 1e-12 for x in found[ids[at]])
        total += 5
    print(f"recall {hits / total:.4f} of {total} neighbours, {len(ids)} vectors")


if __name__ == "__main__":
    main(sys.argv[1])
