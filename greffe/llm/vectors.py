"""Vectors of an embedding column: which take part, and equal ones as one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, without null or non-finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector, n (its length) and two digests of the rows that take part: usable vectors with an id. Repeated rows are one."""
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    keyed = rows.withColumns({"n": F.size("vector"), "one": F.xxhash64("vector"), "two": F.xxhash64(F.lit(11), "vector")})
    return keyed.dropDuplicates(["vec_id", *CLASS])


#: What equal vectors agree in.
CLASS = ("n", "one", "two")


def classes(own: DataFrame) -> DataFrame:
    """n, one, two, first (the smallest id), copies, and node, a number of its own, for each distinct vector; to be written."""
    found = own.groupBy(*CLASS).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    return work.numbered(found, "one", "two", "n")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths without nulls as rows of a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def blobs(column: pa.Array, dtype) -> np.ndarray:
    """A binary column of equal lengths as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype)


def as_blobs(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    where = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(where), pa.py_buffer(rows)])


def by_length(batch: pa.RecordBatch, lengths: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each length: the length, which is in the column of that number, and its rows."""
    n = batch.column(lengths).to_numpy()
    for length in np.unique(n).tolist():
        yield length, batch.filter(pa.array(n == length))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)
