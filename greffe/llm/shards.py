"""Operator 7: sharding by jump consistent hashing.

The shard of a row is a function of its key and the number of shards alone; there is no ring table. With one more
shard, a row either stays or moves into the new one.

A key's hash is the first 64 bits of the MD5 of its text, which any engine can compute. All null keys share a shard.
Null and empty texts have size 1 and the checksum 0. Repeated rows each get a slot. Input columns of other names are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import work

#: Cells of a shard in which slots are counted apart: rows a cell, and the most cells (the table of cells is broadcast).
ROWS_A_CELL, MOST_CELLS = 20_000, 2_048


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket of each unsigned 64-bit key: a generator seeded with the key says at which number of shards it jumps next."""
    state = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(state), dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = ahead[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[moving] = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard


def md5_bits(value: Column, bits: int) -> Column:
    """The first bits, 32 to 64, of a text's MD5; 64 of them as a signed number."""
    digest = F.md5(value)
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, bits - 32).bitwiseOR(F.shiftright(low, 64 - bits))


def key_hash(key: Column) -> Column:
    return md5_bits(F.coalesce(key.cast("string"), F.lit("")), 64)


def with_shards(df: DataFrame, key: Column, counts: dict[str, int]) -> DataFrame:
    """Adds a column for each entry of counts: the shard of the key among so many shards."""
    work.arrow_batches(df.sparkSession)
    names = df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.IntegerType()) for name in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(jump(keys, n).astype(np.int32)) for n in counts.values())], [*names, *counts])

    return df.select("*", key_hash(key).alias("__key")).mapInArrow(run, schema)


def with_slots(df: DataFrame, shard: str, order: list[str], total: int) -> DataFrame:
    """Adds slot: rows of a shard numbered from 0 without gaps, in the order of (a hash of the order columns, those columns).

    Ranges of the hash cut a shard into cells; the first slot of each cell comes from the counts of the cells before it,
    so no task sorts a whole shard. total: about how many rows there are.
    """
    bits = int(min(MOST_CELLS, max(1, total // ROWS_A_CELL))).bit_length() - 1
    dealt = df.withColumn("__place", md5_bits(F.concat_ws(":", *order), 60)).withColumn("__cell", F.shiftright("__place", 60 - bits).cast("int") if bits else F.lit(0))
    first = dealt.groupBy(shard, "__cell").count().withColumn("__first", F.sum("count").over(Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.select(shard, "__cell", F.coalesce("__first", F.lit(0)).alias("__first"))
    own = F.row_number().over(Window.partitionBy(shard, "__cell").orderBy("__place", *order)) - 1
    # shards * MOST_CELLS rows are broadcast at most.
    return dealt.withColumn("__own", own).join(F.broadcast(first), [shard, "__cell"]).withColumn("slot", (F.col("__own") + F.col("__first")).cast("long")).drop("__own", "__first", "__cell", "__place")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot and grown_shard (the shard if there were one more)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = with_shards(rows, F.col("doc_id"), {"shard": shards, "grown_shard": shards + 1})
    # The law is `key`: text columns take part in the order of slots only.
    slotted = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], docs.count())
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id") -> None:
    """Write the documents as Parquet, one folder a shard."""
    with_shards(docs, docs[id_col], {"shard": shards}).write.partitionBy("shard").parquet(path)
