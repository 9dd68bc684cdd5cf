"""Progressive delivery: verdicts that arrive as files, in any order, and the records with what has come so far."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schema import VERDICT_DDL, ddl
from ..sources.versions import Versions

#: Versions of the verdicts that stay readable.
KEPT = 20


def verdict_fields() -> list[T.StructField]:
    return [f for f in ddl(VERDICT_DDL) if f.name != "id"]


def last_of(rows: DataFrame) -> DataFrame:
    """Of several states of one id (id, last) the last."""
    return rows.groupBy("id").agg(F.max("last").alias("last"))


def verdict_state(spark: SparkSession, out_path: str) -> DataFrame:
    """id and last (a struct of seq and the verdict), a row for each id that has a verdict."""
    found = Versions(spark, f"{out_path}/verdicts").read()
    if found is None:
        last = ", ".join(["seq: bigint", *(f"{f.name}: {f.dataType.simpleString()}" for f in verdict_fields())])
        return spark.createDataFrame([], f"id string, last struct<{last}>")
    return last_of(found)


def latest_records(spark: SparkSession, out_path: str) -> DataFrame:
    """The output's records with resultat_ia (null where there is none yet) and seq, as of the last batch published."""
    records = Versions(spark, f"{out_path}/records").read()
    if records is None:
        raise ValueError(f"no records in {out_path}")
    return records.join(verdict_state(spark, out_path), "id", "left").select(
        *(F.col(c) for c in records.columns), F.when(F.col("last").isNotNull(), F.struct(*(F.col(f"last.{f.name}") for f in verdict_fields()))).alias("resultat_ia"), F.col("last.seq").alias("seq")
    )


def follow_verdicts(spark: SparkSession, records: DataFrame | None, verdict_path: str, out_path: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Read new JSON-lines verdict files; latest_records() joins what has come to the records.

    The last verdict of each id, by seq, is a streaming aggregate, whose state Spark keeps under the checkpoint: a late
    verdict with a smaller seq changes nothing. A micro-batch writes the ids that it touches as a new part of a versioned
    table, and parts of one size are merged, so a batch writes in proportion to its verdicts. A batch that is repeated
    after a crash is published once. Several runs may follow one another on an output, also with new checkpoints: what is
    read is the largest seq of all. records are written if the output has none, and are ignored otherwise.

    trigger availableNow: all files that are there are taken, then the query ends. stop() of the query cancels; the
    batches that were published stay, and the next call with this checkpoint goes on from there.
    """
    known = Versions(spark, f"{out_path}/records")
    if known.manifest() is None:
        if records is None:
            raise ValueError("the output has no records yet")
        known.replace(records.drop("resultat_ia", "seq"))
    verdicts = Versions(spark, f"{out_path}/verdicts")
    run = f"batch-{zlib.crc32(checkpoint.encode()):08x}"
    stream = spark.readStream.schema(VERDICT_DDL + ", seq long").option("maxFilesPerTrigger", files_a_batch).json(verdict_path)

    def publish(batch: DataFrame, number: int) -> None:
        found = verdicts.manifest()
        if found is not None and found.notes.get(run, -1) >= number:
            batch.write.format("noop").mode("overwrite").save()  # published before a crash; the state is still to be made
            return
        verdicts.commit(batch, found, True, {run: number})
        verdicts.compact(last_of)
        verdicts.expire(KEPT)

    # seq first, so that the largest struct is the last verdict; of one seq the largest by value.
    last = F.struct("seq", *(f.name for f in verdict_fields()))
    return last_of(stream.where("id is not null").select("id", last.alias("last"))).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
