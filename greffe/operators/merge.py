"""Merging verdicts by key, and reconciling what was asked with what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truthy


def last_verdicts(verdicts: DataFrame, order: str = "seq", key: str = "id") -> DataFrame:
    """Of several verdicts on one id the last."""
    names = [c for c in verdicts.columns if c != key]
    return verdicts.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("v")).select(key, "v.*")


def merge_verdicts(records: DataFrame, verdicts: DataFrame, order: str = "seq", key: str = "id", name: str = "resultat_ia") -> DataFrame:
    """Records with their verdict as a struct; null where there is none. Records keep their number."""
    latest = last_verdicts(verdicts, order, key)
    packed = latest.select(key, F.struct(*[c for c in latest.columns if c not in (key, order)]).alias(name))
    return records.drop(name).join(packed, key, "left")


def upsert_first(records: DataFrame, partial: DataFrame, position: str = "_pos", name: str = "resultat_ia") -> DataFrame:
    """Partial verdicts go to the first record with the id (or numero, without an id); others keep what they have."""
    keyed = records.withColumn("__key", truthy("id", "numero"))
    first = keyed.groupBy("__key").agg(F.min(position).alias("__first"))
    named = partial.select(F.col("id").alias("__key"), F.col(name).alias("__new")).dropDuplicates(["__key"])
    target = first.join(named, "__key").select("__key", F.col("__first").alias(position), "__new")
    out = keyed.join(target, ["__key", position], "left")
    old = F.col(name) if name in records.columns else F.lit(None)
    return out.withColumn(name, F.coalesce("__new", old)).drop("__key", "__new")


def missing(submitted: DataFrame, returned: DataFrame, key: str = "id") -> DataFrame:
    return submitted.select(key).distinct().join(returned.select(key), key, "left_anti")


def unknown(submitted: DataFrame, returned: DataFrame, key: str = "id") -> DataFrame:
    return missing(returned, submitted, key)


def known_only(submitted: DataFrame, returned: DataFrame, key: str = "id") -> DataFrame:
    return returned.join(submitted.select(key).distinct(), key, "left_semi")


def repeated(returned: DataFrame, key: str = "id") -> DataFrame:
    """Ids that came back more than once."""
    return returned.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def troubles(submitted: DataFrame, returned: DataFrame, key: str = "id") -> DataFrame:
    """kind (missing, unknown or repeated) and id, a row for each id that did not come back exactly once."""
    kinds = {"missing": missing(submitted, returned, key), "unknown": unknown(submitted, returned, key), "repeated": repeated(returned, key)}
    rows = None
    for kind, ids in kinds.items():
        own = ids.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def warnings(submitted: DataFrame, returned: DataFrame, key: str = "id", block: int = 1000) -> DataFrame:
    """kind of trouble, n (of all its ids), and the ids in order, joined by commas: about block of them a row, one row if n is no more."""
    kinds = {"missing": missing(submitted, returned, key), "unknown": unknown(submitted, returned, key), "repeated": repeated(returned, key).select(key)}
    rows = None
    for kind, ids in kinds.items():
        text = F.col(key).cast("string")
        many = ids.count()
        # Blocks are ranges of ids, so that no task holds all of them; ids of one range are numbered within it.
        dealt = ids.select(text.alias("x")).repartitionByRange(max(1, min(1000, -(-many // block))), "x").withColumn("__part", F.spark_partition_id())
        own = F.row_number().over(Window.partitionBy("__part").orderBy("x"))
        listed = dealt.withColumn("__block", F.floor((own - 1) / block)).groupBy("__part", "__block")
        one = listed.agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("ids")).select(F.lit(kind).alias("kind"), F.lit(many).cast("long").alias("n"), "ids")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def in_sequence(*parts: DataFrame, position: str = "_pos") -> DataFrame:
    """UNION ALL that keeps the order of the parts: part, then position."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def first_against_rest(df: DataFrame, columns: list[str], position: str = "_pos") -> DataFrame:
    """Each row but the first, with the first row's columns as ref_*. The first row is one row, so it is broadcast."""
    first = df.orderBy(position).limit(1).select(F.col(position).alias("__at"), *(F.col(c).alias(f"ref_{c}") for c in columns))
    return df.crossJoin(F.broadcast(first)).where(F.col(position) > F.col("__at")).drop("__at")


def with_reference(df: DataFrame, within: list[str], columns: list[str], position: str = "_pos") -> DataFrame:
    """Each row with the first row's columns of its own group, for batches by key. Groups are dealt to parts, each of which
    gets the reference, so that no task reads a group whole."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = df.groupBy(*within).agg(F.min_by(F.struct(*columns), position).alias("__ref"))
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(position), F.lit(parts)).cast("int"))
    each = dealt.select(*within, "__part").distinct().join(first, within)
    return dealt.join(each, [*within, "__part"]).select(*df.columns, *(F.col(f"__ref.{c}").alias(f"ref_{c}") for c in columns))


def fill_errors(df: DataFrame, name: str = "statut") -> DataFrame:
    """Records without a status get Erreur."""
    return df.withColumn(name, F.coalesce(F.col(name), F.lit("Erreur")))
