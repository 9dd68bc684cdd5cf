"""Amendment documents: JSON files of several envelopes, inline texts, saved sessions, rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ddl
from .versions import Versions


def entries(document: Column) -> Column:
    """The records of a parsed document as array<variant>; null if it has no known envelope. The first that fits wins."""
    get = lambda path: F.try_variant_get(document, path, "variant")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    many = lambda path: F.try_variant_get(document, path, "array<variant>")
    is_list, is_object = lambda v: kind(v).startswith("ARRAY"), lambda v: kind(v).startswith("OBJECT")

    def list_or_one(path: str) -> Column:
        return F.when(is_list(get(path)), many(path)).when(is_object(get(path)), F.array(get(path)))

    return (
        F.when(is_list(document), many("$"))
        .when(list_or_one("$.amendments").isNotNull(), list_or_one("$.amendments"))
        .when(is_list(get("$.amendements")), many("$.amendements"))
        .when(list_or_one("$.amendements.amendement").isNotNull(), list_or_one("$.amendements.amendement"))
        .when(is_object(get("$.amendements")), F.array(get("$.amendements")))
        .when(list_or_one("$.amendement").isNotNull(), list_or_one("$.amendement"))
        .when(get("$.uid").isNotNull(), F.array(document))
    )


def unwrap(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of texts(file, value): records have file, _index (from 0) and raw (variant).

    Rows are chosen after the explosion: a filter before it would be pushed down and parse each document once a branch.
    """
    parsed = texts.withColumn("doc", F.try_parse_json("value")).withColumn("entries", entries(F.col("doc")))
    records = parsed.select("file", F.posexplode_outer("entries").alias("_index", "raw")).where("_index is not null")
    reason = F.when(F.col("doc").isNull(), "not JSON").when(F.col("entries").isNull(), "no known envelope")
    bad = parsed.select("file", F.explode_outer(F.array(reason)).alias("reason")).where("reason is not null")
    return records, bad


def read_json_documents(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Every file is one document; unreadable ones go to the quarantine and the others load."""
    texts = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return unwrap(texts.select(F.col("_metadata.file_path").alias("file"), "value"))


def read_mixed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, attachments) of a folder: JSON files as documents, where what is no list is one record; all other files as whole texts."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    is_json = F.lower("file").endswith(".json")
    parsed = texts.where(is_json).withColumn("doc", F.try_parse_json("value"))
    many = F.when(F.coalesce(F.schema_of_variant("doc"), F.lit("")).startswith("ARRAY"), F.try_variant_get("doc", "$", "array<variant>")).when(F.col("doc").isNotNull(), F.array("doc"))
    records = parsed.select("file", F.posexplode_outer(many).alias("_index", "raw")).where("_index is not null")
    return records, texts.where(~is_json)


def inline(spark: SparkSession, text: str, name: str = "texte collé") -> tuple[DataFrame, DataFrame]:
    """A pasted document."""
    return unwrap(spark.createDataFrame([(name, text)], "file string, value string"))


def positions(records: DataFrame) -> DataFrame:
    """Adds _pos: files in order of name, then order in the file; from prefix sums of the files' counts."""
    counts = records.groupBy("file").agg((F.max("_index") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return records.join(counts.select("file", before.alias("__before")), "file").withColumn("_pos", F.col("__before") + F.col("_index")).drop("__before")


def provenance(records: DataFrame) -> DataFrame:
    """The label of an import: the file's name, or how many files."""
    return records.agg(F.count_distinct("file").alias("n"), F.regexp_extract(F.min("file"), "([^/]*)$", 1).alias("name")).select(F.when(F.col("n") > 1, F.concat(F.col("n"), F.lit(" fichiers JSON"))).otherwise(F.col("name")).alias("label"))


def import_warning(records: DataFrame, bad: DataFrame) -> str | None:
    """None, a warning if some files are invalid, or an error if nothing loaded."""
    if records.isEmpty():
        raise ValueError("no file holds amendments")
    return None if bad.isEmpty() else "some files are invalid and were skipped"


def save_session(df: DataFrame, path: str, keep: int = 10) -> int:
    """Save df as a new version of the session and return its number. df may read the session itself; a write that ends
    early leaves the session as it was, and keep versions stay readable."""
    session = Versions(df.sparkSession, path)
    version = session.replace(df).version
    session.expire(keep)
    return version


def restore_session(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The saved rows of a version, or of the last one; none if nothing was saved. What was saved and can't be read is an error."""
    session = Versions(spark, path)
    if version is None:
        version = max(session.versions(), default=None)
    if version is None:
        return spark.createDataFrame([], schema)
    return session.read(version).to(ddl(schema) if isinstance(schema, str) else schema)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules' text, one row a file."""
    return spark.read.text(path, wholetext=True)
