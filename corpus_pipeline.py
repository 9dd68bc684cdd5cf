"""A corpus pipeline over `documents`: each stage works on all that the one before it kept.

Null and empty texts are judged like others by the classifier, link with nothing, hold nothing to cut, are cells of no
tokens in mixing and have no ids. A null doc_id is never a near duplicate, and nothing is cut from its text. Rows that
repeat a doc_id stay or go together as near duplicates and in mixing; toxicity and repeats judge each row's own text.
Null languages and sources are categories of their own. Columns beyond those of documents are left out before the first
stage, so no name can clash. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greffe.llm import bpe, mixing, neardup, repeats, toxicity, work

#: No SQL: a trained classifier decides in the first stage. The tests hold the stages against brute force.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that the mixing stage samples.
SHARE = 0.8
#: Similarity of near duplicates in percent; operator 10's own query has another contract.
SIMILAR = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go."""
    return toxicity.without_toxic(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    gone = neardup.near_duplicates(docs, percent=SIMILAR).where("not kept").select("doc_id")
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word windows that an earlier document has are cut out; documents of which nothing is left go."""
    found = repeats.remove_repeats(docs, extra=["lang", "source", "n_chars"], with_text=True)
    left = found.where("n_removed < n_words or n_words = 0")
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("extra.n_chars"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "extra.lang", "extra.source", chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the source, language and topic marginals."""
    return mixing.mix(docs.select(COLUMNS), SHARE).where("sampled").select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["lang", "source", "n_chars"], with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    tables = work.WorkTables(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
        if before:
            tables.drop(before)
        before = name
    return docs
