"""Checks of records and of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import IMPACT_TYPES

REQUIRED = ("id", "article", "numero", "dispositif")


def violations(required: tuple[str, ...] = REQUIRED, enums: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Names of broken rules, in order: missing:<column> and enum:<column>."""
    enums = {"point_impact.type": IMPACT_TYPES} if enums is None else enums
    tests = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"missing:{c}") for c in required]
    tests += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), f"enum:{c}") for c, allowed in enums.items()]
    return F.array_compact(F.array(*tests))


def checked(df: DataFrame, **rules) -> DataFrame:
    return df.withColumn("_violations", violations(**rules))


def duplicates(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the batch has no records")
    return df


def conform(df: DataFrame, schema) -> DataFrame:
    """The schema's columns in its order and types; further columns go."""
    return df.to(schema)
