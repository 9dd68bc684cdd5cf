"""Exact groups, runs of rows and their decorations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import BRACKET_LABELS, looked_up, status_group
from ..functions.text import norm_text, section_header, truthy
from .ranking import ranked


def numbered_groups(df: DataFrame, keys: list[str], order: str, name: str = "groupe_no") -> DataFrame:
    """Adds the number of each row's group of two or more with equal keys, null for rows alone.

    Groups are numbered from 1 in the order of their first member, which order gives. They are aggregated before
    they are joined back, so a large group is no window of its own.
    Rows with a null key are alone.
    """
    groups = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__n"), F.min(order).alias("__first")).where("__n >= 2")
    numbers = ranked(groups, [F.col("__first")], name).select(*keys, name)
    return df.join(numbers, keys, "left")


def identiques(df: DataFrame, rank: str = "rang") -> DataFrame:
    """Adds groupe (type, groupe_id) and saute_modele to rows whose article and text agree with another's; empty texts never group."""
    text = truthy("dispositif", *(["texte"] if "texte" in df.columns else []), default="")
    keyed = df.withColumns({"__a": norm_text("article"), "__d": norm_text(text)})
    named = numbered_groups(keyed.withColumn("__k", F.when(F.col("__d") != "", F.col("__d"))), ["__a", "__k"], rank, "__no")
    group = F.when(F.col("__no").isNotNull(), F.struct(F.lit("identiques").alias("type"), F.concat(F.lit("grp-identiques-"), F.col("__no")).alias("groupe_id")))
    return named.withColumns({"groupe": group, "saute_modele": F.col("__no").isNotNull()}).drop("__a", "__d", "__k", "__no")


def before_range(df: DataFrame, value: str, order: str, within: list[str] | None = None) -> DataFrame:
    """Adds __range (a thousand positions), __seen (rows before it) and __last, the value of the last row before it, as struct(v).

    The one window over everything, or over all rows that agree in within, sees a row a range.
    """
    keys = [*(within or []), "__range"]
    df = df.withColumn("__range", F.floor(F.col(order) / 1000))
    ranges = df.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("__end"), F.count("*").alias("__many"))
    w = Window.partitionBy(*within).orderBy("__range") if within else Window.orderBy("__range")
    seen = F.coalesce(F.sum("__many").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*(F.col(k).alias(f"{k}_r") for k in keys), F.lag("__end").over(w).alias("__last"), seen.alias("__seen"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys))
    return df.join(ranges, same).drop(*(f"{k}_r" for k in keys))


def previous(df: DataFrame, value: str, order: str, name: str, within: list[str] | None = None) -> DataFrame:
    """Adds the value of the row before, as struct(v), null for the first; order is a number, of one document as long as may
    be, or of one for each value of within."""
    w = Window.partitionBy(*(within or []), "__range").orderBy(order)
    own = F.lag(F.struct(F.col(value).alias("v"))).over(w)
    return before_range(df, value, order, within).withColumn(name, F.coalesce(own, "__last"))


def document_islands(df: DataFrame, value: str, order: str) -> DataFrame:
    """islands() of all rows as one document, by ranges of a thousand positions."""
    rows = previous(df, value, order, "__before")
    new = F.col("__before").isNull() | ~F.col("__before.v").eqNullSafe(F.col(value))
    w = Window.partitionBy("__range").orderBy(order)
    rows = rows.withColumns({"__new": new.cast("int"), "__at": F.col("__seen") + F.row_number().over(w)})
    starts = rows.groupBy("__range").agg(F.sum("__new").alias("__n"))
    starts = starts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__runs"))
    rows = rows.join(starts, "__range").withColumn("island", (F.col("__runs") + F.sum("__new").over(w)).cast("int"))
    runs = rows.groupBy("island").agg(F.count("*").cast("int").alias("span"), F.min("__at").alias("__start"))
    return rows.join(runs, "island").withColumn("place", (F.col("__at") - F.col("__start") + 1).cast("int")).select(*df.columns, "island", "span", "place")


def islands(df: DataFrame, value: str, order: str, within: list[str]) -> DataFrame:
    """Adds island (number of the run of equal values), span and place (from 1) of each row in its run.

    within: keys of documents, each of which fits in a task; without any, all rows are one document of any length.
    """
    if not within:
        return document_islands(df, value, order)
    w = Window.partitionBy(*within).orderBy(order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    df = df.withColumn("__changed", changed).withColumn("island", F.sum("__changed").over(w).cast("int")).drop("__changed")
    run = Window.partitionBy(*within, "island")
    return df.withColumns({"span": F.count("*").over(run).cast("int"), "place": F.row_number().over(run.orderBy(order)).cast("int")})


def bracket(place: Column, span: Column, known: Column) -> Column:
    """╓ for the first row of a run, ╙ for the last, ║ between; nothing outside groups."""
    return F.when(~known, "").when(place == 1, "╓").when(place == span, "╙").otherwise("║")


def decorated(df: DataFrame, order: str = "_pos", within: list[str] | None = None) -> DataFrame:
    """Adds label and glyph for runs of one group of a kind that has brackets."""
    kind = F.col("groupe.type")
    known = kind.isin(*BRACKET_LABELS) & (F.coalesce(F.col("groupe.groupe_id"), F.lit("")) != "")
    df = df.withColumn("__known", F.coalesce(known, F.lit(False))).withColumn("__id", F.when(F.col("__known"), F.col("groupe.groupe_id")))
    out = islands(df, "__id", order, within or [])
    place, span = F.col("place"), F.col("span")
    label = F.when(F.col("__known") & (place == 1), looked_up("groupe.type", BRACKET_LABELS)).otherwise("")
    return out.withColumns({"label": label, "glyph": bracket(place, span, F.col("__known"))}).drop("__known", "__id", "island", "span", "place")


def with_headers(df: DataFrame, order: str = "_pos", within: list[str] | None = None) -> DataFrame:
    """Adds header and new_section: whether the header differs from the row before."""
    df = df.withColumn("header", section_header("article"))
    new = F.col("__before").isNull() | ~F.col("__before.v").eqNullSafe(F.col("header"))
    return previous(df, "header", order, "__before", within).withColumn("new_section", new).select(*df.columns, "new_section")


def client_group(status: Column) -> Column:
    """The group that a status alone names on the client's way."""
    kind = status_group(status)
    name = F.when(kind == "identiques", "grp-identiques-llm").otherwise(F.concat(F.lit("grp-"), kind, F.lit("-1")))
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), name.alias("groupe_id")))


def of_type(df: DataFrame, kind: str = "doublon") -> DataFrame:
    """The rows whose group is of a type."""
    return df.where(F.col("groupe.type") == kind)


def constant_group(kind: Column) -> Column:
    """One group a kind for the whole batch: grp-<kind>-1."""
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.concat(F.lit("grp-"), kind, F.lit("-1")).alias("groupe_id")))
