"""Orders and ranks over all rows, without gathering all rows in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import rule_cascade
from ..functions.text import legal_key, natural_key, truthy
from ..plans.lineage import cut


def ranked(df: DataFrame, keys: list[Column], name: str = "rang", within: dict[str, Column] | None = None) -> DataFrame:
    """Adds the rank, from 1, in the order of keys; within gives keys, for ranks among rows that agree in them.

    Rows are dealt to ranges of (within, keys) whose bounds Spark samples, and sorted in each; a range's rows are numbered
    as they pass, and the ranges' counts are summed up. So no task sees more than a range, however few values the leading
    keys have; end keys with a position, and equal values split too. Keys are computed once, and the lineage is cut, as
    counts and rows must come from one and the same deal. A group's own ranks begin at its least rank.
    """
    apart = {f"__in_{k}": c for k, c in (within or {}).items()}
    order = {f"__key_{i}": c for i, c in enumerate(keys)}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns(apart | order).repartitionByRange(parts, *apart, *order).sortWithinPartitions(*apart, *order)
    numbered = cut(dealt.withColumn("__at", F.monotonically_increasing_id()).drop(*order))  # the range in the upper bits, the row in the lower 33
    in_range = F.shiftright("__at", 33)
    counts = numbered.groupBy(in_range.alias("__range")).count().collect()  # a row a range
    offsets, seen = [], 0
    for row in sorted(counts):
        offsets.append((row["__range"], seen))
        seen += row["count"]
    before = df.sparkSession.createDataFrame(offsets, "__range long, __before long")
    out = numbered.withColumn("__range", in_range).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    if apart:
        starts = out.groupBy(*apart).agg(F.min(name).alias("__start")).select(*(F.col(k).alias(f"{k}_s") for k in apart), "__start")
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}_s")) for k in apart))
        out = out.join(starts, same).withColumn(name, F.col(name) - F.col("__start") + 1).drop("__start", *(f"{k}_s" for k in apart))
    return out.withColumn(name, F.col(name).cast("int")).drop("__at", "__range", "__before", *apart)


def with_priority(df: DataFrame) -> DataFrame:
    """Adds priorite and action, from dispositif or else texte."""
    text = truthy("dispositif", *(["texte"] if "texte" in df.columns else []), default="")
    return df.withColumn("__rule", rule_cascade(text)).withColumns({"priorite": F.col("__rule.priority"), "action": F.col("__rule.action")}).drop("__rule")


def presort(df: DataFrame, engine: str = "B", position: str = "_pos") -> DataFrame:
    """Adds priorite, action and rang.

    B: article and numero in natural order, priority between them. A: priority (of texte alone), then numero by code
    point. doctrine: legal order of articles, then alinéa, impact, rapporteur first, numero. Ties keep input order.
    """
    if engine == "A":
        text = F.col("texte") if "texte" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("__rule", rule_cascade(text)).withColumns({"priorite": F.col("__rule.priority"), "action": F.col("__rule.action")}).drop("__rule")
        numero = F.coalesce("numero", F.lit(""))
        return ranked(df, [F.col("priorite"), numero, F.col(position)])
    df = with_priority(df)
    number = natural_key("numero")
    if engine == "B":
        return ranked(df, [natural_key("article"), F.col("priorite"), number, F.col(position)])
    alinea = F.col("point_impact.alinea") if "point_impact" in df.columns else F.col("alinea")
    later = ~F.coalesce("rapporteur", F.lit(False))
    return ranked(df, [legal_key("article"), alinea, F.col("priorite"), later, number, F.col(position)])


def running_rank(df: DataFrame, flag: str = "saute_modele", position: str = "_pos", name: str = "rang") -> DataFrame:
    """Adds the rank in which rows are settled: those that the flag marks first, all others after them, each in input order."""
    return ranked(df, [~F.coalesce(F.col(flag), F.lit(False)), F.col(position)], name)


def missing_last(df: DataFrame, rank: Column, position: str, name: str = "final_rank") -> DataFrame:
    """Final positions when rows are put in the order of rank, missing last."""
    return ranked(df, [rank.isNull(), rank, F.col(position)], name)


def moved(df: DataFrame, source: int, target: int, position: str = "_pos") -> DataFrame:
    """The row at source goes to target; those between move up or down by one."""
    p = F.col(position)
    if source < target:
        now = F.when(p == source, target).when(p.between(source + 1, target), p - 1).otherwise(p)
    else:
        now = F.when(p == source, target).when(p.between(target, source - 1), p + 1).otherwise(p)
    return df.withColumn(position, now.cast(df.schema[position].dataType))


def folded(moves: list[tuple[int, int]], rows: int) -> list[tuple[int, int, int]]:
    """What a log of moves comes to: (position, anchor, place) of each row that it moved. The row goes behind the unmoved row
    at anchor (-1: before all), place-th of those that do; positions are those before the first move."""
    segments = [[0, rows]]  # of first positions in their present order: start and length

    def cut_at(at: int) -> int:
        """The number of the segment that begins at a present position."""
        for i, (start, many) in enumerate(segments):
            if at <= 0:
                return i
            if at < many:
                segments[i : i + 1] = [[start, at], [start + at, many - at]]
                return i + 1
            at -= many
        return len(segments)

    gone = set()
    for source, target in moves:
        if not 0 <= source < rows:
            raise ValueError(f"no row at {source}")
        i = cut_at(source)
        cut_at(source + 1)
        own = segments.pop(i)
        gone.add(own[0])
        segments.insert(cut_at(target), own)
    out, anchor, place = [], -1, 0
    for start, many in segments:
        if many == 1 and start in gone:
            place += 1
            out.append((start, anchor, place))
        elif many:
            anchor, place = start + many - 1, 0
    return out


def moved_many(df: DataFrame, moves: list[tuple[int, int]], position: str = "_pos") -> DataFrame:
    """df with the positions, from 0 without gaps, after all moves (source, target), each of the list that the ones before left.

    The log is folded first: only rows that it moved get a key of their own, between two neighbours; the others are ordered
    by the position that they have. So the work is one order of all rows, however many moves there are. The table of moved
    rows is as long as the log, which the caller holds.
    """
    kind = df.schema[position].dataType
    own = df.sparkSession.createDataFrame(folded(moves, df.count()), "__was long, __anchor long, __place int")
    keyed = df.join(F.broadcast(own), F.col(position).cast("long") == F.col("__was"), "left")
    out = ranked(keyed, [F.coalesce("__anchor", F.col(position).cast("long")), F.coalesce("__place", F.lit(0))], "__now")
    return out.withColumn(position, (F.col("__now") - 1).cast(kind)).drop("__was", "__anchor", "__place", "__now")


def without_id(df: DataFrame, value, name: str = "id") -> DataFrame:
    """All rows but those with the id."""
    return df.where(~F.col(name).eqNullSafe(F.lit(value)))


def first_with(df: DataFrame, condition: Column, position: str = "_pos") -> DataFrame:
    """The first row that meets the condition, if any."""
    return df.where(condition).orderBy(position).limit(1)
