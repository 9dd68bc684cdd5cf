"""Operator 4: mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Documents are counted by source, language and topic; one cell of that table holds its documents and tokens. The cells'
token weights are raked to the source, language and topic marginals in turn until every marginal is met. A document is
then sampled with a probability proportional to its cell's weight, calibrated so that the expected tokens are the share
asked for; cells that would need more than all their documents are kept whole and the rest make up for it.

Texts are read once: what is counted is written beside the columns that the result needs. Targets that cannot all be met
(a source in one language only, say) end the raking when its error no longer falls; the error comes back with each row.

A null source, language or topic is a category of its own, which a target with the value null is for. Null and empty
texts have no tokens; they count as one token, so that a cell of empty texts has a weight. A target for a category
without documents is ignored and the other targets scaled up; a category without a target keeps its own share. Repeated
rows draw the same number and share their fate; an empty table gives an empty table. Further columns pass through, unless
they have the name of a column that is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

#: Content types that stand for topics: the first pattern that a text holds names it.
TOPICS = (
    ("licence", r"(?i)licen[cs]ed?\b|copyright|warranty"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]|https?://"),
    ("table", r" \| .* \| "),
    ("shouting", r"[!&$%*#]{2}"),
    ("list", r"(?m)^\s*(?:[-*]|[0-9]+[.)])\s"),
    ("numbers", r"[0-9]{3}"),
)
DIMENSIONS = ("source", "lang", "topic")
#: A marginal's largest relative error at which raking ends, rounds between two looks, and the share by which the error
#: must fall from one look to the next.
TOLERANCE, ROUNDS_A_LOOK, FALLING = 1e-6, 6, 1e-3
#: Cells that one task rakes; more of them are raked by as many tasks as there are shuffle partitions.
CELLS_A_TASK = 200_000


def topic_of(text: Column) -> Column:
    found = None
    for name, pattern in TOPICS:
        found = F.when(text.rlike(pattern), name) if found is None else found.when(text.rlike(pattern), name)
    return F.coalesce(found, F.lit("prose"))


def category(value: Column) -> Column:
    """A category as a text that differs for null and for every value."""
    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("="), value.cast("string")))


def token_count(text: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)), F.lit(1)).cast("long")


def with_targets(cells: DataFrame, targets: dict[str, DataFrame | None]) -> DataFrame:
    """cells with weight, their share of all tokens, and for each dimension the target of their category.

    Without a target table, targets lean half-way from a dimension's own shares to equal ones.
    """
    counts = cells.agg(F.sum("tokens").alias("tokens"), *(F.count_distinct(c).alias(c) for c in DIMENSIONS)).first()
    total = float(counts["tokens"] or 1)
    out = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    for column in DIMENSIONS:
        own = cells.groupBy(column).agg((F.sum("tokens") / F.lit(total)).alias("own"))
        if targets.get(column) is None:
            wanted = own.select(column, (0.5 * F.col("own") + F.lit(0.5 / max(1, counts[column]))).alias(f"{column}_target"))
        else:
            given = targets[column].select(category(F.col("value")).alias(column), F.col("target").cast("double").alias("target"))
            wanted = own.join(given, column, "left").select(column, F.coalesce("target", "own").alias("target"))
            wanted = wanted.select(column, (F.col("target") / F.lit(wanted.agg(F.sum("target")).first()[0] or 1.0)).alias(f"{column}_target"))
        out = out.join(wanted, column)
    return out


def rescaled(cells: DataFrame, column: str) -> DataFrame:
    """cells whose weights meet the marginal of one dimension."""
    have = F.sum("weight").over(Window.partitionBy(column))
    return cells.withColumn("weight", F.coalesce(F.col("weight") * F.col(f"{column}_target") / F.nullif(have, F.lit(0.0)), F.lit(0.0)))


def off_targets(cells: DataFrame) -> float:
    """The largest relative error of a marginal."""
    sums = None
    for column in DIMENSIONS:
        own = cells.groupBy(column).agg(F.sum("weight").alias("have"), F.max(f"{column}_target").alias("target")).select("have", "target")
        sums = own if sums is None else sums.unionByName(own)
    return sums.agg(F.max(F.abs(F.col("have") / F.nullif(F.col("target"), F.lit(0.0)) - 1))).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame | None], tables: work.WorkTables) -> tuple[DataFrame, float]:
    """cells(source, lang, topic, docs, tokens) with weight: shares of all tokens, raked to the marginals; and the error left.

    The table has a row for each combination of categories that occurs, not for each document. Few cells are raked in
    one task, all rounds of a look at once. Of many, each step's sums are aggregated and joined back.
    """
    in_one_task = cells.count() <= CELLS_A_TASK
    cells = tables.keep(with_targets(cells, targets).coalesce(1) if in_one_task else with_targets(cells, targets), "cells-0")
    turn, error = 0, None
    while True:
        before, look = error, turn
        if in_one_task:
            cells = cells.coalesce(1)
        for _ in range(ROUNDS_A_LOOK):
            for column in DIMENSIONS:
                if in_one_task:
                    cells = rescaled(cells, column)
                else:
                    sums = tables.keep(cells.groupBy(column).agg(F.sum("weight").alias("__have")), f"sums-{turn}-{column}")
                    step = cells.join(sums, column).withColumn("weight", F.coalesce(F.col("weight") * F.col(f"{column}_target") / F.nullif("__have", F.lit(0.0)), F.lit(0.0)))
                    cells = tables.keep(step.drop("__have"), f"cells-{turn}-{column}")
            turn += 1
        cells = tables.keep(cells, f"cells-{turn}")
        tables.drop(f"cells-{look}", *(f"{kind}-{t}-{c}" for kind in ("sums", "cells") for t in range(look, turn) for c in DIMENSIONS))
        error = off_targets(cells)
        if error < TOLERANCE or before is not None and error > before * (1 - FALLING):
            return cells, error


def probabilities(cells: DataFrame, share: float) -> DataFrame:
    """Adds probability: min(1, s * weight / token share), with s such that share of all tokens is expected.

    Cells are put in the order in which they would be full, by their boost (weight a token). With all cells above some
    boost full, s follows from the others; the right one is the first for which the next cell isn't full. Sums by boost
    are made in ranges of it, so that no task sees all cells.
    """
    total, weights = (x or 0 for x in cells.agg(F.sum("tokens"), F.sum("weight")).first())
    boosted = cells.withColumn("__boost", F.col("weight") * F.lit(float(total)) / F.col("tokens"))
    # Ordered groups of cells: the boost's exponent and first bits; few, whatever the number of cells.
    group = F.floor(F.log2(F.greatest("__boost", F.lit(1e-300))) * 8)
    boosted = boosted.withColumn("__group", group)
    above = Window.orderBy(F.desc("__group")).rowsBetween(Window.unboundedPreceding, -1)
    sums = boosted.groupBy("__group").agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"))
    sums = sums.select("__group", F.coalesce(F.sum("t").over(above), F.lit(0)).alias("__t"), F.coalesce(F.sum("w").over(above), F.lit(0.0)).alias("__w"))
    within = Window.partitionBy("__group").orderBy(F.desc("__boost"), *DIMENSIONS).rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("__t") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    left = F.greatest(F.lit(float(weights)) - F.col("__w") - F.coalesce(F.sum("weight").over(within), F.lit(0.0)), F.lit(0.0))
    found = boosted.join(sums, "__group").withColumn("__full", full).withColumn("__left", left)
    found = found.withColumn("__s", (F.lit(share * total) - F.col("__full")) / F.nullif(F.col("__left") * F.lit(float(total)), F.lit(0.0)))
    scale = found.agg(F.max(F.when(F.col("__s") * F.col("__boost") <= 1, F.col("__s")))).first()[0]
    chance = F.lit(1.0) if scale is None else F.least(F.lit(1.0), F.lit(max(0.0, scale)) * F.col("__boost"))
    return boosted.select(*DIMENSIONS, "docs", "tokens", "weight", chance.alias("probability"))


def draw(key: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on the key and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


ADDED = ("topic", "n_tokens", "weight", "probability", "sampled", "error")


def mix(docs: DataFrame, share: float = 0.5, targets: dict[str, DataFrame | None] | None = None, seed: int = 1, columns: list[str] | None = None) -> DataFrame:
    """The documents with topic, n_tokens, weight, probability, sampled (whether a document is in the sample) and error.

    targets: for source, lang or topic a table (value, target); by default see with_targets(). columns: those of docs to return,
    all by default.
    """
    tables = work.WorkTables(docs.sparkSession, "mixing")
    own = [c for c in (docs.columns if columns is None else columns) if c not in ADDED]
    topic = topic_of(F.coalesce(docs["text"], F.lit("")))
    cell = F.struct(category(docs["source"]).alias("source"), category(docs["lang"]).alias("lang"), category(topic).alias("topic"))
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("own"), docs["doc_id"].alias("key"), topic.alias("topic"), cell.alias("cell"), token_count(docs["text"]).alias("n_tokens"))
    rows = tables.keep(rows, "described")
    cells = rows.groupBy("cell").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).select("cell.*", "docs", "tokens")
    raked, error = rake(tables.keep(cells, "counts"), targets or {}, tables)
    cells = tables.keep(probabilities(raked, share), "sampling").select(F.struct(*DIMENSIONS).alias("cell"), "weight", "probability")
    found = rows.join(cells, "cell")
    return found.select("own.*", "topic", "n_tokens", "weight", "probability", (draw(F.col("key"), seed) < F.col("probability")).alias("sampled"), F.lit(error).alias("error"))
