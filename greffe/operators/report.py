"""Counts and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import colour_emoji
from ..functions.text import content_line, rtf_escape, rtf_line, truthy
from .groups import decorated, with_headers

#: The preamble of the document.
RTF_HEAD = (
    r"{\rtf1\ansi\ansicpg1252\deff0",
    r"{\fonttbl{\f0\froman\fcharset0 Times New Roman;}}",
    r"\paperw11907\paperh16840\margl1843\margr1418\margt850\margb567",
    r"\pard\qc\f0\fs24\b Version provisoire du pr\u233?-jaune\b0\par",
)
RTF_DATE = r"\pard\qc\f0\fs18\i G\u233?n\u233?r\u233? le {date} \u8212? Dc. = discussion commune, Id. = identiques\i0\par\par"
STATUSES = {"n_dc": ("Incompatible", "Discussion commune"), "n_id": ("Identique", "Identiques"), "n_isole": ("Nouveau", "Isolé"), "n_erreur": ("Erreur", "Erreur IA")}


def status_counts(df: DataFrame, status: str = "statut") -> DataFrame:
    """All buckets in one pass: n_total, n_classes, n_dc, n_id, n_isole, n_erreur."""
    buckets = [F.count_if(F.col(status).isin(*values)).alias(name) for name, values in STATUSES.items()]
    return df.agg(F.count("*").alias("n_total"), F.count(status).alias("n_classes"), *buckets)


def flag_counts(df: DataFrame, flag: str = "saute_modele", result: str = "resultat_ia") -> DataFrame:
    """n_sautes, rows that were settled without the model, and any_result, whether any row has a result."""
    return df.agg(F.count_if(F.col(flag)).alias("n_sautes"), F.coalesce(F.bool_or(F.col(result).isNotNull()), F.lit(False)).alias("any_result"))


def joined_authors(column: str = "auteurs") -> Column:
    """The names joined by commas; a dash for none."""
    return truthy(F.array_join(column, ", "), default="—")


def display(df: DataFrame, rapporteur: bool = False) -> DataFrame:
    """The eight columns of the table."""
    authors = F.when(F.col("rapporteur"), "Rapporteur").otherwise(joined_authors()) if rapporteur else joined_authors()
    result = lambda name: F.col(f"resultat_ia.{name}")
    return df.select(
        F.coalesce("rang", result("rang")).alias("rang"), "numero", "article", authors.alias("auteurs"), F.coalesce(F.col("point_impact.type"), F.lit("—")).alias("point_impact"),
        F.coalesce(result("statut"), F.lit("—")).alias("statut"), result("groupe.groupe_id").alias("groupe"), F.coalesce(result("justification"), F.lit("")).alias("justification"),
    )


def rtf_lines(df: DataFrame, position: str = "_pos", title: Column | None = None, date: Column | None = None) -> DataFrame:
    """The document as ordered lines: block, position, part, line. Runs and headers are found by ranges of positions."""
    lowest = df.agg(F.min(position).alias("__least"))
    rows = with_headers(decorated(df, position), position).crossJoin(lowest).withColumn("__first", F.col(position) == F.col("__least"))
    header = F.when(F.col("new_section"), F.concat(F.when(F.col("__first"), "").otherwise("\\par\n"), F.lit(r"\pard\f0\fs24\b "), rtf_escape("header"), F.lit(r"\b0\par")))
    body = F.concat(F.lit(r"\pard\f0\fs22\tx851\tx1321\tx1985 "), rtf_line("label", "glyph", content_line("numero", "rectification", "auteurs")), F.lit(r"\par"))
    parts = rows.select(F.lit(1).alias("block"), F.col(position).alias("position"), F.posexplode(F.array_compact(F.array(header, body))).alias("part", "line"))
    date = F.date_format(F.current_date(), "dd/MM/yyyy") if date is None else date
    first = df.agg(F.min_by("texte_examine", position)["titre"].alias("t")) if "texte_examine" in df.columns else df.sparkSession.range(1).select(F.lit(None).cast("string").alias("t"))
    title = F.when(truthy("t").isNotNull(), F.concat(F.lit(r"\pard\f0\fs24\b\ul "), rtf_escape("t"), F.lit(r"\b0\ul0\par\par")))
    before, after = RTF_DATE.split("{date}")
    head = first.select(F.lit(0).alias("block"), F.lit(0).cast("long").alias("position"), F.posexplode(F.array_compact(F.array(*map(F.lit, RTF_HEAD), F.concat(F.lit(before), date, F.lit(after)), title))).alias("part", "line"))
    foot = df.sparkSession.range(1).select(F.lit(2).alias("block"), F.lit(0).cast("long").alias("position"), F.lit(0).alias("part"), F.lit("}").alias("line"))
    return head.unionByName(parts.withColumn("position", F.col("position").cast("long"))).unionByName(foot)


def write_rtf(df: DataFrame, path: str, **options) -> None:
    """Write the document: the lines range-sorted by position, so that the files in order are the document."""
    rtf_lines(df, **options).orderBy("block", "position", "part").select("line").write.text(path)


def rtf_document(df: DataFrame, **options) -> DataFrame:
    """The document of one batch that fits in a row, as a single string; see write_rtf() for more."""
    lines = rtf_lines(df, **options).select(F.struct("block", "position", "part", "line").alias("x"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("document"))


def export_name() -> Column:
    """The export's file name, with the day's date."""
    return F.concat(F.lit("amendements-classes-"), F.date_format(F.current_date(), "yyyy-MM-dd"), F.lit(".json"))


def json_lines(df: DataFrame, position: str = "_pos") -> DataFrame:
    return df.select(position, F.to_json(F.struct(*[c for c in df.columns if not c.startswith("_")])).alias("json"))


def write_json(df: DataFrame, path: str, position: str = "_pos") -> None:
    """One JSON object a line, in order."""
    json_lines(df, position).orderBy(position).select("json").write.text(path)


def write_json_document(df: DataFrame, path: str, position: str = "_pos", name: str = "amendements") -> None:
    """Write {"amendements": [...]} as one document of any size: its files in the order of their names, one after the other.

    Rows are range-sorted by position; head and foot are the rows before and after all, and each record but the first,
    whose position is the least, follows a comma.
    """
    least = df.agg(F.min(position).alias("__least"))
    record = F.to_json(F.struct(*[c for c in df.columns if not c.startswith("_")]))
    lines = df.select(F.lit(1).alias("block"), F.col(position).alias("position"), record.alias("record")).crossJoin(least)  # one row
    lines = lines.select("block", "position", F.concat(F.when(F.col("position") == F.col("__least"), "").otherwise(","), "record").alias("line"))
    edge = lambda block, line: df.sparkSession.range(1).select(F.lit(block).alias("block"), F.lit(None).cast(df.schema[position].dataType).alias("position"), F.lit(line).alias("line"))
    lines.unionByName(edge(0, f'{{"{name}": [')).unionByName(edge(2, "]}")).orderBy("block", "position").select("line").write.text(path)


def json_document(df: DataFrame, position: str = "_pos") -> DataFrame:
    """{"amendements": [...]} of one batch that fits in a row, indented by two spaces, and its file name; see write_json() for more."""
    kept = F.struct(*[c for c in df.columns if not c.startswith("_")])
    rows = df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), kept.alias("r")))), lambda x: x["r"]).alias("amendements"))
    return rows.select(export_name().alias("name"), F.to_json(F.struct("amendements"), {"pretty": "true"}).alias("document"))


def markdown_lines(df: DataFrame) -> DataFrame:
    """One block a verdict: coloured dot, bold id, status, quoted reason."""
    block = F.concat(colour_emoji("alerte_couleur"), F.lit(" **"), F.col("id"), F.lit("** : "), F.col("statut"), F.lit("\n> "), F.coalesce("justification", F.lit("")), F.lit("\n\n"))
    return df.withColumn("markdown", block)
