"""Model replies: find and read the JSON in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import col, strip


#: Fixed value: the reason of a verdict whose reply can't be read.
UNREADABLE = "Erreur de formatage du modèle."


def without_fence(reply: Column | str) -> Column:
    """Without a Markdown code fence around the reply."""
    text = strip(F.coalesce(col(reply), F.lit("")))
    return F.when(text.startswith("```"), strip(F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", ""))).otherwise(text)


def first_json(reply: Column | str) -> Column:
    """From the first [ to the last ], or the first { to the last }, whichever starts first; else the text itself."""
    found = F.regexp_extract(without_fence(reply), r"(?s)\[.*\]|\{.*\}", 0)
    return F.when(found == "", without_fence(reply)).otherwise(found)


def object_slice(reply: Column | str) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(F.coalesce(col(reply), F.lit("")), r"(?s)\{.*\}", 0)


def batch_verdicts(reply: Column | str) -> Column:
    """The entries of a whole batch's reply, a list or an object that holds one, as array<struct<id, rang, statut, justification>>; null if unreadable."""
    parsed = F.try_parse_json(first_json(reply))
    kind = F.coalesce(F.schema_of_variant(parsed), F.lit(""))
    # In an object the list is under a name that prompts ask for.
    rows = F.when(kind.startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>")).when(kind.startswith("OBJECT"), F.try_variant_get(parsed, "$.classements", "array<variant>"))
    get = lambda v, name, as_type: F.try_variant_get(v, f"$.{name}", as_type)
    return F.transform(rows, lambda v: F.struct(get(v, "id", "string").alias("id"), get(v, "rang", "int").alias("rang"), get(v, "statut", "string").alias("statut"), get(v, "justification", "string").alias("justification")))


def verdict(reply: Column | str) -> Column:
    """Struct(statut, justification, alerte_couleur): of a list the first element; unreadable JSON gives Erreur."""
    parsed = F.try_parse_json(first_json(reply))
    kind = F.schema_of_variant(parsed)
    first = F.when(kind.startswith("ARRAY"), F.try_variant_get(parsed, "$[0]", "variant")).otherwise(parsed)
    readable = F.schema_of_variant(first).startswith("OBJECT")
    status = F.when(readable, F.coalesce(F.try_variant_get(first, "$.statut", "string"), F.lit("Nouveau"))).otherwise(F.lit("Erreur"))
    why = F.when(readable, F.coalesce(F.try_variant_get(first, "$.justification", "string"), F.lit(""))).otherwise(F.lit(UNREADABLE))
    return F.struct(status.alias("statut"), why.alias("justification"), rules.status_colour(status).alias("alerte_couleur"))
