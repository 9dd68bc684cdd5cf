"""Raw records of any shape to flat ones. A total function: odd records become stubs, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_tags, truthy, unescape_all

NIL, UNKNOWN = "Non renseigné", "Inconnu"


def piece(raw: Column, path: str) -> Column:
    return F.try_variant_get(raw, path, "variant")


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def plain(v: Column, kind_of: Column) -> Column:
    """Text of a leaf: an XML-nil object is a fixed phrase, other objects and lists are JSON, null and blank are empty."""
    nil = piece(v, '$["@xmlns"]').isNotNull() | piece(v, '$["@xmlns:xsi"]').isNotNull()
    text = F.try_variant_get(v, "$", "string")
    blank = text.isNull() | (F.regexp_replace(text, r"[\s\u0085\p{Z}﻿]+", "") == "")
    return F.when(kind_of.startswith("OBJECT") & nil, NIL).when(kind_of.startswith("OBJECT") | kind_of.startswith("ARRAY"), F.to_json(v)).when(blank, "").otherwise(text)


#: Leaves of raw records that are texts.
LEAVES = {
    "uid": "$.uid", "numero": "$.identification.numeroLong", "rect": "$.identification.numeroRect", "titre": "$.pointeurFragmentTexte.division.titre",
    "designation": "$.pointeurFragmentTexte.division.articleDesignation", "depot": "$.cycleDeVie.dateDepot", "libelle": "$.signataires.libelle", "signataires": "$.signataires",
    "acteur": "$.signataires.auteur.acteurRef", "premier": "$.signataires.auteur[0].acteurRef", "cartouche": "$.corps.cartoucheInformatif",
    "corps": "$.corps.contenuAuteur.dispositif", "expose": "$.corps.contenuAuteur.exposeSommaire",
}
#: Other parts whose presence or kind decides.
PARTS = {"identification": "$.identification", "pointeur": "$.pointeurFragmentTexte", "auteur": "$.signataires.auteur", "premier_auteur": "$.signataires.auteur[0]"}
FLAT = ("id", "numero", "article", "rectification", "date_depot", "dispositif", "texte", "auteur", "avis_commission", "avis_gouvernement", "expose_sommaire", "categorie", "point_impact")


def normalize(records: DataFrame, raw: str = "raw", position: str = "_pos", tags: bool = False) -> DataFrame:
    """Flat records. tags: strip markup from the texts, so that rules on how a text starts apply.

    Each part of a record is taken out once, and each leaf made a text once, in selects of their own.
    """
    others = [c for c in records.columns if c != raw]
    source = F.col(raw)
    inner = piece(source, "$.amendement")
    df = records.withColumn("__inner", inner).select("*", F.when(kind(F.col("__inner")).startswith("OBJECT"), F.col("__inner")).otherwise(source).alias("__am"))
    am = F.col("__am")
    every = {**LEAVES, **PARTS}
    # As arrays: one expression serves all leaves, which keeps the generated code small.
    parts = F.array(*[piece(am, path) for path in every.values()])
    flats = F.array(*[F.try_variant_get(am, f"$.{name}", "string") for name in FLAT])
    df = df.select(*others, "__am", kind(am).alias("__kind"), parts.alias("__parts"), flats.alias("__flats"), F.try_variant_get(am, "$.auteurs", "array<string>").alias("__names"))
    texts = F.transform("__parts", lambda v: F.struct(v.isNotNull().alias("there"), kind(v).alias("kind"), plain(v, kind(v)).alias("text")))
    df = df.select(*others, "__am", "__kind", "__flats", "__names", texts.alias("__texts"))
    at = lambda name: F.col("__texts")[list(every).index(name)]
    f = lambda name: F.col("__flats")[FLAT.index(name)]
    k, p = (lambda name: at(name)["kind"]), (lambda name: at(name)["text"])
    there = lambda name: at(name)["there"]
    signers = F.when(~k("signataires").startswith("OBJECT"), p("signataires"))  # an object of signatories is no text of its own
    nobody = F.when(k("premier_auteur") != "VOID", F.lit(UNKNOWN))
    first = F.when(k("auteur").startswith("ARRAY"), F.coalesce(truthy(p("premier")), nobody)).when(k("auteur").startswith("OBJECT"), truthy(p("acteur"), default=UNKNOWN))
    chosen = {name: p(name) for name in ("uid", "rect", "titre", "designation", "depot", "expose")} | {"numero": truthy(p("numero"), default=UNKNOWN)}
    chosen |= {"auteur": truthy(p("libelle"), first, signers, default=""), "dispositif": truthy(p("cartouche"), p("corps"), default="")}
    # All texts pass Python as one, so that records without an entity send a null.
    names_of = list(chosen)
    df = df.select(
        *others, "__am", "__kind", "__names", "__flats", F.array(*chosen.values()).alias("__chosen"), (there("identification") | there("uid") | there("pointeur")).alias("__raw"),
        (there("identification") & (k("identification") == "VOID")).alias("__broken"),
    )
    df = df.withColumn("__chosen", unescape_all("__chosen"))
    u, is_raw, broken = (lambda name: F.col("__chosen")[names_of.index(name)]), F.col("__raw"), F.col("__broken")
    is_object = F.col("__kind").startswith("OBJECT")
    index = F.col(position).cast("string")
    clean = strip_tags if tags else (lambda x: x)
    names = F.col("__names")

    def pick(of_raw: Column, of_flat: Column) -> Column:
        return F.when(~is_object | broken, F.lit(None)).when(is_raw, of_raw).otherwise(of_flat)

    body = F.coalesce(pick(u("dispositif"), truthy(f("dispositif"), f("texte"), default="")), F.lit(""))
    deep = lambda path, as_type="string": F.try_variant_get(am, path, as_type)
    return df.select(
        *others,
        F.when(broken, F.concat(F.lit("amdt-err-"), index)).when(~is_object, F.concat(F.lit("amdt-"), index)).when(is_raw, truthy(u("uid"), F.nullif(u("numero"), F.lit(UNKNOWN)), F.concat(F.lit("amdt-"), index))).otherwise(truthy(f("id"), F.concat(F.lit("amdt-"), index))).alias("id"),
        F.when(broken, "Erreur").when(~is_object, UNKNOWN).when(is_raw, u("numero")).otherwise(F.coalesce(f("numero"), F.lit(""))).alias("numero"),
        F.coalesce(pick(u("titre"), f("article")), F.lit("")).alias("article"),
        pick(u("rect"), f("rectification")).alias("rectification"),
        pick(u("depot"), f("date_depot")).alias("date_depot"),
        F.struct(*[deep(f"$.texte_examine.{name}").alias(name) for name in ("titre", "lecture", "numero_texte")]).alias("texte_examine"),
        F.coalesce(pick(F.when(u("auteur") != "", F.array(u("auteur"))), F.coalesce(names, F.when(f("auteur") != "", F.array(f("auteur"))))), F.array().cast("array<string>")).alias("auteurs"),
        pick(u("auteur"), truthy(f("auteur"), F.array_join(names, ", "))).alias("auteur"),
        F.coalesce(deep("$.rapporteur", "boolean"), F.lit(False)).alias("rapporteur"),
        f("avis_commission").alias("avis_commission"), f("avis_gouvernement").alias("avis_gouvernement"),
        clean(body).alias("dispositif"), clean(body).alias("texte"), clean(pick(u("expose"), f("expose_sommaire"))).alias("expose_sommaire"),
        F.struct(pick(u("designation"), truthy(deep("$.point_impact.type"), f("point_impact"))).alias("type"), deep("$.point_impact.alinea", "int").alias("alinea")).alias("point_impact"),
        f("categorie").alias("categorie"),
        F.when(broken, "error").when(~is_object, "not an object").alias("_norm_error"),
    )


def raw_text(df: DataFrame) -> DataFrame:
    """Adds a short plain text of a record for a prompt: author to 100, dispositif to 1000, exposé to 500 characters."""
    cut = lambda c, n: F.substring(strip_tags(F.coalesce(F.col(c), F.lit(""))), 1, n)
    body = F.concat(F.lit("Dispositif: "), cut("dispositif", 1000), F.lit("\nExposé: "), cut("expose_sommaire", 500))
    return df.withColumns({"auteur_court": cut("auteur", 100), "texte_brut": body})
