"""Further queries: files of records read, normalised, classified and delivered. See catalogue for the form."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies, rules, text
from ..operators import classify, doctrine, groups, merge, quality, ranking, report
from ..schema import VERDICT_DDL, ddl
from ..sources import documents, large, normalize
from ..streaming import progress
from .catalogue import AMENDMENTS, RANKED, STATUS, amendments, envelopes, norm, prio, query, reply_of, statuses, table
from .lineage import cut, new_folder

# Sources


def nation_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file a nation."""
    folder = new_folder(spark, "files")
    envelopes(spark, sf_dir).repartition("file").write.partitionBy("file").text(folder)
    return folder


RECORDS = """f AS (SELECT CAST(n_nationkey AS VARCHAR) AS file, CASE WHEN n_nationkey % 9 IN (0, 2) THEN 2 ELSE 1 END AS n FROM nation WHERE n_nationkey % 9 < 7),
 s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)"""


@query(f"WITH {RECORDS} SELECT file AS name, CAST(i AS INT) AS idx, CAST(before + i AS BIGINT) AS pos FROM s, range(2) t(i) WHERE i < n")
def json_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1/2, SET-2, NRM-11: every file of a folder is a document; records are numbered over all files."""
    records, _ = documents.read_json_documents(spark, nation_files(spark, sf_dir), "*.txt")
    found = documents.positions(cut(records))
    return found.select(F.regexp_extract("file", "file=([^/]*)/", 1).alias("name"), F.col("_index").cast("int").alias("idx"), F.col("_pos").cast("long").alias("pos"))


@query(f"WITH {RECORDS} SELECT count(*) || ' fichiers JSON' AS label, 'some files are invalid and were skipped' AS warning FROM s")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3, SRC-11, DQ-5."""
    records, bad = documents.read_json_documents(spark, nation_files(spark, sf_dir), "*.txt")
    return documents.provenance(records).select("label", F.lit(documents.import_warning(records, bad)).alias("warning"))


@query("""WITH o AS (SELECT *, CAST(o_custkey % 97 AS VARCHAR) AS file, row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderkey) - 1 AS i FROM orders), f AS (SELECT file, count(*) AS n FROM o WHERE CAST(file AS INT) % 9 < 7 GROUP BY file),
 s AS (SELECT file, coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
 SELECT file, CAST(s.before + i AS BIGINT) AS pos, CAST(o_orderkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS reason FROM o JOIN s USING (file)
 UNION ALL SELECT DISTINCT file, CAST(NULL AS BIGINT), NULL, CASE CAST(file AS INT) % 9 WHEN 7 THEN 'not JSON' ELSE 'no known envelope' END FROM o WHERE CAST(file AS INT) % 9 >= 7""")
def folder_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1, SRC-2, SRC-3, SET-2, NRM-11: all orders as files of several lines, two kinds of nine unreadable, numbered over all files."""
    folder, file = new_folder(spark, "orders"), (F.col("o_custkey") % 97).cast("string")
    records = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey"))), lambda x: F.struct(x["o_orderkey"].cast("string").alias("uid")))
    texts = table(spark, sf_dir, "orders").groupBy(file.alias("file")).agg(records.alias("r")).withColumn("kind", F.col("file").cast("int") % 9)
    listed = F.to_json("r", {"pretty": "true"})
    named = lambda *names: F.concat(*(F.lit(f'{{\n  "{n}": ') for n in names), listed, F.lit("}" * len(names)))
    kinds = {0: listed, 1: named("amendments"), 2: named("amendements"), 3: named("amendements", "amendement"), 4: named("amendement"), 7: F.concat(F.lit("["), listed), 8: named("others")}
    body = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in kinds.items()), listed)
    texts.select("file", body.alias("value")).repartition("file").write.partitionBy("file").text(folder)
    found, bad = documents.read_json_documents(spark, folder, "*.txt")  # a folder a file
    own = F.regexp_extract("file", "file=([^/]*)/", 1).alias("file")
    found = documents.positions(cut(found)).select(own, F.col("_pos").cast("long").alias("pos"), F.try_variant_get("raw", "$.uid", "string").alias("id"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(bad.select(own, F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("id"), "reason"))


@query("""SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INT) AS idx, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus || ', "' || o_orderpriority || '" [\\{' AS texte FROM orders""")
def document_of_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1, SRC-2, SNK-1: one document of all orders, written by many tasks and read again by ranges."""
    folder = new_folder(spark, "document")
    status = F.concat("o_orderstatus", F.lit(', "'), "o_orderpriority", F.lit('" [\\{'))
    report.write_json_document(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_pos"), F.col("o_orderkey").cast("string").alias("id"), status.alias("texte")), folder)
    found, _ = large.read_large_documents(spark, folder, "part-*", joined=True)
    return found.select(F.col("_index").alias("idx"), *(F.try_variant_get("raw", f"$.{c}", "string").alias(c) for c in ("id", "texte")))


@query("SELECT CAST(0 AS INT) AS idx, 'U' || n_nationkey AS id, CAST(n_nationkey AS VARCHAR) AS numero FROM nation WHERE n_nationkey = 3")
def single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5: one file."""
    records, _ = documents.read_json_documents(spark, nation_files(spark, sf_dir) + "/file=3", "*.txt")
    return normalize.normalize(records, position="_index").select(F.col("_index").cast("int").alias("idx"), "id", "numero")


@query("SELECT * FROM (VALUES (CAST(0 AS INT), 'a', 'texte collé'), (1, 'amdt-1', 'texte collé')) t(idx, id, file)")
def pasted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4, NRM-10: an inline document, one of whose records has no id."""
    records, _ = documents.inline(spark, '{"amendments": [{"id": "a"}, {"numero": "7"}]}')
    return normalize.normalize(records, position="_index").select(F.col("_index").cast("int").alias("idx"), "id", "file")


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'record' ELSE 'attachment' END AS kind, n_name AS content FROM nation")
def mixed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6: JSON files as single records, other files as texts."""
    folder, nation = new_folder(spark, "mixed"), table(spark, sf_dir, "nation").withColumn("f", F.concat(F.lit("k"), F.col("n_nationkey").cast("string")))
    nation.where("n_nationkey % 2 = 0").select("f", "n_name").repartition("f").write.partitionBy("f").json(folder)
    nation.where("n_nationkey % 2 = 1").select("f", "n_name").repartition("f").write.mode("append").partitionBy("f").text(folder)
    records, others = documents.read_mixed(spark, folder)
    records = records.select(F.lit("record").alias("kind"), F.try_variant_get("raw", "$.n_name", "string").alias("content"))
    return records.unionByName(others.select(F.lit("attachment").alias("kind"), text.strip("value").alias("content")))


@query("""SELECT o_orderkey, 'first' AS snapshot, o_orderstatus AS statut FROM orders UNION ALL SELECT o_orderkey, 'last', CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 3 > 0""")
def session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9, SNK-3, STM-4: a session saved twice, the second time from itself; each snapshot stays as it was."""
    folder = new_folder(spark, "session")
    documents.save_session(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("statut")), folder)
    schema = "o_orderkey long, statut string"
    first = documents.restore_session(spark, folder, schema)
    documents.save_session(first.where("o_orderkey % 3 > 0").withColumn("statut", F.expr("IF(o_orderkey % 2 = 0, 'x', statut)")), folder)
    last = documents.restore_session(spark, folder, schema)
    return first.withColumn("snapshot", F.lit("first")).unionByName(last.withColumn("snapshot", F.lit("last"))).select("o_orderkey", "snapshot", "statut")


@query("SELECT n_nationkey, n_name, CAST(0 AS BIGINT) AS of_none FROM nation")
def session_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9, SNK-3, STM-4: what was saved comes back, and nothing where nothing was saved."""
    folder, nation = new_folder(spark, "session"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    documents.save_session(nation, folder)
    none = documents.restore_session(spark, folder + "-none", nation.schema)
    return documents.restore_session(spark, folder, nation.schema).withColumn("of_none", F.lit(none.count()).cast("long"))


@query(f"SELECT '{hashlib.md5(classify.RULES.encode()).hexdigest()}' AS md5, CAST({len(classify.RULES)} AS INT) AS n_chars")
def rules_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: the rules as a file's text."""
    folder = new_folder(spark, "rules")
    spark.range(1).select(F.lit(classify.RULES).alias("value")).write.text(folder)
    return documents.read_rules(spark, folder).select(text.strip("value").alias("t")).select(F.md5("t").alias("md5"), F.length("t").alias("n_chars"))


#: Six records with each kind of number, suffix and rule, as a sample.
SAMPLE = (
    ("s-1", "28", "185", "Rédiger ainsi cet article :"), ("s-2", "65 octies", "7", "Rédiger ainsi cet article :"), ("s-3", "37", "16", "Rédiger ainsi l'alinéa 58"),
    ("s-4", "11 ter", "184", "Rédiger ainsi les alinéas 2 et 3"), ("s-5", "22 bis", "2", "Supprimer cet article."), ("s-6", "22", "1", "Supprimer les alinéas 31 à 33"),
)


@query("SELECT * FROM (VALUES ('s-4', CAST(1 AS INT), CAST(5 AS INT)), ('s-6', 2, 3), ('s-5', 3, 1), ('s-1', 4, 2), ('s-3', 5, 4), ('s-2', 6, 2)) t(id, rang, priorite)")
def sample_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7: the sample, ranked."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(SAMPLE)], "_pos long, id string, article string, numero string, dispositif string")
    return ranking.presort(rows, "B").select("id", "rang", "priorite")


# Normalisation

SHAPES = 14


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_pos and raw: one record an order, in fourteen shapes."""
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 97).cast("string")
    ks, shape = k.cast("string"), F.col("o_orderkey") % SHAPES
    j = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    uid = F.when(shape == 1, "").otherwise(j('"uid": "U', ks, '", '))
    number = F.when(shape == 11, "null").otherwise(j('{"numeroLong": "', F.when(shape == 2, "  ").otherwise(ks), '", "numeroRect": "Rect."}'))
    signers = (
        F.when(shape == 3, j('{"auteur": {"acteurRef": "PA', c, '"}}')).when(shape == 4, j('{"auteur": [{"acteurRef": "PA', c, '"}, {"acteurRef": "X"}]}'))
        .when(shape == 5, j('"seul ', c, '"')).when(shape == 6, '{"auteur": {}}').when(shape == 7, '{"libelle": {"@xmlns:xsi": "u"}}').otherwise(j('{"libelle": "M. &eacute; ', c, '"}'))
    )
    body = F.when(shape == 9, '{"a": 1, "é": "b"}').otherwise('"<p>Supprimer l&#39;article</p>"')
    body = j(F.when(shape == 8, '"cartoucheInformatif": "Irrecevable", ').otherwise('"cartoucheInformatif": null, '), '"contenuAuteur": {"dispositif": ', body, ', "exposeSommaire": "e ', ks, '"}')
    raw = j("{", uid, '"identification": ', number, ', "pointeurFragmentTexte": {"division": {"titre": "Article ', c, '", "articleDesignation": "ART. ', c, '"}}, "signataires": ', signers, ', "corps": {', body, '}, "cycleDeVie": {"dateDepot": "2024-01-02"}}')
    flat = j('{"article": "', c, '", "numero": "', ks, '", "auteurs": ["A", "B', c, '"], "dispositif": "<b>x</b> ', ks, '", "rapporteur": true, "point_impact": {"type": "article_entier", "alinea": ', (k % 5).cast("string"), "}}")
    value = F.when(shape == 12, flat).when(shape == 13, '"un texte"').when(shape == 10, j('{"amendement": ', raw, "}")).otherwise(raw)
    return table(spark, sf_dir, "orders").select(k.alias("_pos"), F.try_parse_json(value).alias("raw"))


SHAPED = f"o AS (SELECT o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS ks, CAST(o_custkey % 97 AS VARCHAR) AS c, o_orderkey % {SHAPES} AS s FROM orders)"
AUTHOR = "CASE WHEN s IN (11, 13) THEN NULL WHEN s IN (3, 4) THEN 'PA' || c WHEN s = 5 THEN 'seul ' || c WHEN s = 6 THEN 'Inconnu' WHEN s = 7 THEN 'Non renseigné' WHEN s = 12 THEN 'A, B' || c ELSE 'M. é ' || c END"
BODY = "CASE WHEN s IN (11, 13) THEN '' WHEN s = 8 THEN 'Irrecevable' WHEN s = 9 THEN '{\"a\":1,\"é\":\"b\"}' WHEN s = 12 THEN 'x ' || ks ELSE 'Supprimer l''article' END"
EXPOSE = "CASE WHEN s IN (11, 12, 13) THEN NULL ELSE 'e ' || ks END"


@query(f"""WITH {SHAPED} SELECT CASE s WHEN 1 THEN ks WHEN 11 THEN 'amdt-err-' || ks WHEN 12 THEN 'amdt-' || ks WHEN 13 THEN 'amdt-' || ks ELSE 'U' || ks END AS id,
 CASE s WHEN 2 THEN 'Inconnu' WHEN 11 THEN 'Erreur' WHEN 13 THEN 'Inconnu' ELSE ks END AS numero, CASE WHEN s IN (11, 13) THEN '' WHEN s = 12 THEN c ELSE 'Article ' || c END AS article,
 CASE WHEN s IN (11, 12, 13) THEN NULL ELSE 'Rect.' END AS rectification, CASE WHEN s IN (11, 12, 13) THEN NULL ELSE '2024-01-02' END AS date_depot, {AUTHOR} AS auteur,
 CASE WHEN s IN (11, 13) THEN '' WHEN s = 12 THEN 'A|B' || c ELSE {AUTHOR} END AS auteurs, s = 12 AS rapporteur, {BODY} AS dispositif, {EXPOSE} AS expose,
 CASE WHEN s IN (11, 13) THEN NULL WHEN s = 12 THEN 'article_entier' ELSE 'ART. ' || c END AS impact, CASE WHEN s = 12 THEN CAST(pos % 5 AS INT) END AS alinea, CASE s WHEN 11 THEN 'error' WHEN 13 THEN 'not an object' END AS trouble FROM o""")
def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-1 to 10: every shape of a raw record, a flat one, a wrapped one, a broken one and one that is no object."""
    flat = normalize.normalize(raw_records(spark, sf_dir), tags=True)
    return flat.select("id", "numero", "article", "rectification", "date_depot", "auteur", F.array_join("auteurs", "|").alias("auteurs"), "rapporteur", "dispositif", F.col("expose_sommaire").alias("expose"), F.col("point_impact.type").alias("impact"), F.col("point_impact.alinea").alias("alinea"), F.col("_norm_error").alias("trouble"))


@query(f"WITH {SHAPED} SELECT pos, left(coalesce({AUTHOR}, ''), 100) AS auteur_court, 'Dispositif: ' || {BODY} || chr(10) || 'Exposé: ' || coalesce({EXPOSE}, '') AS texte_brut FROM o")
def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-12: the short plain text of a record."""
    return normalize.raw_text(normalize.normalize(raw_records(spark, sf_dir))).select(F.col("_pos").alias("pos"), "auteur_court", "texte_brut")


# Displays and exports


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and auteurs: the names of an order's parts, of which there are few, in order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("p_name")).alias("auteurs"))


@query("""WITH a AS (SELECT l_orderkey AS k, string_agg(p_name, ', ' ORDER BY p_name) AS noms FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
 SELECT o_orderkey, coalesce(noms, '—') AS auteurs FROM orders LEFT JOIN a ON k = o_orderkey""")
def authors_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4, ARR-1, NRM-16: the joined names of all orders."""
    rows = table(spark, sf_dir, "orders").join(part_names(spark, sf_dir), "o_orderkey", "left")
    return rows.select("o_orderkey", report.joined_authors().alias("auteurs"))


@query("""WITH a AS (SELECT l_orderkey AS k, string_agg(p_name, ', ' ORDER BY p_name) AS noms FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
 SELECT o_orderkey AS numero, CAST(CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 5 END ELSE o_orderkey % 1000 END AS INT) AS rang, CASE WHEN o_orderstatus = 'P' THEN 'Rapporteur' ELSE coalesce(noms, '—') END AS auteurs,
 CASE WHEN o_orderkey % 2 = 0 THEN 'article_entier' ELSE '—' END AS point_impact, CASE WHEN o_orderkey % 3 = 0 THEN '—' ELSE 'Identique' END AS statut,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'g' || (o_orderkey % 4) END AS groupe, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'j' END AS justification FROM orders LEFT JOIN a ON k = o_orderkey""")
def display_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-16/17, AGG-4, ARR-1: the columns of the table, with the names of an order's parts as authors."""
    names, k = part_names(spark, sf_dir), F.col("o_orderkey")
    result = F.when(k % 3 != 0, F.struct(F.lit(5).alias("rang"), F.lit("Identique").alias("statut"), F.struct(F.concat(F.lit("g"), (k % 4).cast("string")).alias("groupe_id")).alias("groupe"), F.lit("j").alias("justification")))
    rows = table(spark, sf_dir, "orders").join(names, "o_orderkey", "left").select(
        k.alias("numero"), F.when(k % 7 != 0, k % 1000).cast("int").alias("rang"), F.lit("1").alias("article"), F.coalesce("auteurs", F.array().cast("array<string>")).alias("auteurs"), (F.col("o_orderstatus") == "P").alias("rapporteur"),
        F.struct(F.when(k % 2 == 0, "article_entier").alias("type")).alias("point_impact"), result.alias("resultat_ia"),
    )
    return report.display(rows, rapporteur=True).drop("article")


ESCAPED = "array_to_string(list_transform(string_split({x}, ''), lambda x: CASE WHEN x IN ('\\', '{{', '}}') THEN '\\' || x WHEN unicode(x) < 128 THEN x ELSE '\\u' || unicode(x) || '?' END), '')"


@query(rf"""WITH {RANKED}, k AS (SELECT *, count(*) OVER (PARTITION BY {norm("article")}, {norm("dispositif")}) >= 2 AS g, {norm("article")} || '|' || {norm("dispositif")} AS gk FROM r),
 c AS (SELECT *, CASE WHEN rang > 1 AND (CASE WHEN g THEN gk END) IS NOT DISTINCT FROM lag(CASE WHEN g THEN gk END) OVER (ORDER BY rang) THEN 0 ELSE 1 END AS ch, lag(article) OVER (ORDER BY rang) AS pa FROM k),
 i AS (SELECT *, sum(ch) OVER (ORDER BY rang) AS isl FROM c), s AS (SELECT *, count(*) OVER (PARTITION BY isl) AS span, row_number() OVER (PARTITION BY isl ORDER BY rang) AS place FROM i),
 b AS (SELECT rang, article, pa, g, span, place, 'Adt n° ' || numero || ' de ' || auteur AS content FROM s),
 l AS (SELECT 1 AS block, rang AS position, CASE WHEN rang = 1 THEN '' ELSE '\par' || chr(10) END || '\pard\f0\fs24\b ' || {ESCAPED.format(x="'ARTICLE ' || article")} || '\b0\par' AS line, 0 AS o FROM b WHERE pa IS NULL OR pa <> article
  UNION ALL SELECT 1, rang, '\pard\f0\fs22\tx851\tx1321\tx1985 \tab \tab \tab ' || CASE WHEN g AND place = 1 THEN 'Id.' ELSE '' END || '\tab ' || CASE WHEN NOT g THEN '' WHEN place = 1 THEN '\' || 'u9555? ' WHEN place = span THEN '\' || 'u9561? ' ELSE '\' || 'u9553? ' END || '\tab ' || {ESCAPED.format(x="content")} || '\par', 1 FROM b
  UNION ALL SELECT 2, 0, '}}', 0
  UNION ALL SELECT 0, 0, x, n FROM (VALUES ('{{\rtf1\ansi\ansicpg1252\deff0', 0), ('{{\fonttbl{{\f0\froman\fcharset0 Times New Roman;}}}}', 1), ('\paperw11907\paperh16840\margl1843\margr1418\margt850\margb567', 2), ('\pard\qc\f0\fs24\b Version provisoire du pr\u233?-jaune\b0\par', 3),
   ('\pard\qc\f0\fs18\i G\u233?n\u233?r\u233? le ' || strftime(current_date, '%d/%m/%Y') || ' \' || 'u8212? Dc. = discussion commune, Id. = identiques\i0\par\par', 4), ('\pard\f0\fs24\b\ul LOI \{{1\}}\b0\ul0\par\par', 5)) t(x, n))
 SELECT CAST(block AS INT) AS block, CAST(position AS BIGINT) AS position, line FROM l""")
def rtf_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, WIN-3 to 5 and 7, STR-7 to 10, DAT-2: every line of the document."""
    rows = cut(groups.identiques(ranking.presort(amendments(spark, sf_dir), "B")))
    rows = rows.withColumns({"rectification": F.lit(None).cast("string"), "texte_examine": F.struct(F.lit("LOI {1}").alias("titre"))})
    return report.rtf_lines(rows, "rang").select("block", "position", "line")


@query("""SELECT 'amendements-classes-' || strftime(current_date, '%Y-%m-%d') || '.json' AS name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS at, n_nationkey AS id, n_name AS nom FROM nation""")
def json_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, JSN-5, DAT-1: the export of a batch, read again."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_pos"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("nom"))
    rows = report.json_document(nation).select("name", F.posexplode(F.from_json("document", "amendements array<struct<id: int, nom: string>>")["amendements"]).alias("at", "r"))
    return rows.select("name", "at", "r.id", "r.nom")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'Identique' ELSE 'Isolé' END AS statut, CAST(quality AS INT) AS rang, CAST(NULL AS VARCHAR) AS groupe_id FROM labels")
def conforming_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4, DQ-3: verdicts in the schema's columns and types; further columns go, missing ones are null."""
    rows = table(spark, sf_dir, "labels").select(F.lit(1).alias("more"), F.col("quality").cast("int").alias("rang"), F.when(F.col("toxic") == 1, "Identique").otherwise("Isolé").alias("statut"), F.col("doc_id").cast("string").alias("id"))
    found = quality.conform(rows, ddl(VERDICT_DDL))
    assert found.columns == ddl(VERDICT_DDL).names
    return found.select("id", "statut", "rang", F.col("groupe.groupe_id").alias("groupe_id"))


@query("SELECT * FROM (VALUES ('all', CAST(25 AS BIGINT), CAST(NULL AS VARCHAR)), ('none', 0, 'the batch has no records')) t(batch, n, trouble)")
def batch_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-2, DQ-6: an empty batch is refused, and gives empty results elsewhere."""
    nation, out = table(spark, sf_dir, "nation"), []
    for name, rows in (("all", nation), ("none", nation.where("n_nationkey < 0"))):
        try:
            out.append((name, quality.require_rows(rows).count(), None))
        except ValueError as e:
            out.append((name, ranking.moved(rows, 0, 1, "n_nationkey").count(), str(e)))
    return spark.createDataFrame(out, "batch string, n long, trouble string")


# Counts, groups and ranks


@query("""WITH t AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END AS id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 3 = 0)
 SELECT 'missing' AS kind, doc_id AS id FROM documents ANTI JOIN t ON id = doc_id UNION ALL SELECT DISTINCT 'unknown', id FROM t ANTI JOIN documents ON doc_id = id UNION ALL SELECT 'repeated', id FROM t GROUP BY id HAVING count(*) > 1""")
def reconciled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-5, DQ-4/5: every id that is missing, unknown or repeated."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    returned = labels.select(F.when(F.col("id") % 5 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id")).unionByName(labels.where("id % 3 = 0"))
    return merge.troubles(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), returned)


@query(f"""WITH {RANKED}, k AS (SELECT count(*) OVER (PARTITION BY {norm("article")}, {norm("dispositif")}) >= 2 AS s, pos FROM r) SELECT count(*) FILTER (s) AS n_sautes, bool_or(pos % 7 = 0) AS any_result FROM k""")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3, FLT-6."""
    rows = groups.identiques(ranking.presort(amendments(spark, sf_dir), "B")).withColumn("resultat_ia", F.when(F.col("_pos") % 7 == 0, F.struct(F.lit("x").alias("statut"))))
    return report.flag_counts(rows)


@query(f"""WITH {AMENDMENTS}, k AS (SELECT id, count(*) OVER (PARTITION BY {norm("article")}, {norm("dispositif")}) AS n, row_number() OVER (PARTITION BY {norm("article")}, {norm("dispositif")}, auteur ORDER BY CAST(numero AS BIGINT)) AS c,
 count(*) OVER (PARTITION BY {norm("article")}, {norm("dispositif")}, auteur) AS own FROM am) SELECT id FROM k WHERE n > 1 AND (c > 1 OR own = n)""")
def doublons_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7: the rows whose group is a doublon."""
    rows = doctrine.same_text(amendments(spark, sf_dir)).withColumn("groupe", F.struct(F.col("genre").alias("type")))
    return groups.of_type(rows, "doublon").select("id")


@query(f"""WITH s AS (SELECT d.doc_id, {STATUS} AS statut FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
 SELECT doc_id, CASE WHEN statut IN ('Identique', 'Identiques') THEN 'grp-identiques-llm' WHEN statut IN ('Incompatible', 'Discussion commune') THEN 'grp-discussion_commune-1' END AS groupe_id,
 CASE WHEN doc_id % 4 = 0 THEN 'rouge' WHEN statut = 'Identique' THEN 'orange' ELSE 'vert' END AS couleur FROM s""")
def client_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRP-6, RUL-4."""
    given = F.when(F.col("doc_id") % 4 == 0, "rouge").when(F.col("doc_id") % 4 == 1, "")
    return statuses(spark, sf_dir).select("doc_id", groups.client_group(F.col("statut"))["groupe_id"].alias("groupe_id"), rules.client_colour(given, "statut").alias("couleur"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey % 3 <> 0, o_orderkey) AS INT) AS rang FROM orders")
def running_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2: rows settled before come first, the others are counted on from there."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("_pos"), (F.col("o_custkey") % 3 == 0).alias("saute_modele"))
    return ranking.running_rank(rows).select("o_orderkey", "rang")


@query(f"""WITH {AMENDMENTS}, p AS (SELECT *, {prio("dispositif")} AS p FROM am), k AS (SELECT article, CASE WHEN p = 1 THEN NULL ELSE alinea END AS alinea, CASE p WHEN 1 THEN 'article' WHEN 3 THEN 'alinea' ELSE 'redaction' END AS kind FROM p WHERE p IN (1, 3, 4))
 SELECT article, alinea, kind, count(*) AS causes FROM k GROUP BY ALL""")
def fall_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-9: the classes of causes over all amendments."""
    return doctrine.fall_classes(ranking.with_priority(amendments(spark, sf_dir)))


@query(f"""WITH {AMENDMENTS}, p AS (SELECT *, {prio("dispositif")} AS p FROM am)
 SELECT id, CAST(sum(CASE WHEN p = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY article) - CASE WHEN p = 1 THEN 1 ELSE 0 END AS BIGINT) AS by_article,
 CAST(sum(CASE WHEN p = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY article, alinea) - CASE WHEN p = 3 THEN 1 ELSE 0 END AS BIGINT) AS by_alinea, CAST(CASE WHEN p = 5 THEN sum(CASE WHEN p = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY article, alinea) ELSE 0 END AS BIGINT) AS by_redaction FROM p""")
def fallen_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-9: by how many causes each amendment falls, without pairs."""
    return doctrine.fallen_members(ranking.with_priority(amendments(spark, sf_dir)))


@query("SELECT o_orderkey, o_orderkey % 4 < 2 AS additionnel FROM orders")
def additional_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-8: which articles are additional ones."""
    article = F.element_at(F.array(*map(F.lit, ("12 bis (nouveau)", "Après l'article 3", "12 bis", "7"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", doctrine.is_additional(article).alias("additionnel"))


# Classification


@query("""WITH f AS (SELECT event_id, user_id, event_id % 3 <> 0 AS failed FROM events), t AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS trips FROM f)
 SELECT event_id, coalesce(bool_or(trips) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS interrupted FROM t""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-8: what comes after two failures in a row is not asked."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3 != 0).alias("failed"))
    return classify.interrupted(rows, "failed", "event_id", ["user_id"]).select("event_id", "interrupted")


@query("""SELECT o_orderkey, CASE WHEN bool_or(o_orderkey % 50 = 0) OVER (PARTITION BY o_custkey) THEN 'Erreur' ELSE 'Isolé' END AS statut, CASE WHEN bool_or(o_orderkey % 50 = 0) OVER (PARTITION BY o_custkey) THEN 'rouge' ELSE 'vert' END AS couleur FROM orders""")
def batch_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM-9: a failure marks its whole batch."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 50 == 0).alias("failed"), F.lit("Isolé").alias("statut"), F.lit("vert").alias("alerte_couleur"))
    return classify.batch_fallback(rows, "failed", "o_custkey").select("o_orderkey", "statut", F.col("alerte_couleur").alias("couleur"))


@query(f"""WITH s AS (SELECT d.doc_id, {STATUS} AS statut FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
 SELECT 'down' AS probe, doc_id, coalesce(statut, 'Erreur') AS statut, CASE WHEN statut IS NULL THEN 'Modèle injoignable.' END AS justification FROM s UNION ALL SELECT 'up', doc_id, NULL, NULL FROM s WHERE statut IS NULL""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM-7: if the probe fails, what is left to ask gets Erreur; else it is asked."""
    rows = statuses(spark, sf_dir).withColumns({"justification": F.lit(None).cast("string"), "alerte_couleur": F.lit("vert")})
    columns = lambda df, name: df.select(F.lit(name).alias("probe"), "doc_id", "statut", "justification")
    asked, settled = classify.preflight(rows, lambda: False)
    return columns(settled, "down").unionByName(columns(asked, "down")).unionByName(columns(classify.preflight(rows, lambda: True)[0], "up"))


@query(f"""WITH {RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY rang) AS own FROM r),
 b AS (SELECT article, CAST((own - 1) // 50 AS INT) AS batch, rang, '{{"rang":' || rang || ',"id":"' || id || '","article":"' || article || '","numero":"' || numero || '","texte":"' || dispositif || '"}}' AS x FROM o)
 SELECT article, batch, count(*) AS n, md5('[' || string_agg(x, ',' ORDER BY rang) || ']') AS prompt_md5 FROM b GROUP BY article, batch""")
def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM-3, LLM-12: an article's records as JSON, fifty a prompt."""
    rows = ranking.presort(amendments(spark, sf_dir), "B").withColumn("texte", F.col("dispositif"))
    return classify.batch_prompts(rows, ["article"]).select("article", "batch", "n", F.md5("prompt").alias("prompt_md5"))


@query("""SELECT event_id, i AS at, 'e' || event_id || '-' || i AS id, CAST(i + 1 AS INT) AS rang, CASE WHEN i = 0 THEN 'Identique' ELSE 'Isolé' END AS statut FROM events, (VALUES (CAST(0 AS INT)), (1)) t(i) WHERE event_id % 4 <> 3
 UNION ALL SELECT event_id, -1, NULL, NULL, 'Erreur' FROM events WHERE event_id % 4 = 3""")
def batch_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM-3: replies of a whole batch as lists, in a fence, or in an object; an unreadable one gives Erreur."""
    k = F.col("event_id").cast("string")
    entry = lambda i, s: F.concat(F.lit('{"id": "e'), k, F.lit(f'-{i}", "rang": {i + 1}, "statut": "{s}"}}'))
    both = F.concat(F.lit("["), entry(0, "Identique"), F.lit(", "), entry(1, "Isolé"), F.lit("]"))
    shape = F.col("event_id") % 4
    reply = F.when(shape == 0, both).when(shape == 1, F.concat(F.lit("```json\n"), both, F.lit("\n```"))).when(shape == 2, F.concat(F.lit('{"classements": '), both, F.lit("}"))).otherwise("désolé")
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode_outer(replies.batch_verdicts(reply)).alias("at", "v"))
    return rows.select("event_id", F.coalesce("at", F.lit(-1)).alias("at"), "v.id", "v.rang", F.coalesce("v.statut", F.lit("Erreur")).alias("statut"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 2 THEN substr(b, 1) WHEN 3 THEN '{"justification": "sans"}' WHEN 4 THEN '' ELSE b END AS object FROM (SELECT event_id, '{"statut": "' || (['Identique', 'Discussion commune', 'Isolé'])[CAST(event_id % 3 + 1 AS INT)] || '", "justification": "j' || event_id || '"}' AS b FROM events)""")
def object_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-2: from the first brace to the last."""
    return table(spark, sf_dir, "events").select("event_id", replies.object_slice(reply_of(F.col("event_id"))).alias("object"))


def second_time(body: str) -> str:
    """A model that answers in prose until it is corrected, and refuses every fifth record."""
    asked = json.loads(body)["messages"]
    number = int(asked[1]["content"].split()[-1])
    if number % 5 == 0:
        return '{"error": "hors_sujet"}'
    return '{"statut": "Identique", "justification": "corrigé"}' if len(asked) == 3 else "Je pense que c'est identique."


@query("""SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'Erreur' ELSE 'Identique' END AS statut, CASE WHEN n_nationkey % 5 = 0 THEN 'Hors sujet.' ELSE 'corrigé' END AS justification,
 CASE WHEN n_nationkey % 5 = 0 THEN 'Erreur' ELSE 'Erreur' END AS sans_reprise FROM nation""")
def corrective_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM-3, LLM-4: a reply without JSON is asked for again; one that is off topic is an error."""
    prompts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("numéro "), F.col("n_nationkey").cast("string")).alias("prompt"))
    found = lambda retries: classify.verdicts(classify.call(prompts, second_time, classify.Options(retries=retries), key="k"), key="k")
    return found(1).select("k", "statut", "justification").join(found(0).select("k", F.col("statut").alias("sans_reprise")), "k")


@query(f"""SELECT p_partkey, md5('{{"model":"m","temperature":0.6,"max_tokens":16384,"messages":[{{"role":"system","content":"s"}},{{"role":"user","content":"' || p_name || '"}}]}}') AS body_md5,
 CASE WHEN p_size % 2 = 0 THEN 'local' ELSE 'cloud' END AS target, CASE WHEN p_size % 2 = 0 THEN 'http://h' ELSE '' END AS address FROM part""")
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM-2, LLM-5: the body of a call, and where it goes."""
    route = classify.route(F.when(F.col("p_size") % 2 == 0, "local").otherwise("groq"), F.lit("http://h/v1/"))
    body = classify.request(F.col("p_name"), classify.Options(system_prompt="s", model="m", mode="deep"))
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(body).alias("body_md5"), route["target"].alias("target"), route["address"].alias("address"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'network' WHEN 1 THEN 'auth' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'http' ELSE 'none' END AS kind FROM events")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM-11."""
    status = F.element_at(F.array(F.lit(None).cast("int"), F.lit(401), F.lit(429), F.lit(503), F.lit(200)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", classify.error_kind_of(status).alias("kind"))


@query(f"WITH {RANKED} SELECT id, CAST((rang - 1) % 4 AS INT) AS lane, CAST((rang - 1) // 4 AS DOUBLE) * 3 AS start_s FROM r")
def call_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM-6, LLM-8: four calls at a time, three seconds between the starts of a lane."""
    return classify.schedule(ranking.presort(amendments(spark, sf_dir), "B"), "rang").select("id", "lane", "start_s")


@query(f"""WITH {AMENDMENTS}, p AS (SELECT id, article, alinea, pos, {norm("dispositif")} AS t FROM am), f AS (SELECT article, alinea, arg_min(t, pos) AS rt, min(pos) AS ref FROM p GROUP BY article, alinea)
 SELECT id, CASE WHEN t = rt THEN 'Identique' WHEN list_slice(string_split(t, ' '), 1, 3) = list_slice(string_split(rt, ' '), 1, 3) THEN 'Discussion commune' ELSE 'Isolé' END AS statut FROM p JOIN f USING (article, alinea) WHERE pos > ref""")
def substantive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-10: what rules can't tell goes to the classifier, here the stub: each amendment of an alinéa against its first."""
    rows = amendments(spark, sf_dir).select("id", "_pos", "article", "alinea", F.array_join("auteurs", ", ").alias("auteur"), text.norm_text("dispositif").alias("texte"))
    pairs = merge.with_reference(rows, ["article", "alinea"], ["auteur", "texte", "_pos"], "_pos").where("_pos > ref__pos")
    return classify.classify_pairs(pairs, key="id").select("id", "statut")


@query(f"""WITH {AMENDMENTS}, t AS (SELECT id, article, CAST(regexp_extract(numero, '([0-9]+)$', 1) AS BIGINT) AS k FROM am), r AS (SELECT id, article, CAST(k % 47 * 3 AS INT) AS a, CAST(k % 47 * 3 + k % 3 AS INT) AS b FROM t WHERE k % 5 > 0),
 o AS (SELECT x.id, count(y.id) AS n FROM r x LEFT JOIN r y ON x.article = y.article AND x.id <> y.id AND x.a <= y.b AND y.a <= x.b GROUP BY x.id),
 i AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY article ORDER BY a, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
 c AS (SELECT *, sum(new) OVER (PARTITION BY article ORDER BY a, id) AS chain FROM i), g AS (SELECT article, chain, min(a) AS f, max(b) AS l, count(*) AS m FROM c GROUP BY article, chain)
 SELECT t.id, r.a AS first, r.b AS last, coalesce(o.n, 0) AS overlaps, CASE WHEN m > 1 THEN 'discussion-commune-art' || replace(t.article, ' ', '') || '-al' || f || CASE WHEN l > f THEN '-' || l ELSE '' END END AS groupe_id
 FROM t LEFT JOIN r ON r.id = t.id LEFT JOIN o ON o.id = t.id LEFT JOIN c ON c.id = t.id LEFT JOIN g ON g.article = c.article AND g.chain = c.chain""")
def impact_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-4, RUL-1: ranges of alinéas that a text names, and the discussions of an article whose ranges meet."""
    k = F.col("_pos")
    a = (k % 47 * 3).cast("string")
    body = F.when(k % 5 == 0, "Supprimer cet article").when(k % 3 == 0, F.concat(F.lit("Rédiger ainsi l'alinéa "), a)).when(k % 3 == 1, F.concat(F.lit("Supprimer les alinéas "), a, F.lit(" et "), (k % 47 * 3 + 1).cast("string"))).otherwise(F.concat(F.lit("Supprimer les alinéas "), a, F.lit(" à "), (k % 47 * 3 + 2).cast("string"), F.lit(" de l'article 9")))
    rows = amendments(spark, sf_dir).withColumn("impact", doctrine.impact_range(body))
    return doctrine.range_discussions(rows).select("id", "impact.first", "impact.last", "overlaps", "groupe_id")


@query(f"""WITH RECURSIVE {RANKED.replace("WITH ", "")}, n AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY rang) AS k FROM r),
 s AS (SELECT article, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS cause, CAST(NULL AS VARCHAR) AS kind, CAST([] AS STRUCT(r INT, al INT, kind VARCHAR, cause VARCHAR)[]) AS seen FROM (SELECT DISTINCT article FROM n)
  UNION ALL SELECT article, k, id, hit.cause, hit.kind, CASE WHEN hit IS NULL AND p IN (1, 3, 4) THEN list_append(seen, struct_pack(r := rang, al := alinea, kind := (['article', '', 'alinea', 'redaction'])[p], cause := id)) ELSE seen END
  FROM (SELECT n.article, n.k, n.id, n.p, n.rang, n.alinea, s.seen, list_sort(list_filter(s.seen, lambda x: x.kind = 'article' OR x.al = n.alinea AND (x.kind = 'alinea' OR n.p = 5)))[1] AS hit FROM s JOIN n ON n.article = s.article AND n.k = s.k + 1))
 SELECT id, cause, kind FROM s WHERE cause IS NOT NULL""")
def falls_by_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-9: what falls when amendments are voted in order, where what has fallen makes nothing fall."""
    return doctrine.falls_in_order(ranking.presort(amendments(spark, sf_dir), "B"))


# Streaming


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.doc_id % 5 = 0 THEN 'Doublon' WHEN toxic = 1 THEN 'Identique' ELSE 'Isolé' END AS statut,
 CAST(CASE WHEN l.doc_id % 5 = 0 THEN 3 WHEN l.doc_id IS NOT NULL THEN 2 END AS BIGINT) AS seq FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-1, STM-3: verdict files are merged as they come, in two runs on one output, the second with a checkpoint of its
    own; of the verdicts on an id the largest seq counts, whenever it comes."""
    folder = new_folder(spark, "verdicts")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "Identique").otherwise("Isolé").alias("statut"))
    fifth = labels.where("id % 5 = 0").withColumns({"statut": F.lit("Doublon"), "seq": F.lit(3)})
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    fifth.write.json(f"{folder}/in")
    labels.withColumn("seq", F.lit(2)).write.mode("append").json(f"{folder}/in")
    progress.follow_verdicts(spark, records, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    labels.withColumns({"statut": F.lit("Erreur"), "seq": F.lit(1)}).write.json(f"{folder}/late")
    progress.follow_verdicts(spark, None, f"{folder}/late", f"{folder}/out", f"{folder}/checkpoint-late").awaitTermination()
    return progress.latest_records(spark, f"{folder}/out").select(F.col("id").cast("long").alias("doc_id"), F.col("resultat_ia.statut").alias("statut"), "seq")
