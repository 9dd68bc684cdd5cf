"""Queries over the driver's tables, one or more an operator, each beside its SQL.

The tables hold no amendments, so `orders` is read as amendments: see amendments() and AMENDMENTS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import replies, rules, text
from ..operators import asking, classify, doctrine, groups, merge, quality, ranking, report
from ..sources import documents, normalize
from .lineage import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    suffix = F.element_at(F.array(*map(F.lit, ("", " bis", " ter", " quater"))), (key % 4 + 1).cast("int"))
    al = (cust % 9).cast("string")
    body = (
        F.when(key % 6 == 0, "Supprimer  cet article.").when(key % 6 == 1, "Rédiger ainsi cet article :").when(key % 6 == 2, F.concat(F.lit("Supprimer l'alinéa "), al))
        .when(key % 6 == 3, F.concat(F.lit("Rédiger ainsi l'alinéa "), al)).when(key % 6 == 4, "SUPPRIMER CET ARTICLE").otherwise(F.concat(F.lit("Substituer au mot le nombre "), (key % 100).cast("string")))
    )
    return orders.select(
        key.alias("_pos"), F.concat(F.lit("amdt-"), key.cast("string")).alias("id"), key.cast("string").alias("numero"), F.concat((cust % 40).cast("string"), suffix).alias("article"), body.alias("dispositif"),
        (cust % 9).cast("int").alias("alinea"), F.array(F.concat(F.lit("A"), (cust % 7).cast("string"))).alias("auteurs"), (F.col("o_orderstatus") == "P").alias("rapporteur"),
    )


AMENDMENTS = """am AS (SELECT o_orderkey AS pos, 'amdt-' || o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS numero,
 CAST(o_custkey % 40 AS VARCHAR) || (['', ' bis', ' ter', ' quater'])[CAST(o_orderkey % 4 + 1 AS INT)] AS article,
 CASE o_orderkey % 6 WHEN 0 THEN 'Supprimer  cet article.' WHEN 1 THEN 'Rédiger ainsi cet article :' WHEN 2 THEN 'Supprimer l''alinéa ' || (o_custkey % 9)
 WHEN 3 THEN 'Rédiger ainsi l''alinéa ' || (o_custkey % 9) WHEN 4 THEN 'SUPPRIMER CET ARTICLE' ELSE 'Substituer au mot le nombre ' || (o_orderkey % 100) END AS dispositif,
 CAST(o_custkey % 9 AS INT) AS alinea, 'A' || (o_custkey % 7) AS auteur, o_orderstatus = 'P' AS rapporteur FROM orders)"""


def nat(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '([0-9]+|[^0-9]+)', 1), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0') ELSE x END), '')"


def norm(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), '[\\s\\x0b\\x{{0085}}\\pZ\\x{{FEFF}}]+', ' ', 'g')))"


def prio(c: str) -> str:
    t = f"lower(trim({c}))"
    return (
        f"CASE WHEN starts_with({t}, 'supprimer cet article') OR starts_with({t}, 'supprimer l''article') THEN 1 WHEN starts_with({t}, 'rédiger ainsi cet article') OR starts_with({t}, 'rédiger ainsi l''article') THEN 2"
        f" WHEN contains({t}, 'supprimer l''alinéa') OR contains({t}, 'supprimer les alinéas') THEN 3 WHEN contains({t}, 'rédiger ainsi l''alinéa') OR contains({t}, 'rédiger ainsi cet alinéa') THEN 4 ELSE 5 END"
    )


ACTION = "(['article_suppression', 'article_redaction', 'alinea_suppression', 'alinea_redaction', 'restreint'])[p]"
RANKED = f"""{AMENDMENTS}, p AS (SELECT *, {prio("dispositif")} AS p, {nat("article")} AS na, {nat("numero")} AS nn FROM am),
 r AS (SELECT *, CAST(row_number() OVER (ORDER BY na, p, nn, pos) AS INT) AS rang FROM p)"""


@query(f"""WITH {RANKED}, k AS (SELECT *, {norm("article")} AS ka, {norm("dispositif")} AS kd FROM r),
 g AS (SELECT ka, kd, row_number() OVER (ORDER BY min(rang)) AS no FROM k GROUP BY ka, kd HAVING count(*) >= 2)
 SELECT id, article, numero, p AS priorite, {ACTION} AS action, rang, 'grp-identiques-' || no AS groupe_id, no IS NOT NULL AS saute_modele FROM k LEFT JOIN g USING (ka, kd)""")
def presort_identiques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-1, SRT-2/3, WIN-1, GRP-1 to 4."""
    found = groups.identiques(ranking.presort(amendments(spark, sf_dir), "B"))
    return found.select("id", "article", "numero", "priorite", "action", "rang", F.col("groupe.groupe_id").alias("groupe_id"), "saute_modele")


@query(f"WITH {AMENDMENTS}, p AS (SELECT id, {prio('dispositif')} AS p FROM am) SELECT id, p AS priorite, {ACTION} AS action FROM p")
def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-1/2, FLT-5."""
    return amendments(spark, sf_dir).select("id", rules.rule_cascade("dispositif").alias("r")).select("id", F.col("r.priority").alias("priorite"), "r.action")


@query(f"WITH p AS (SELECT page_id, {prio('coalesce(html, chr(32))')} AS p, contains(lower(html), 'the') AS has_the FROM pages) SELECT page_id, p AS priorite, has_the FROM p")
def rule_cascade_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-1 and FLT-5 over long texts."""
    return table(spark, sf_dir, "pages").select("page_id", rules.rule_cascade("html")["priority"].alias("priorite"), F.lower("html").contains("the").alias("has_the"))


@query(f"WITH {AMENDMENTS} SELECT id, CAST(row_number() OVER (ORDER BY {prio('dispositif')}, numero, pos) AS INT) AS rang FROM am")
def sort_engine_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-1: numero by code point."""
    return ranking.presort(amendments(spark, sf_dir).withColumn("texte", F.col("dispositif")), "A").select("id", "rang")


@query(f"WITH b AS (SELECT DISTINCT p_brand FROM part) SELECT p_brand, CAST(row_number() OVER (ORDER BY {nat('p_brand')}) AS INT) AS rang FROM b")
def natural_sort_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-3."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return ranking.ranked(brands, [text.natural_key("p_brand")])


SUFFIX = "coalesce(list_position(['bis', 'ter', 'quater', 'quinquies', 'sexies', 'septies', 'octies', 'nonies', 'decies'], regexp_extract({c}, '(bis|ter|quater)', 1)), 0)"
LEGAL = f"CAST(regexp_extract(article, '([0-9]+)', 1) AS INT), {SUFFIX.format(c='article')}"


@query(f"WITH {AMENDMENTS}, a AS (SELECT DISTINCT article FROM am) SELECT article, CAST(row_number() OVER (ORDER BY {LEGAL}) AS INT) AS rang FROM a")
def legal_article_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-1."""
    articles = amendments(spark, sf_dir).select("article").distinct()
    return ranking.ranked(articles, [text.legal_key("article"), F.col("article")])


@query(f"WITH {AMENDMENTS} SELECT id, CAST(row_number() OVER (ORDER BY {LEGAL}, alinea, {prio('dispositif')}, rapporteur DESC, {nat('numero')}, pos) AS INT) AS rang FROM am")
def sort_doctrine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-1 to 3 and 7: the legal order."""
    return ranking.presort(amendments(spark, sf_dir), "doctrine").select("id", "rang")


@query(f"""WITH k AS (SELECT doc_id, md5({norm("text")}) AS k, {norm("text")} <> '' AS ok FROM documents)
 SELECT md5(k) AS key_hash, count(*) AS members, min(doc_id) AS first_doc FROM k WHERE ok GROUP BY k HAVING count(*) >= 2""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRP-1/2, STR-1, FLT-4. Long keys are grouped by their digest."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", text.norm_text("text").alias("t")).where("t <> ''").select("doc_id", F.md5("t").alias("k"))
    return keyed.groupBy("k").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_doc")).where("members >= 2").select(F.md5("k").alias("key_hash"), "members", "first_doc")


@query(f"""WITH k AS (SELECT doc_id, md5({norm("text")}) AS k FROM documents WHERE {norm("text")} <> ''), g AS (SELECT k, row_number() OVER (ORDER BY min(doc_id)) AS no FROM k GROUP BY k HAVING count(*) >= 2)
 SELECT doc_id, CAST(no AS INT) AS groupe_no FROM k JOIN g USING (k)""")
def group_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRP-3/4."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", text.norm_text("text").alias("t")).where("t <> ''").select("doc_id", F.md5("t").alias("k"))
    return groups.numbered_groups(keyed, ["k"], "doc_id").where("groupe_no is not null").select("doc_id", "groupe_no")


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 i AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c),
 s AS (SELECT *, count(*) OVER (PARTITION BY conv_id, island) AS span, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) AS place FROM i)
 SELECT conv_id, turn, role, CAST(island AS INT) AS island, CAST(span AS INT) AS span, CAST(place AS INT) AS place, CASE WHEN place = 1 THEN '╓' WHEN place = span THEN '╙' ELSE '║' END AS glyph FROM s""")
def islands_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-3/4."""
    rows = groups.islands(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "role", "turn", ["conv_id"])
    return rows.withColumn("glyph", groups.bracket(F.col("place"), F.col("span"), F.lit(True)))


KIND = "CASE WHEN role = 'user' THEN 'identiques' WHEN role = 'assistant' THEN 'discussion_commune' END"


@query(f"""WITH c AS (SELECT conv_id, turn, {KIND} AS kind FROM conversations),
 b AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 i AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM b),
 s AS (SELECT *, count(*) OVER (PARTITION BY conv_id, island) AS span, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) AS place FROM i)
 SELECT conv_id, turn, CASE WHEN place = 1 AND kind = 'identiques' THEN 'Id.' WHEN place = 1 AND kind = 'discussion_commune' THEN 'Dc.' ELSE '' END AS label,
 CASE WHEN kind IS NULL THEN '' WHEN place = 1 THEN '╓' WHEN place = span THEN '╙' ELSE '║' END AS glyph FROM s""")
def group_decorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-4 with labels, for groups named by role."""
    kind = F.when(F.col("role") == "user", "identiques").when(F.col("role") == "assistant", "discussion_commune")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(kind.alias("type"), F.concat(F.lit("g-"), kind).alias("groupe_id")).alias("groupe"))
    return groups.decorated(rows, "turn", ["conv_id"]).select("conv_id", "turn", "label", "glyph")


@query(f"""WITH {RANKED}, h AS (SELECT id, rang, article, CASE WHEN pos % 5 = 0 THEN 'APRÈS L''ARTICLE ' || regexp_extract(article, '^([0-9]+)', 1) ELSE 'ARTICLE ' || article END AS header FROM r)
 SELECT id, header, header IS DISTINCT FROM lag(header) OVER (PARTITION BY article ORDER BY rang) AS new_section FROM h""")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-5, STR-8, for each article's list."""
    rows = ranking.presort(amendments(spark, sf_dir), "B").withColumn("base", F.col("article"))
    rows = rows.withColumn("article", F.when(F.col("_pos") % 5 == 0, F.concat("article", F.lit(" (nouveau)"))).otherwise(F.col("article")))
    return groups.with_headers(rows, "rang", ["base"]).select("id", "header", "new_section")


@query("""WITH v AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
 SELECT d.doc_id, quality, toxic, CAST(row_number() OVER (ORDER BY quality NULLS LAST, d.doc_id) AS INT) AS final_rank FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id""")
def merge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-1, SRT-4."""
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic", F.lit(0).alias("seq"))
    rows = merge.merge_verdicts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), verdicts)
    rows = rows.select(F.col("id").alias("doc_id"), F.col("resultat_ia.quality").alias("quality"), F.col("resultat_ia.toxic").alias("toxic"))
    return ranking.missing_last(rows, F.col("quality"), "doc_id")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-3, SET-3, AGG-6."""
    return merge.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT CASE WHEN l.doc_id % 2 = 0 THEN l.doc_id ELSE -1 - l.doc_id END AS doc_id FROM labels l WHERE l.doc_id % 2 = 1")
def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-4: labels whose odd ids are made unknown."""
    returned = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(-1 - F.col("doc_id")).alias("doc_id"))
    return merge.unknown(table(spark, sf_dir, "documents"), returned, "doc_id")


@query("SELECT l.doc_id, l.quality, l.toxic FROM labels l SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'fr') d ON l.doc_id = d.doc_id")
def known_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-5, FLT-3."""
    return merge.known_only(table(spark, sf_dir, "documents").where("lang = 'fr'"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("""WITH s AS (SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation), t AS (SELECT CAST(n_nationkey * 2 AS VARCHAR) AS id FROM nation UNION ALL SELECT '4'),
 m AS (SELECT id FROM s ANTI JOIN t USING (id)), u AS (SELECT DISTINCT id FROM t ANTI JOIN s USING (id)), r AS (SELECT id FROM t GROUP BY id HAVING count(*) > 1)
 SELECT 'missing' AS kind, count(*) AS n, string_agg(id, ', ' ORDER BY id) AS ids FROM m UNION ALL SELECT 'unknown', count(*), string_agg(id, ', ' ORDER BY id) FROM u UNION ALL SELECT 'repeated', count(*), string_agg(id, ', ' ORDER BY id) FROM r""")
def reconcile_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-5, AGG-4, DQ-4/5."""
    nation = table(spark, sf_dir, "nation")
    returned = nation.select((F.col("n_nationkey") * 2).cast("string").alias("id")).unionByName(spark.range(1).select(F.lit("4").alias("id")))
    return merge.warnings(nation.select(F.col("n_nationkey").cast("string").alias("id")), returned)


STATUS = "CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 0 AND toxic = 1 THEN 'Erreur' WHEN quality = 0 THEN 'Incompatible' WHEN toxic = 1 THEN 'Identique' WHEN d.doc_id % 3 = 0 THEN 'Discussion commune' ELSE 'Isolé' END"


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    status = F.when(q.isNull(), None).when((q == 0) & (t == 1), "Erreur").when(q == 0, "Incompatible").when(t == 1, "Identique").when(F.col("doc_id") % 3 == 0, "Discussion commune").otherwise("Isolé")
    return joined.select("doc_id", status.alias("statut"))


@query(f"""WITH s AS (SELECT d.doc_id, {STATUS} AS statut FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
 SELECT count(*) AS n_total, count(statut) AS n_classes, count(*) FILTER (statut IN ('Incompatible', 'Discussion commune')) AS n_dc, count(*) FILTER (statut IN ('Identique', 'Identiques')) AS n_id,
 count(*) FILTER (statut IN ('Nouveau', 'Isolé')) AS n_isole, count(*) FILTER (statut IN ('Erreur', 'Erreur IA')) AS n_erreur FROM s""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1 to 3, FLT-6."""
    return report.status_counts(statuses(spark, sf_dir))


@query(f"""WITH s AS (SELECT d.doc_id, {STATUS} AS statut FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
 SELECT doc_id, statut, CASE WHEN statut IN ('Identique', 'Identiques') THEN 'identiques' WHEN statut IN ('Incompatible', 'Discussion commune') THEN 'discussion_commune' END AS groupe_type,
 CASE statut WHEN 'Doublon' THEN 'rouge' WHEN 'Identique' THEN 'orange' WHEN 'Incompatible' THEN 'orange' ELSE 'vert' END AS couleur,
 'grp-' || CASE WHEN statut IN ('Identique', 'Identiques') THEN 'identiques' WHEN statut IN ('Incompatible', 'Discussion commune') THEN 'discussion_commune' END || '-1' AS groupe_id FROM s""")
def status_to_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-3/5, GRP-5/6, MAP-1, JON-8."""
    kind = rules.status_group("statut")
    return statuses(spark, sf_dir).select("doc_id", "statut", kind.alias("groupe_type"), rules.status_colour("statut").alias("couleur"), groups.constant_group(kind)["groupe_id"].alias("groupe_id"))


@query(f"""WITH s AS (SELECT d.doc_id, lower(coalesce({STATUS}, '')) AS s FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
 SELECT doc_id, CASE WHEN contains(s, 'isolé') OR contains(s, 'nouveau') THEN 'gray' WHEN contains(s, 'commune') OR contains(s, 'incompatible') THEN 'purple' WHEN contains(s, 'identique') THEN 'blue' WHEN contains(s, 'erreur') OR s IN ('—', '') THEN 'red' ELSE 'gray' END AS badge FROM s""")
def badge_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-6."""
    return statuses(spark, sf_dir).select("doc_id", rules.badge("statut").alias("badge"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Suppression d’article' WHEN event_id % 4 = 1 THEN 'Identiques' WHEN event_id % 4 = 2 THEN event_type ELSE NULL END AS label,
 CASE event_id % 3 WHEN 0 THEN '🔴' WHEN 1 THEN '🟠' ELSE '🟢' END AS emoji, event_id % 5 = 0 AS limite FROM events""")
def label_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-7 to 9: label dictionaries that pass unknown values through."""
    key = F.col("event_id")
    kind = F.when(key % 4 == 0, "suppression_article").when(key % 4 == 1, "identiques").when(key % 4 == 2, F.col("event_type"))
    colour = F.when(key % 3 == 0, "rouge").when(key % 3 == 1, "orange").otherwise("vert")
    error = F.when(key % 5 == 0, "HTTP 429").otherwise("HTTP 500")
    return table(spark, sf_dir, "events").select("event_id", rules.group_label(rules.impact_label(kind)).alias("label"), rules.colour_emoji(colour).alias("emoji"), rules.is_rate_limit(error).alias("limite"))


@query(f"""WITH {AMENDMENTS}, f AS (SELECT id AS ref_id, dispositif AS ref_dispositif, pos AS first_pos FROM am ORDER BY pos LIMIT 1)
 SELECT id, ref_id, dispositif = ref_dispositif AS same FROM am, f WHERE pos > first_pos""")
def first_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-6, WIN-6, LIM-2."""
    return merge.first_against_rest(amendments(spark, sf_dir), ["id", "dispositif"]).select("id", "ref_id", (F.col("dispositif") == F.col("ref_dispositif")).alias("same"))


@query("SELECT page_id, substr(regexp_replace(html, '<[^>]+>', '', 'g'), 1, 1000) AS body FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-4, LIM-5/6."""
    return table(spark, sf_dir, "pages").select("page_id", text.capped(text.strip_tags("html"), 1000).alias("body"))


FLAT = "trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x{0085}\\pZ\\x{FEFF}]+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN {FLAT} = '' THEN '—' WHEN length({FLAT}) > 90 THEN substr({FLAT}, 1, 90) || '…' ELSE {FLAT} END AS excerpt FROM documents")
def truncate_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-6."""
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt("text").alias("excerpt"))


LINES = "CAST(list_sum(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: greatest(1, CAST(ceil(length(l) / 100.0) AS INT)))) AS INT)"


@query(f"SELECT doc_id, {LINES} AS lines, {LINES} > 20 AS long FROM documents")
def line_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5, MTH-1."""
    return table(spark, sf_dir, "documents").select("doc_id", text.line_estimate("text").alias("lines"), text.is_long("text").alias("long"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.absent'), 'Inconnu') AS absent FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-4/6, NRM-2."""
    props = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(props, "$.k", "string").alias("k"), F.coalesce(F.try_variant_get(props, "$.absent", "string"), F.lit("Inconnu")).alias("absent"))


def reply_of(key: Column) -> Column:
    status = F.when(key % 3 == 0, "Identique").when(key % 3 == 1, "Discussion commune").otherwise("Isolé")
    body = F.concat(F.lit('{"statut": "'), status, F.lit('", "justification": "j'), key.cast("string"), F.lit('"}'))
    return F.when(key % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(key % 5 == 1, F.concat(F.lit("Voici : "), body, F.lit(" fin"))).when(key % 5 == 2, F.concat(F.lit("["), body, F.lit("]"))).when(key % 5 == 3, '{"justification": "sans"}').otherwise('{"statut": tronq')


@query("""SELECT event_id, CASE event_id % 5 WHEN 3 THEN 'Nouveau' WHEN 4 THEN 'Erreur' ELSE (['Identique', 'Discussion commune', 'Isolé'])[CAST(event_id % 3 + 1 AS INT)] END AS statut,
 CASE event_id % 5 WHEN 3 THEN 'sans' WHEN 4 THEN 'Erreur de formatage du modèle.' ELSE 'j' || event_id END AS justification,
 CASE WHEN event_id % 5 < 3 AND event_id % 3 = 0 THEN 'orange' ELSE 'vert' END AS couleur FROM events""")
def json_extract_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-1 to 4, STR-12, LIM-3, RUL-3."""
    v = replies.verdict(reply_of(F.col("event_id")))
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", "v.statut", "v.justification", F.col("v.alerte_couleur").alias("couleur"))


@query(f"""WITH {RANKED}, k AS (SELECT *, count(*) OVER (PARTITION BY {norm("article")}, {norm("dispositif")}) >= 2 AS s FROM r)
 SELECT id, CAST(CASE WHEN s THEN 0 ELSE 1 END AS INT) AS part, CASE WHEN s THEN 'Identique' ELSE 'Isolé' END AS statut FROM k""")
def union_pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1, SET-1/4, NRM-14."""
    found = groups.identiques(ranking.presort(amendments(spark, sf_dir), "B"))
    before, after = found.where("saute_modele"), found.where("not saute_modele")
    return merge.in_sequence(before.withColumn("statut", F.lit("Identique")), after.withColumn("statut", F.lit("Isolé"))).select("id", "part", "statut")


@query("SELECT n_name, CAST(CASE WHEN n_nationkey = 3 THEN 9 WHEN n_nationkey BETWEEN 4 AND 9 THEN n_nationkey - 1 ELSE n_nationkey END AS INT) AS _pos FROM nation")
def reorder_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-6."""
    return ranking.moved(table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("_pos")), 3, 9)


#: Moves of rows of the list of orders: from a position to another, one after the other.
MOVES = [(7 * k % 1500, (k * k + 3) % 1400) for k in range(25)]


@query(f"""WITH RECURSIVE m AS (SELECT unnest(range(1, {len(MOVES)} + 1)) AS k, unnest({[a for a, _ in MOVES]}) AS a, unnest({[b for _, b in MOVES]}) AS b),
 s AS (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS k FROM orders UNION ALL SELECT o_orderkey, CASE WHEN pos = a THEN b WHEN a < b AND pos > a AND pos <= b THEN pos - 1 WHEN b < a AND pos >= b AND pos < a THEN pos + 1 ELSE pos END, m.k FROM s JOIN m ON m.k = s.k + 1)
 SELECT o_orderkey, CAST(pos AS INT) AS pos FROM s WHERE k = {len(MOVES)}""")
def reorder_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-6: a log of moves, folded and applied at once."""
    rows = ranking.ranked(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], "pos").withColumn("pos", F.col("pos") - 1)
    return ranking.moved_many(rows, MOVES, "pos")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IS DISTINCT FROM 7")
def delete_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2."""
    return ranking.without_id(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 7, "n_nationkey")


@query(r"""WITH t AS (SELECT p_partkey, 'Adt n° ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' Rect.' ELSE '' END || ' de ' || CASE WHEN p_partkey % 3 = 0 THEN 'la commission' ELSE p_name || ' {x}\' END AS c FROM part)
 SELECT p_partkey, '\tab \tab \tab ' || CASE WHEN p_partkey % 4 = 0 THEN 'Id.' ELSE '' END || '\tab ' || CASE WHEN p_partkey % 4 = 0 THEN '\' || 'u9555? ' ELSE '' END || '\tab ' ||
 array_to_string(list_transform(string_split(c, ''), lambda x: CASE WHEN x IN ('\', '{', '}') THEN '\' || x WHEN unicode(x) < 128 THEN x ELSE '\u' || unicode(x) || '?' END), '') AS line FROM t""")
def rtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-7/9/10."""
    key = F.col("p_partkey")
    authors = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat("p_name", F.lit(" {x}\\"))))
    content = text.content_line(key.cast("string"), F.when(key % 2 == 0, "Rect."), authors)
    line = text.rtf_line(F.when(key % 4 == 0, "Id."), F.when(key % 4 == 0, "╓"), content)
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@query(f"""WITH {AMENDMENTS}, k AS (SELECT *, {norm("article")} AS ka, {norm("dispositif")} AS kd FROM am),
 g AS (SELECT ka, kd, count(*) AS members, count(DISTINCT auteur) AS author_sets FROM k GROUP BY ka, kd HAVING count(*) > 1),
 w AS (SELECT *, CAST(row_number() OVER (PARTITION BY ka, kd, auteur ORDER BY {nat("numero")}, pos) AS INT) AS copy, CAST(row_number() OVER (PARTITION BY ka, kd ORDER BY rapporteur DESC, {nat("numero")}, pos) AS INT) AS place FROM k)
 SELECT id, members, author_sets, copy, place, CASE WHEN members IS NULL THEN NULL WHEN copy > 1 THEN 'doublon' WHEN author_sets > 1 THEN 'identiques' ELSE 'doublon' END AS genre FROM w LEFT JOIN g USING (ka, kd)""")
def identiques_vs_doublons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-5 to 7."""
    return doctrine.order_of_identiques(doctrine.same_text(amendments(spark, sf_dir))).select("id", "members", "author_sets", "copy", "place", "genre")


@query(f"""WITH {AMENDMENTS}, p AS (SELECT *, {prio("dispositif")} AS p FROM am), g AS (SELECT article, alinea, p FROM p GROUP BY article, alinea, p HAVING count(*) >= 2 AND count(DISTINCT {norm("dispositif")}) >= 2)
 SELECT id, CASE WHEN g.p IS NOT NULL THEN 'discussion-commune-art' || replace(p.article, ' ', '') || '-al' || p.alinea END AS groupe_id FROM p LEFT JOIN g ON g.article = p.article AND g.alinea = p.alinea AND g.p = p.p""")
def discussion_commune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-4, 12."""
    return doctrine.common_discussions(ranking.with_priority(amendments(spark, sf_dir))).select("id", "groupe_id")


@query(f"""WITH {AMENDMENTS}, p AS (SELECT *, {prio("dispositif")} AS p FROM am), a AS (SELECT article, count(*) AS n FROM p GROUP BY article), l AS (SELECT article, alinea, count(*) AS n, count(*) FILTER (p = 5) AS low FROM p GROUP BY article, alinea),
 f AS (SELECT id AS cause, 'article' AS kind, n - 1 AS fallen FROM p JOIN a USING (article) WHERE p = 1 UNION ALL SELECT id, 'alinea', n - 1 FROM p JOIN l USING (article, alinea) WHERE p = 3 UNION ALL SELECT id, 'redaction', low FROM p JOIN l USING (article, alinea) WHERE p = 4)
 SELECT * FROM f WHERE fallen > 0""")
def mechanical_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-9, counted."""
    return doctrine.mechanical_falls(ranking.with_priority(amendments(spark, sf_dir)))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'missing:numero' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'enum:priority' END], lambda x: x IS NOT NULL), ',') AS violations FROM orders""")
def dq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-1."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("numero"), F.col("o_orderpriority").alias("priority"))
    return rows.select("o_orderkey", F.array_join(quality.violations(("numero",), {"priority": ("1-URGENT", "2-HIGH")}), ",").alias("violations"))


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-4."""
    return quality.duplicates(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query(f"WITH {AMENDMENTS} SELECT id, article, numero FROM am WHERE article = '7' ORDER BY pos LIMIT 1")
def top_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-1, JON-7."""
    return ranking.first_with(amendments(spark, sf_dir), F.col("article") == "7").select("id", "article", "numero")


@query(f"""WITH {AMENDMENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY pos) AS rn FROM am) SELECT id, article, CASE WHEN rn = 1 AND article NOT LIKE '%bis' THEN 'Identique' END AS statut FROM k""")
def upsert_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-2, STM-1: a partial verdict goes to the first record of its key."""
    rows = amendments(spark, sf_dir)
    partial = rows.select("article").distinct().where("article not like '%bis'").select(F.col("article").alias("id"), F.struct(F.lit("Identique").alias("statut")).alias("resultat_ia"))
    keyed = rows.select(F.col("article").alias("id"), F.col("id").alias("own"), "numero", "_pos")
    return merge.upsert_first(keyed, partial).select(F.col("own").alias("id"), F.col("id").alias("article"), F.col("resultat_ia.statut").alias("statut"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '/v1//' ELSE '' END, '/+$', ''), '/[vV]1$', '') AS base, 'page' || CASE WHEN page_id > 1 THEN 's' ELSE '' END AS word FROM pages""")
def trim_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11/13/15/16."""
    url = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/v1//").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", text.trim_base_url(url).alias("base"), F.concat(F.lit("page"), text.plural("page_id")).alias("word"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' ELSE event_type END AS thought, CASE WHEN event_id % 3 = 1 THEN '' ELSE 'réponse ' || event_id END AS answer FROM events")
def think_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14."""
    key, kind = F.col("event_id"), F.col("event_type")
    answer = F.concat(F.lit("réponse "), key.cast("string"))
    reply = F.when(key % 3 == 0, F.concat(F.lit("<think>\n"), kind, F.lit("\n</think>\n"), answer)).when(key % 3 == 1, F.concat(F.lit("<think>"), kind)).otherwise(answer)
    return table(spark, sf_dir, "events").select("event_id", text.thought_and_answer(reply).alias("t")).select("event_id", "t.thought", "t.answer")


@query(f"""WITH {RANKED}, l AS (SELECT article, min(rang) AS lead FROM r GROUP BY article) SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN pos % 2 = 0 THEN lead ELSE rang END, rang) AS INT) AS ordre
 FROM (SELECT r.id, r.pos, r.rang, m.lead FROM r LEFT JOIN (SELECT article, min(rang) AS lead FROM r WHERE pos % 2 = 0 GROUP BY article) m ON m.article = r.article)""")
def consecutive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-11: the even rows of an article follow its first."""
    rows = ranking.presort(amendments(spark, sf_dir), "B").withColumn("g", F.when(F.col("_pos") % 2 == 0, F.col("article")))
    ordered = doctrine.consecutive(rows, "g", "rang")
    lead, own = F.col("ordre.lead"), F.col("ordre.own")
    return ranking.ranked(ordered, [lead, own], "place").select("id", F.col("place").alias("ordre"))


@query("""WITH t AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 3 END AS kind, CASE WHEN n_nationkey % 4 = 0 THEN (['commerce', 'travail'])[n_nationkey % 2 + 1] ELSE '' END AS code, CASE WHEN n_nationkey % 4 = 1 THEN 1970 + n_nationkey ELSE 0 END AS year FROM nation)
 SELECT k, CAST(row_number() OVER (ORDER BY kind, code, year, k) AS INT) AS rang FROM t""")
def additional_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-8: code, then law from the oldest, then the rest, then reports."""
    k = F.col("n_nationkey")
    body = F.when(k % 4 == 0, F.when(k % 2 == 0, "Le code du commerce").otherwise("Le code du travail")).when(k % 4 == 1, F.concat(F.lit("La loi n° "), (1970 + k).cast("string"), F.lit("-12"))).when(k % 4 == 2, "Un rapport est remis").otherwise("Sans objet")
    rows = table(spark, sf_dir, "nation").select(k.alias("k"), doctrine.additional_key(body, F.lit("1"), F.lit(1)).alias("key"))
    return ranking.ranked(rows, [F.col("key"), F.col("k")]).select("k", "rang")


@query(f"""WITH {AMENDMENTS}, k AS (SELECT *, {norm("dispositif")} AS kd, {prio("dispositif")} AS p FROM am), t AS (SELECT *, count(*) OVER (PARTITION BY article, kd) AS n, row_number() OVER (PARTITION BY article, kd, auteur ORDER BY pos) AS c FROM k)
 SELECT id, CASE WHEN n > 1 AND c > 1 THEN 'doublon' WHEN n > 1 THEN 'identiques' WHEN p = 3 THEN 'discussion_commune' WHEN article LIKE '% bis' THEN 'additionnel' ELSE 'isole' END AS type FROM t""")
def group_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-13: precedence of group types."""
    rows = ranking.with_priority(amendments(spark, sf_dir)).withColumn("kd", text.norm_text("dispositif"))
    counts = rows.groupBy("article", "kd").agg(F.count("*").alias("n"))
    copy = F.row_number().over(Window.partitionBy("article", "kd", "auteurs").orderBy("_pos"))
    many = F.col("n") > 1
    kind = doctrine.group_type(many & (F.col("c") > 1), many, F.col("priorite") == 3, F.col("article").endswith(" bis"))
    return rows.withColumn("c", copy).join(counts, ["article", "kd"]).select("id", kind.alias("type"))


@query("SELECT n_nationkey AS k, n_name || ' & l''île <é>' AS name FROM nation")
def html_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), text.unescape_html(F.concat("n_name", F.lit(" &amp; l&#39;&icirc;le &lt;&eacute;&gt;"))).alias("name"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a nation, in seven envelopes and two that are none."""
    k = F.col("n_nationkey")
    one = F.concat(F.lit('{"uid": "U'), k.cast("string"), F.lit('", "identification": {"numeroLong": "'), k.cast("string"), F.lit('"}, "corps": {"contenuAuteur": {"dispositif": "<p>Supprimer l&#39;article</p>"}}, "signataires": {"auteur": [{"acteurRef": "PA1"}]}}'))
    wrap = [lambda x: F.concat(F.lit("["), x, F.lit(", 5]")), lambda x: F.concat(F.lit('{"amendments": ['), x, F.lit("]}")), lambda x: F.concat(F.lit('{"amendements": ['), x, F.lit(", "), x, F.lit("]}")), lambda x: F.concat(F.lit('{"amendements": {"amendement": ['), x, F.lit("]}}")), lambda x: F.concat(F.lit('{"amendements": '), x, F.lit("}")), lambda x: F.concat(F.lit('{"amendement": '), x, F.lit("}")), lambda x: x, lambda x: F.lit('{"x": 1}'), lambda x: F.lit("not json")]
    doc = None
    for i, w in enumerate(wrap):
        doc = F.when(k % 9 == i, w(one)) if doc is None else doc.when(k % 9 == i, w(one))
    return table(spark, sf_dir, "nation").select(k.cast("string").alias("file"), doc.alias("value"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS file, CAST(i AS INT) AS _index, CASE WHEN n_nationkey % 9 = 0 AND i = 1 THEN 'amdt-1' ELSE 'U' || n_nationkey END AS id,
 CASE WHEN n_nationkey % 9 = 0 AND i = 1 THEN 'Inconnu' ELSE CAST(n_nationkey AS VARCHAR) END AS numero, CASE WHEN n_nationkey % 9 = 0 AND i = 1 THEN '' ELSE 'Supprimer l''article' END AS dispositif,
 CASE WHEN n_nationkey % 9 = 0 AND i = 1 THEN NULL ELSE 'PA1' END AS auteur
 FROM nation, (VALUES (0), (1)) t(i) WHERE n_nationkey % 9 < 7 AND (i = 0 OR n_nationkey % 9 IN (0, 2))""")
def variant_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1/2/4, NRM-1 to 11, ARR-2: envelopes unwrapped and records flattened."""
    records, _ = documents.unwrap(envelopes(spark, sf_dir))
    return normalize.normalize(records, position="_index", tags=True).select("file", F.col("_index").cast("int").alias("_index"), "id", "numero", "dispositif", "auteur")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, CASE WHEN n_nationkey % 9 = 7 THEN 'no known envelope' ELSE 'not JSON' END AS reason FROM nation WHERE n_nationkey % 9 >= 7")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3."""
    return documents.unwrap(envelopes(spark, sf_dir))[1]


@query("SELECT n_nationkey AS _pos, CAST(to_json({'id': n_nationkey, 'nom': n_name}) AS VARCHAR) AS json FROM nation")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, JSN-5, as lines."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_pos"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("nom"))
    return report.json_lines(nation)


@query(f"""WITH s AS (SELECT d.doc_id, coalesce({STATUS}, 'Erreur') AS statut FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
 SELECT doc_id, CASE WHEN statut IN ('Identique', 'Incompatible') THEN '🟠' ELSE '🟢' END || ' **' || doc_id || '** : ' || statut || chr(10) || '> ' || chr(10) || chr(10) AS markdown FROM s""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5, LLM-10: records without a verdict get Erreur."""
    rows = merge.fill_errors(statuses(spark, sf_dir)).select("doc_id", F.col("doc_id").cast("string").alias("id"), "statut", rules.status_colour("statut").alias("alerte_couleur"), F.lit(None).cast("string").alias("justification"))
    return report.markdown_lines(rows).select("doc_id", "markdown")


@query(f"""WITH d AS (SELECT doc_id, lang, {norm("text")} AS t FROM documents), f AS (SELECT lang, min(doc_id) AS ref FROM d GROUP BY lang), p AS (SELECT d.doc_id, d.t, r.t AS rt FROM d JOIN f USING (lang) JOIN d r ON r.doc_id = f.ref)
 SELECT doc_id, CASE WHEN t = rt AND rt <> '' THEN 'Identique' WHEN rt <> '' AND list_slice(string_split(t, ' '), 1, 3) = list_slice(string_split(rt, ' '), 1, 3) THEN 'Discussion commune' ELSE 'Isolé' END AS statut FROM p""")
def classify_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM-1 to 9 with the deterministic stub: each document against the first of its language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("auteur"), text.norm_text("text").alias("texte"))
    return classify.classify_pairs(merge.with_reference(docs, ["lang"], ["auteur", "texte"], "doc_id"), key="doc_id").select("doc_id", "statut")


@query(SQL["classify_stub"])
def cancelled_and_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-4, STM-3, LLM-6, LLM-8: the same questions, at most four at a time; cancelled after the first slice, then resumed.
    What was answered before is kept, so the rows are the union of both runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("auteur"), text.norm_text("text").alias("texte"))
    asks = classify.pair_prompts(merge.with_reference(docs, ["lang"], ["auteur", "texte"], "doc_id"))
    asks = ranking.ranked(asks, [F.col("doc_id")])
    slices = asking.Asking(spark, new_folder(spark, "asking"), "doc_id").prepare(asks, rows=2_000)
    slices.resume(on_slice=lambda done: slices.cancel())
    slices.resume()
    return classify.verdicts(slices.answers(), "doc_id").select("doc_id", "statut")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
