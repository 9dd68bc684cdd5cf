"""Queries of the numbered operators, with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, hardneg, licences, mixing, neardup, neighbours, pieces, repeats, semantic, shards, toxicity, urls


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_log_structured_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))[1]


def op4_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"])


def op5_spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read(spark, sf_dir, "documents"), 16)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the listed rules decide teaches the mined ones, which judge the other pages."""
    return urls.judge(read(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op11_heavy_light_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(pieces.encode(read(spark, sf_dir, "documents"), path), path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
REACH = """e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT id AS node, id AS comp FROM n UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node)"""
#: CRC-32 byte by byte, with a table made from its polynomial.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))),
  lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"""
FITS = "(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')"
RULES = sorted(((kind, *text.partition("/")) for kind, text in urls.LISTED), key=lambda r: -len("".join(r[1:])))
PICKED = "CASE " + " ".join(f"WHEN {FITS.format(own=own, rest=rest)} THEN '{{{{{n}}}}}'" for n, (_, own, _, rest) in enumerate(RULES)) + " END"
LISTED_RULE = PICKED.format().format(*(own + "/" + rest for _, own, _, rest in RULES))
LISTED_VERDICT = PICKED.format().format(*(kind for kind, *_ in RULES))
SQL = {
    "op8_url_rules": rf"""WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 r AS (SELECT *, string_split(host, '.') AS h, {LISTED_RULE} AS rule, {LISTED_VERDICT} AS listed FROM u),
 t AS (SELECT page_id, host, path, rule, listed, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_concat(['tld:' || h[-1], 'first:' || h[1]], CASE WHEN len(h) >= 2 THEN ['site:' || h[-2] || '.' || h[-1]] ELSE [] END,
   CASE WHEN len(h) > 3 THEN list_transform(h[2:len(h) - 2], lambda x: 'label:' || x) ELSE [] END, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '#', 'g')),
   list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'key:' || string_split(x, '=')[1]), CASE WHEN ends_with(path, '/') THEN ['end:/'] ELSE [] END, CASE WHEN contains(url, '#') THEN ['fragment'] ELSE [] END))) END AS tokens FROM r),
 l AS (SELECT tokens, listed AS label FROM t WHERE listed IS NOT NULL AND len(tokens) > 0), k AS (SELECT count(*) AS n FROM l), d AS (SELECT tokens, count(*) AS n FROM l GROUP BY tokens), e AS (SELECT tokens, n, unnest(tokens) AS token FROM d),
 st AS (SELECT token, sum(n) AS freq, list_sort(list(tokens)) AS places FROM e GROUP BY token HAVING sum(n) >= 0.01 * (SELECT n FROM k)), nm AS (SELECT token, freq, min(token) OVER (PARTITION BY places) AS item FROM st),
 b AS (SELECT tokens, list(item ORDER BY freq DESC, item)[1:{urls.MOST_ITEMS}] AS items FROM (SELECT DISTINCT tokens, item, freq FROM e JOIN nm USING (token)) GROUP BY tokens),
 i AS (SELECT tokens, unnest(items) AS item FROM b),
 c AS (SELECT tokens, [item] AS ante FROM i UNION ALL SELECT x.tokens, [x.item, y.item] FROM i x JOIN i y ON x.tokens = y.tokens AND x.item < y.item UNION ALL SELECT x.tokens, [x.item, y.item, z.item] FROM i x JOIN i y ON x.tokens = y.tokens AND x.item < y.item JOIN i z ON x.tokens = z.tokens AND y.item < z.item),
 j AS (SELECT ante, label, count(*) AS hits FROM c JOIN l USING (tokens) GROUP BY ante, label), w AS (SELECT ante, sum(hits) AS whole FROM j GROUP BY ante), lb AS (SELECT label, count(*) AS n FROM l GROUP BY label),
 m AS (SELECT ante, label, hits / whole AS conf, hits / (SELECT n FROM k) AS supp FROM j JOIN w USING (ante) JOIN lb USING (label) WHERE hits >= ceil(0.01 * (SELECT n FROM k)) AND hits / whole >= 0.8 AND (hits / whole) / (lb.n / (SELECT n FROM k)) >= 1.2),
 o AS (SELECT DISTINCT tokens FROM t WHERE listed IS NULL),
 p AS (SELECT tokens, array_to_string(ante, ' ') AS mined_rule, label AS mined FROM o JOIN m ON list_has_all(tokens, ante) QUALIFY row_number() OVER (PARTITION BY tokens ORDER BY conf DESC, supp DESC, len(ante) DESC, array_to_string(ante, ' '), label) = 1)
 SELECT page_id, host, path, rule, coalesce(listed, mined, 'allow') AS verdict, CASE WHEN listed IS NULL THEN mined_rule END AS mined_rule FROM t LEFT JOIN p ON p.tokens = t.tokens""",
    "op7_jump_sharding": f"""WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), k AS (SELECT DISTINCT doc_id, CAST(CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:16] AS UBIGINT) AS HUGEINT) AS key FROM documents),
 j AS (SELECT doc_id, key, -1 AS b, CAST(0 AS BIGINT) AS ahead FROM k UNION ALL
  SELECT doc_id, next, ahead, CAST(floor((ahead + 1) * (CAST(2147483648 AS DOUBLE) / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT) FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM j WHERE ahead < 17)),
 s AS (SELECT doc_id, max(b) FILTER (b < 16) AS shard, max(b) FILTER (b < 17) AS grown FROM j GROUP BY doc_id),
 r AS (SELECT doc_id, strlen(x) + 1 AS size, CAST({CRC.format(text="x")} AS BIGINT) AS text_crc32, CAST(shard AS INT) AS shard, CAST(grown AS INT) AS grown_shard FROM d JOIN s USING (doc_id), t)
 SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', doc_id, text_crc32, size))[1:15], doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM r""",
    "op11_heavy_light_divergence": r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 t AS (SELECT id, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
 c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term), v AS (SELECT lang, count(*) AS v, sum(n) AS size FROM k GROUP BY lang), s AS (SELECT DISTINCT lang, source FROM d),
 g AS (SELECT s.lang, s.source, coalesce(sum(n), 0) AS size FROM s LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY s.lang, s.source),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.size + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.size + 5 * v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
 SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50""",
    "op12_radix_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(256 * x) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[]) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op2_log_structured_repeats": f"""WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM w, unnest(range(1, len(w) - 11)) t(i)), f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
 gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM g JOIN f USING (g), unnest(range(0, 13)) t(k) WHERE first < doc_id),
 o AS (SELECT doc_id, pos, w[pos] AS word FROM w, unnest(range(1, len(w) + 1)) t(pos)),
 k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM o ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op5_spherical_kmeans": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id AS id FROM v),
 u AS (SELECT vec_id, v FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95), {REACH},
 d AS (SELECT a, count(*) AS k FROM e GROUP BY a), c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
 SELECT id AS vec_id, coalesce(k, 0) AS n_links, comp AS component_id, id = comp AS kept FROM n JOIN c ON node = id LEFT JOIN d ON d.a = id""",
    "op10_chosen_path": f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
 n AS (SELECT doc_id AS id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS "both" FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * "both" >= 85 * (na.n + nb.n - "both")), {REACH}, c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
 SELECT id AS doc_id, n AS n_shingles, comp AS component_id, id = comp AS kept FROM n JOIN c ON node = id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
