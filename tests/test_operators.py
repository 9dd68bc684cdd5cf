import random
from collections import Counter

from pyspark.sql import functions as F

from greffe.operators import classify, doctrine, groups, merge, quality, ranking, report

SAMPLE = [
    ("amdt-185", "28", "185", None, "Rédiger ainsi cet article :", ["A", "B"], False),
    ("amdt-7rect", "65 octies", "7", "Rect.", "Rédiger ainsi cet article :", ["C"], False),
    ("amdt-16", "37", "16", None, "Rédiger ainsi l'alinéa 58", [], False),
    ("amdt-184rect", "11 ter", "184", "Rect.", "Rédiger ainsi les alinéas 2 et 3", ["D"], True),
    ("amdt-2", "22 bis", "2", None, "Supprimer cet article.", ["E"], False),
    ("amdt-1", "22", "1", None, "Supprimer les alinéas 31 à 33", ["F"], False),
]
DDL = "_pos long, id string, article string, numero string, rectification string, dispositif string, auteurs array<string>, rapporteur boolean"


def sample(spark, rows=SAMPLE):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DDL)


def order(df):
    return [r.id for r in df.orderBy("rang").collect()]


def test_engines(spark):
    b = ranking.presort(sample(spark), "B")
    assert order(b) == ["amdt-184rect", "amdt-1", "amdt-2", "amdt-185", "amdt-16", "amdt-7rect"]
    assert {r.id: r.priorite for r in b.collect()} == {"amdt-185": 2, "amdt-7rect": 2, "amdt-16": 4, "amdt-184rect": 5, "amdt-2": 1, "amdt-1": 3}
    assert order(ranking.presort(sample(spark), "A")) == ["amdt-1", "amdt-16", "amdt-184rect", "amdt-185", "amdt-2", "amdt-7rect"]
    legal = ranking.presort(sample(spark).withColumn("alinea", F.lit(None).cast("int")), "doctrine")
    assert order(legal) == order(b)
    assert groups.identiques(b).where("saute_modele").isEmpty()


def test_rank_is_a_permutation_and_ties_keep_input_order(spark):
    rng = random.Random(3)
    rows = [(f"a{i}", str(rng.randrange(3)), str(rng.randrange(2000)), None, rng.choice(["Supprimer cet article", "x"]), [], False) for i in range(300)]
    ranked = ranking.presort(sample(spark, rows), "B").orderBy("rang").collect()
    assert [r.rang for r in ranked] == list(range(1, 301))
    expected = sorted(range(300), key=lambda i: (int(rows[i][1]), 1 if rows[i][4] != "x" else 5, int(rows[i][2]), i))
    assert [r.id for r in ranked] == [f"a{i}" for i in expected]


def test_groups(spark):
    rows = [("a", "1", "1", None, "Même  texte", ["X"], False), ("b", "1", "2", None, "même texte ", ["Y"], True), ("c", "2", "3", None, "même texte", ["X"], False), ("d", "1", "4", None, "", [], False), ("e", "1", "5", None, "", [], False), ("f", "2", "6", None, "z", ["X"], False), ("g", "2", "7", None, "Z", ["X"], False)]
    found = {r.id: r for r in groups.identiques(ranking.presort(sample(spark, rows), "B")).collect()}
    assert {i: r.groupe.groupe_id for i, r in found.items() if r.groupe} == {"a": "grp-identiques-1", "b": "grp-identiques-1", "f": "grp-identiques-2", "g": "grp-identiques-2"}
    genre = {r.id: (r.genre, r.place) for r in doctrine.order_of_identiques(doctrine.same_text(sample(spark, rows))).collect()}
    assert (genre["a"], genre["b"]) == (("identiques", 2), ("identiques", 1))
    assert (genre["f"][0], genre["g"][0], genre["c"][0], genre["d"][0]) == ("doublon", "doublon", None, None)


def test_decorations_and_headers(spark):
    runs = [None, ("identiques", "id1"), ("identiques", "id1"), ("identiques", "id1"), None, ("discussion_commune", "dc1"), ("discussion_commune", "dc1"), ("identiques", "id1"), ("doublon", "d1")]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(runs)], "_pos long, groupe struct<type: string, groupe_id: string>")
    rows = groups.decorated(df).orderBy("_pos").collect()
    assert [r.glyph for r in rows] == ["", "╓", "║", "╙", "", "╓", "╙", "╓", ""]
    assert [r.label for r in rows] == ["", "Id.", "", "", "", "Dc.", "", "Id.", ""]
    ranked = ranking.presort(sample(spark), "B")
    headers = groups.with_headers(ranked, "rang").orderBy("rang").collect()
    assert [r.header for r in headers] == ["ARTICLE 11 ter", "ARTICLE 22", "ARTICLE 22 bis", "ARTICLE 28", "ARTICLE 37", "ARTICLE 65 octies"]


def test_rtf_document(spark):
    df = ranking.presort(sample(spark), "B").withColumn("_pos", F.col("rang")).withColumns({"groupe": F.expr("cast(null as struct<type: string, groupe_id: string>)"), "texte_examine": F.struct(F.lit("LOI {1}").alias("titre"))})
    document = report.rtf_document(df, date=F.lit("01/02/2026")).first().document
    lines = document.split("\n")
    assert lines[0] == r"{\rtf1\ansi\ansicpg1252\deff0" and lines[-1] == "}" and document.count("{") - document.count(r"\{") == document.count("}") - document.count(r"\}")
    assert lines[4].startswith(r"\pard\qc\f0\fs18\i G\u233?n\u233?r\u233? le 01/02/2026")
    assert lines[5] == r"\pard\f0\fs24\b\ul LOI \{1\}\b0\ul0\par\par"
    assert [x for x in lines if "ARTICLE" in x] == [rf"\pard\f0\fs24\b ARTICLE {a}\b0\par" for a in ("11 ter", "22", "22 bis", "28", "37", "65 octies")]
    assert r"\pard\f0\fs22\tx851\tx1321\tx1985 \tab \tab \tab \tab \tab Adt n\u176? 16 de la commission\par" in lines
    assert lines.count(r"\par") == 5


def test_a_written_document_is_the_document(spark, tmp_path):
    """The lines that write_rtf() writes, with runs and headers across ranges of positions, against a plain walk."""
    rng = random.Random(5)
    rows = [(i, f"a{i}", str(1 + i // 700), str(i), None, "x", ["A"], False) for i in range(2500)]
    kinds = []
    while len(kinds) < len(rows):
        kinds += [rng.choice([None, "g1", "g2"])] * rng.choice([1, 2, 3, 1500])
    df = spark.createDataFrame([(*r, ("identiques", k) if k else None) for r, k in zip(rows, kinds)], DDL + ", groupe struct<type: string, groupe_id: string>")
    decorated = {r._pos: (r.label, r.glyph) for r in groups.decorated(df).collect()}
    for i, k in enumerate(kinds[: len(rows)]):
        before, after = i and kinds[i - 1], kinds[i + 1] if i + 1 < len(rows) else None
        expected = ("", "") if not k else ("Id.", "╓") if before != k else ("", "╙" if after != k else "║")
        assert decorated[i] == expected, i
    report.write_rtf(df, str(tmp_path / "rtf"), date=F.lit("01/02/2026"))
    written = [r.value for r in spark.read.text(str(tmp_path / "rtf")).collect()]
    assert "\n".join(written) == report.rtf_document(df, date=F.lit("01/02/2026")).first().document
    assert sum("ARTICLE" in x for x in written) == 4


def test_long_numbers_sort_as_numbers(spark):
    from greffe.functions import text

    numbers = [7, 10**19, 10**20 - 1, 10**20, 3 * 10**25, 10**25 + 1, 10**25, 42]
    df = spark.createDataFrame([(str(n),) for n in numbers], "n string")
    assert [int(r.n) for r in df.orderBy(text.natural_key("n")).collect()] == sorted(numbers)
    ranked = ranking.ranked(df, [text.natural_key("n")])
    assert [int(r.n) for r in ranked.orderBy("rang").collect()] == sorted(numbers)


def test_corrective_retries_and_budget(spark):
    import time

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "id long, prompt string").coalesce(1)

    def late(body):
        import json

        return '{"statut": "Identique"}' if len(json.loads(body)["messages"]) == 3 else "non"

    begun = time.time()
    rows = classify.call(prompts, late, classify.Options(retries=2, pause_s=0.2)).collect()
    assert {r.reply for r in rows} == {'{"statut": "Identique"}'} and time.time() - begun >= 1.0
    assert {r.reply for r in classify.call(prompts, late).collect()} == {"non"}


def test_merges(spark):
    records = sample(spark).select("id", "numero", "_pos")
    verdicts = spark.createDataFrame([("amdt-1", "Isolé", 1), ("amdt-1", "Identique", 2), ("zz", "Isolé", 3)], "id string, statut string, seq int")
    out = merge.merge_verdicts(records, verdicts)
    assert out.count() == 6 and {r.id: r.resultat_ia.statut for r in out.collect() if r.resultat_ia} == {"amdt-1": "Identique"}
    kinds = {r.kind: (r.n, r.ids) for r in merge.warnings(records, verdicts).collect()}
    assert kinds == {"missing": (5, "amdt-16, amdt-184rect, amdt-185, amdt-2, amdt-7rect"), "unknown": (1, "zz"), "repeated": (1, "amdt-1")}
    twice = records.unionByName(records.withColumn("_pos", F.col("_pos") + 10))
    partial = spark.createDataFrame([("amdt-2", ("Isolé",))], "id string, resultat_ia struct<statut: string>")
    hit = merge.upsert_first(twice, partial).where("resultat_ia is not null").collect()
    assert [(r.id, r._pos) for r in hit] == [("amdt-2", 4)]
    pairs = merge.first_against_rest(records, ["id"])
    assert pairs.count() == 5 and {r.ref_id for r in pairs.collect()} == {"amdt-185"}


def test_warnings_list_every_id(spark):
    asked, returned = spark.range(2500).selectExpr("cast(id as string) id"), spark.range(2400, 5000).selectExpr("cast(id as string) id")
    rows = merge.warnings(asked, returned).collect()
    listed = {k: [x for r in rows if r.kind == k for x in r.ids.split(", ")] for k in ("missing", "unknown")}
    assert sorted(listed["missing"]) == sorted(str(i) for i in range(2400)) and {r.n for r in rows if r.kind == "missing"} == {2400}
    assert sorted(listed["unknown"]) == sorted(str(i) for i in range(2500, 5000)) and not [r for r in rows if r.kind == "repeated"]


def test_moves_are_undone(spark):
    df = spark.range(12).select(F.col("id").alias("x"), F.col("id").alias("_pos"))
    for a, b in ((2, 9), (9, 2), (0, 11), (5, 5)):
        there = ranking.moved(df, a, b)
        values = list(range(12))
        values.insert(b, values.pop(a))
        assert [r.x for r in there.orderBy("_pos").collect()] == values
        assert [r.x for r in ranking.moved(there, b, a).orderBy("_pos").collect()] == list(range(12))
    assert [r.x for r in ranking.without_id(df, 3, "x").orderBy("x").limit(4).collect()] == [0, 1, 2, 4]


def test_doctrine(spark):
    rows = [("s", "1", 1, None), ("r", "1", 4, 2), ("a", "1", 5, 2), ("b", "1", 3, 3), ("c", "1", 5, 3), ("d", "2", 4, 2), ("e", "2", 5, 2)]
    df = spark.createDataFrame(rows, "id string, article string, priorite int, alinea int")
    pairs = {(r.cause, r.fallen) for r in doctrine.fallen_pairs(df).collect()}
    assert pairs == {("s", "r"), ("s", "a"), ("s", "b"), ("s", "c"), ("r", "a"), ("b", "c"), ("d", "e")}
    assert {(r.cause, r.fallen) for r in doctrine.mechanical_falls(df).collect()} == {("s", 4), ("r", 1), ("b", 1), ("d", 1)}


def test_quality(spark):
    df = spark.createDataFrame([("a", "1", "", "x", ("article_entier",)), (None, "1", "2", "x", ("autre",))], "id string, article string, numero string, dispositif string, point_impact struct<type: string>")
    assert [r._violations for r in quality.checked(df).orderBy("numero").collect()] == [["missing:numero"], ["missing:id", "enum:point_impact.type"]]


def test_classifier_errors_stay_with_their_rows(spark):
    pairs = spark.createDataFrame([(i, "a", "t" if i % 2 else "u", "b", "t") for i in range(8)], "id long, auteur string, texte string, ref_auteur string, ref_texte string").coalesce(1)
    good = {r.id: r.statut for r in classify.classify_pairs(pairs).collect()}
    assert good == {i: "Identique" if i % 2 else "Isolé" for i in range(8)}

    def failing(prompt):
        raise classify.ClassifierError("rate_limit", "429")

    rows = classify.classify_pairs(pairs, failing).collect()
    assert {r.statut for r in rows} == {"Erreur"} and sum(r.limite for r in rows) == 2 and sum(r.justification == "interrupted" for r in rows) == 6
    assert [classify.error_kind(x) for x in (None, 401, 429, 500, 200)] == ["network", "auth", "rate_limit", "http", "none"]
    assert classify.healthy(lambda: 1 / 0) is False


def test_counts_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "Identique"), (1, "b", "Erreur IA"), (2, "c", None)], "_pos long, id string, statut string")
    assert tuple(report.status_counts(df).first()) == (3, 2, 0, 1, 0, 1)
    document = report.json_document(df).first().document
    import json

    assert json.loads(document)["amendements"][0] == {"id": "a", "statut": "Identique"}
    report.write_json(df, str(tmp_path / "j"))
    assert [json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ["a", "b", "c"]


def test_a_group_with_its_reference_is_no_single_task(spark):
    """Most rows may share a key, as documents share a language."""
    rows = spark.range(4_000).selectExpr("id as _pos", "if(id < 3990, 'fr', null) as lang", "concat('t', id) as texte").union(spark.createDataFrame([(None, "de", "x")], "_pos long, lang string, texte string"))
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        found = merge.with_reference(rows, ["lang"], ["texte"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r._pos, r.texte, r.ref_texte) for r in found if r.lang == "fr") == sorted((i, f"t{i}", "t0") for i in range(3_990))
    assert [(r._pos, r.ref_texte) for r in found if r.lang != "fr"] == [(None, None)]
    assert max(Counter(r.task for r in found).values()) < 3_000
