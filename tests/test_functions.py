import pytest
from pyspark.sql import functions as F

from greffe.functions import replies, rules, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "priority"),
    [
        ("Supprimer cet article.", 1), ("  SUPPRIMER L'ARTICLE 3", 1), ("Rédiger ainsi cet article :", 2), ("Rédiger ainsi l'article 2", 2), ("Supprimer les alinéas 31 à 33", 3), ("À l'article, supprimer l'alinéa 4", 3),
        ("Rédiger ainsi l'alinéa 58", 4), ("Rédiger ainsi cet alinéa", 4), ("Rédiger ainsi les alinéas 2 et 3", 5), ("Supprimer  cet article", 5), ("Supprimer l’alinéa 2", 5), ("<p>Supprimer cet article</p>", 5),
        ("Rédiger ainsi cet article : supprimer l'alinéa 2", 2), ("", 5), (None, 5), (" Supprimer cet article", 1),
    ],
)
def test_cascade(spark, given, priority):
    assert one(spark, given, rules.rule_cascade).priority == priority


def test_natural_and_legal_order(spark):
    numbers = ["1", "2", "7", "16", "184", "185"]
    df = spark.createDataFrame([(x,) for x in reversed(numbers)], "x string")
    assert [r.x for r in df.orderBy(text.natural_key("x")).collect()] == numbers
    articles = ["1er", "2", "5 A", "5", "5 bis", "10", "22", "22 bis", "22 ter", "22 quater", "23", "sans numéro"]
    df = spark.createDataFrame([(x,) for x in reversed(articles)], "x string")
    assert [r.x for r in df.orderBy(text.legal_key("x")).collect()] == articles
    assert [r.x for r in df.where("x like '22%'").orderBy(text.natural_key("x")).collect()] == ["22", "22 bis", "22 quater", "22 ter"]


def test_texts(spark):
    assert one(spark, "  A \n b﻿ ", text.norm_text) == "a b"
    assert one(spark, None, text.norm_text) == ""
    assert one(spark, "x " * 60, text.excerpt) == ("x " * 60)[:90] + "…"
    assert one(spark, "  ", text.excerpt) == "—"
    assert one(spark, "a{é╓\\", text.rtf_escape) == "a\\{\\u233?\\u9555?\\\\"
    assert one(spark, "￦😀", text.rtf_escape) == "\\u-26?\\u-10179?\\u-8704?"
    assert one(spark, "12 bis (nouveau)", text.section_header) == "APRÈS L'ARTICLE 12"
    assert one(spark, "22 bis", text.section_header) == "ARTICLE 22 bis"
    assert one(spark, "a" * 201 + "\n\nb", text.line_estimate) == 5
    assert one(spark, "<p>l&#39;&eacute;t&eacute; &amp;lt;</p>", lambda x: text.unescape_html(text.strip_tags(x))) == "l'été &lt;"
    assert one(spark, "http://h/V1/", text.trim_base_url) == "http://h"
    assert tuple(one(spark, "<think>a", text.thought_and_answer)) == ("a", "")


def test_replies(spark):
    cases = {
        '{"statut": "Identique", "justification": "j"}': ("Identique", "j", "orange"), '```json\n{"statut": "Doublon"}\n```': ("Doublon", "", "rouge"), 'Voici {"statut": "Isolé"} fin': ("Isolé", "", "vert"),
        '[{"statut": "Incompatible"}, 3]': ("Incompatible", "", "orange"), '{"justification": "x"}': ("Nouveau", "x", "vert"), '{"statut": "tron': ("Erreur", "Erreur de formatage du modèle.", "vert"), "[]": ("Erreur", "Erreur de formatage du modèle.", "vert"),
        "12": ("Erreur", "Erreur de formatage du modèle.", "vert"), "": ("Erreur", "Erreur de formatage du modèle.", "vert"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", replies.verdict("x").alias("v"))
    assert {r.x: tuple(r.v) for r in df.collect()} == cases
    assert one(spark, 'a {"b": {"c": 1}} d', replies.object_slice) == '{"b": {"c": 1}}'


def test_lookups(spark):
    badges = {"Isolé": "gray", "Discussion commune": "purple", "Identiques": "blue", "Erreur IA": "red", "—": "red", None: "red", "autre": "gray"}
    for given, colour in badges.items():
        assert one(spark, given, rules.badge) == colour
    assert one(spark, "article_entier", rules.impact_label) == "Article entier"
    assert one(spark, "inconnu", rules.group_label) == "inconnu"
    assert one(spark, "Identiques", rules.status_group) == "identiques"
    assert one(spark, "HTTP 429 Too Many", rules.is_rate_limit) is True
    assert one(spark, "Identique", lambda x: rules.client_colour(F.lit(""), x)) == "orange"
