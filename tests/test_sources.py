import json

from pyspark.sql import functions as F

from greffe.plans.triage import Triage
from greffe.sources import documents, normalize
from greffe.streaming import progress

RAW = {"uid": "U1", "identification": {"numeroLong": "12"}, "pointeurFragmentTexte": {"division": {"titre": "3 bis", "articleDesignation": "ART. 3"}}, "signataires": {"libelle": "M. X"}, "corps": {"cartoucheInformatif": None, "contenuAuteur": {"dispositif": "<p>Supprimer l&#39;article</p>", "exposeSommaire": "e"}}}


def write(folder, **files):
    for name, content in files.items():
        (folder / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))


def test_envelopes(spark, tmp_path):
    a, b = {"id": "a"}, {"id": "b"}
    cases = {"f1": [a, b], "f2": {"amendments": [a, b]}, "f2b": {"amendments": a}, "f3": {"amendements": [a]}, "f4": {"amendements": {"amendement": [a, b]}}, "f4b": {"amendements": {"amendement": a}}, "f5": {"amendements": a}, "f6": {"amendement": [a]}, "f6b": {"amendement": a}, "f7": {"uid": "u"}, "f8": {"x": 1}, "f9": "not json"}
    write(tmp_path, **cases)
    records, bad = documents.read_json_documents(spark, str(tmp_path))
    name = F.regexp_extract("file", "([^/]*)[.]json$", 1)
    counts = {r.n: r["count"] for r in records.groupBy(name.alias("n")).count().collect()}
    assert counts == {"f1": 2, "f2": 2, "f2b": 1, "f3": 1, "f4": 2, "f4b": 1, "f5": 1, "f6": 1, "f6b": 1, "f7": 1}
    assert {r.n: r.reason for r in bad.select(name.alias("n"), "reason").collect()} == {"f8": "no known envelope", "f9": "not JSON"}
    assert sorted(r._pos for r in documents.positions(records).collect()) == list(range(13))
    assert documents.import_warning(records, bad)
    assert documents.provenance(records).first().label == "10 fichiers JSON"


def test_documents_of_several_lines(spark, tmp_path):
    """A file is a document, however many lines it has; so are attachments and rules."""
    (tmp_path / "a.json").write_text(json.dumps([{"id": "a"}, {"id": "b"}], indent=2))
    (tmp_path / "r.md").write_text("one\ntwo\n")
    assert documents.read_json_documents(spark, str(tmp_path))[0].count() == 2
    records, attachments = documents.read_mixed(spark, str(tmp_path))
    assert records.count() == 2 and [r.value for r in attachments.collect()] == ["one\ntwo\n"]
    assert [r.value for r in documents.read_rules(spark, str(tmp_path / "r.md")).collect()] == ["one\ntwo\n"]


def flat(spark, record, tags=False):
    df = spark.createDataFrame([(0, json.dumps(record))], "_pos long, value string").select("_pos", F.try_parse_json("value").alias("raw"))
    return normalize.normalize(df, tags=tags).first()


def test_normalize(spark):
    r = flat(spark, RAW, tags=True)
    assert (r.id, r.numero, r.article, r.auteur, r.auteurs, r.dispositif, r.point_impact.type) == ("U1", "12", "3 bis", "M. X", ["M. X"], "Supprimer l'article", "ART. 3")
    assert flat(spark, {"amendement": RAW}).id == "U1"
    assert flat(spark, RAW | {"uid": None}).id == "12"
    assert flat(spark, RAW | {"signataires": {"auteur": {"acteurRef": "PA1"}}}).auteur == "PA1"
    assert flat(spark, RAW | {"signataires": {"auteur": [{"acteurRef": "PA2"}, {"acteurRef": "PA3"}]}}).auteur == "PA2"
    assert flat(spark, RAW | {"signataires": {"auteur": {}}}).auteur == "Inconnu"
    assert flat(spark, RAW | {"signataires": "seul"}).auteur == "seul"
    assert flat(spark, RAW | {"corps": {"cartoucheInformatif": "Irrecevable", "contenuAuteur": {"dispositif": "x"}}}).dispositif == "Irrecevable"
    assert flat(spark, RAW | {"corps": {"contenuAuteur": {"dispositif": {"@xmlns:xsi": "u"}}}}).dispositif == "Non renseigné"
    assert flat(spark, RAW | {"identification": {"numeroLong": "  "}}).numero == "Inconnu"
    assert (flat(spark, RAW | {"identification": None}).id, flat(spark, RAW | {"identification": None}).numero) == ("amdt-err-0", "Erreur")
    assert (flat(spark, 7).id, flat(spark, 7).numero) == ("amdt-0", "Inconnu")


def test_flat_records_pass_through_and_are_stable(spark):
    own = {"article": "3", "numero": "9", "auteurs": ["A", "B"], "rapporteur": True, "dispositif": "d", "texte_examine": {"titre": "T"}, "point_impact": {"type": "article_entier", "alinea": 4}}
    r = flat(spark, own)
    assert (r.id, r.auteurs, r.auteur, r.rapporteur, r.texte, r.texte_examine.titre, r.point_impact.alinea) == ("amdt-0", ["A", "B"], "A, B", True, "d", "T", 4)
    again = flat(spark, json.loads(json.dumps(r.asDict(recursive=True))))
    assert again.asDict(recursive=True) == r.asDict(recursive=True)


def test_triage(spark, tmp_path):
    write(tmp_path, a=[{"id": "x1", "article": "2", "numero": "1", "dispositif": "Supprimer cet article"}, {"id": "x2", "article": "2", "numero": "2", "dispositif": "supprimer  cet article"}], b={"amendements": [{"id": "x3", "article": "10", "numero": "3", "dispositif": "z"}]})
    done = Triage.read(spark, str(tmp_path)).presort().classify()
    assert {r.id: (r.rang, r.statut) for r in done.df.collect()} == {"x1": (1, "Identique"), "x2": (2, "Identique"), "x3": (3, "Isolé")}
    assert "ARTICLE 10" in done.document().first().document
    assert done.counts().first().n_id == 2


def test_triage_of_repeated_ids(spark):
    """Records in, records out, whatever their ids; only an article's first record is not asked about."""
    rows = [(0, "a", "1", "1", "x y z one", "p"), (1, "b", "1", "2", "x y z two", "q"), (2, "b", "1", "3", "other text", "r"), (3, "a", "1", "4", "x y z three", "s")]
    df = spark.createDataFrame(rows, "_pos long, id string, article string, numero string, dispositif string, auteur string").withColumn("texte", F.col("dispositif"))
    done = Triage(df).presort().classify()
    assert [(r._pos, r.id, r.statut) for r in done.df.orderBy("_pos").collect()] == [(0, "a", "Isolé"), (1, "b", "Discussion commune"), (2, "b", "Isolé"), (3, "a", "Discussion commune")]


def test_sessions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "_pos long, id string")
    documents.save_session(df, str(tmp_path / "s"))
    assert documents.restore_session(spark, str(tmp_path / "s"), df.schema).count() == 1
    assert documents.restore_session(spark, str(tmp_path / "none"), df.schema).count() == 0
    records, bad = documents.inline(spark, '{"amendements": [{"id": "a"}]}')
    assert records.count() == 1 and bad.isEmpty()


def test_progress(spark, tmp_path):
    verdicts = tmp_path / "v"
    verdicts.mkdir()
    (verdicts / "1.json").write_text('{"id": "a", "statut": "Isolé", "seq": 1}\n{"id": "b", "statut": "Isolé", "seq": 2}\n')
    records = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    out = str(tmp_path / "out")
    for more in (None, '{"id": "a", "statut": "Identique", "seq": 3}\n'):
        if more:
            (verdicts / "2.json").write_text(more)
        progress.follow_verdicts(spark, records, str(verdicts), out, str(tmp_path / "c")).awaitTermination()
        records = progress.latest_records(spark, out).drop("version", "part", "resultat_ia", "seq")
    last = progress.latest_records(spark, out)
    assert {r.id: r.resultat_ia and r.resultat_ia.statut for r in last.collect()} == {"a": "Identique", "b": "Isolé", "c": None}
