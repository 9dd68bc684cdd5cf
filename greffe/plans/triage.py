"""The triage of one batch, from documents to a ranked and decorated list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, groups, merge, ranking, report
from ..sources import documents, normalize
from .lineage import cut


@dataclass(frozen=True)
class Triage:
    """Steps return a new Triage; df holds the records, whose lineage each step cuts."""

    df: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str, tags: bool = True) -> "Triage":
        records, _ = documents.read_json_documents(spark, path)
        return Triage(cut(normalize.normalize(documents.positions(cut(records)), tags=tags)))

    def presort(self, engine: str = "B") -> "Triage":
        return Triage(cut(groups.identiques(cut(ranking.presort(self.df, engine)))))

    def classify(self, classifier: classify.Classifier = classify.stub, options: classify.Options = classify.Options()) -> "Triage":
        """Rows in exact groups keep that verdict; the model compares each other row with the first of its article.

        Verdicts come back by rang, which each record has to itself; ids may repeat.
        """
        paired = merge.with_reference(self.df, ["article"], ["auteur", "texte", "rang"], "rang")
        ask = paired.where(~F.col("saute_modele") & (F.col("rang") != F.col("ref_rang")))
        found = classify.classify_pairs(ask, classifier, options, key="rang").withColumnRenamed("statut", "__statut")
        joined = self.df.join(found, "rang", "left")
        status = F.when(F.col("saute_modele"), "Identique").otherwise(F.coalesce("__statut", F.lit("Isolé")))
        named = F.concat(F.lit("grp-"), F.col("groupe_type"), F.lit("-art"), F.col("article"))
        group = F.coalesce("groupe", F.when(F.col("groupe_type").isNotNull(), F.struct(F.col("groupe_type").alias("type"), named.alias("groupe_id"))))
        return Triage(cut(joined.withColumns({"statut": status, "groupe": group}).drop("__statut", "groupe_type", "limite")))

    def counts(self) -> DataFrame:
        return report.status_counts(self.df)

    def document(self) -> DataFrame:
        return report.rtf_document(self.df.withColumn("_pos", F.col("rang")))
