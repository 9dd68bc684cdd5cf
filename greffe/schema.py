"""Types and enumerations of amendment records."""

from pyspark.sql import types as T

#: Fixed values.
IMPACT_TYPES = ("suppression_article", "redaction_globale_article", "suppression_alinea", "redaction_globale_alinea", "point_restreint", "article_entier")
GROUP_TYPES = ("discussion_commune", "identiques", "doublon", "additionnel", "isole")

GROUP = "type string, groupe_id string"
#: Names and types of the record format.
AMENDMENT_DDL = (
    "id string, article string, numero string, rectification string, date_depot string,"
    " texte_examine struct<titre: string, lecture: string, numero_texte: string>, auteurs array<string>, auteur string, rapporteur boolean,"
    " avis_commission string, avis_gouvernement string, dispositif string, texte string, expose_sommaire string,"
    " point_impact struct<type: string, alinea: int>, categorie string"
)
VERDICT_DDL = "id string, statut string, justification string, alerte_couleur string, rang int, groupe struct<type: string, groupe_id: string>"


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
