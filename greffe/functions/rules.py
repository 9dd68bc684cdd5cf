"""Rule cascades and lookups, each folded into one CASE or map expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, lower_strip


@dataclass(frozen=True)
class Rule:
    """Texts that start with, or hold, any of the phrases."""

    priority: int
    action: str
    phrases: tuple[str, ...]
    anywhere: bool = False

    def holds(self, text: Column) -> Column:
        found = None
        for phrase in self.phrases:
            one = text.contains(phrase) if self.anywhere else text.startswith(phrase)
            found = one if found is None else found | one
        return found


#: Fixed values. The first rule that holds gives priority and action.
ACTION_RULES = (
    Rule(1, "article_suppression", ("supprimer cet article", "supprimer l'article")),
    Rule(2, "article_redaction", ("rédiger ainsi cet article", "rédiger ainsi l'article")),
    Rule(3, "alinea_suppression", ("supprimer l'alinéa", "supprimer les alinéas"), anywhere=True),
    Rule(4, "alinea_redaction", ("rédiger ainsi l'alinéa", "rédiger ainsi cet alinéa"), anywhere=True),
)
OTHERWISE = (5, "restreint")
STATUS_COLOURS = {"Doublon": "rouge", "Identique": "orange", "Incompatible": "orange"}
STATUS_GROUPS = {"Identique": "identiques", "Identiques": "identiques", "Incompatible": "discussion_commune", "Discussion commune": "discussion_commune"}
BADGES = (("gray", ("isolé", "nouveau")), ("purple", ("commune", "incompatible")), ("blue", ("identique",)), ("red", ("erreur",)))
IMPACT_LABELS = {
    "suppression_article": "Suppression d’article",
    "redaction_globale_article": "Rédaction globale (article)",
    "suppression_alinea": "Suppression d’alinéa",
    "redaction_globale_alinea": "Rédaction globale (alinéa)",
    "point_restreint": "Point d’impact restreint",
    "article_entier": "Article entier",
}
GROUP_LABELS = {"discussion_commune": "Discussion commune", "identiques": "Identiques", "doublon": "Doublon", "additionnel": "Additionnel", "isole": "Isolé"}
BRACKET_LABELS = {"discussion_commune": "Dc.", "identiques": "Id."}
COLOUR_EMOJI = {"rouge": "🔴", "orange": "🟠"}
ACTION_IMPACTS = {"article_suppression": "suppression_article", "article_redaction": "redaction_globale_article", "alinea_suppression": "suppression_alinea", "alinea_redaction": "redaction_globale_alinea", "restreint": "point_restreint"}


def rule_cascade(text: Column | str, rules: Sequence[Rule] = ACTION_RULES, otherwise: tuple[int, str] = OTHERWISE) -> Column:
    """Struct(priority, action) of the first rule that holds for the lower-cased, trimmed text; null text is as empty."""
    text = lower_strip(F.coalesce(col(text), F.lit("")))
    pick = lambda p, a: F.struct(F.lit(p).alias("priority"), F.lit(a).alias("action"))
    found = None
    for rule in rules:
        found = F.when(rule.holds(text), pick(rule.priority, rule.action)) if found is None else found.when(rule.holds(text), pick(rule.priority, rule.action))
    return pick(*otherwise) if found is None else found.otherwise(pick(*otherwise))


def looked_up(value: Column | str, table: dict[str, str], default: Column | str | None = None) -> Column:
    """The value's entry in a small table; otherwise the default (a Column or a literal)."""
    value = col(value)
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    other = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(entries, value), other)


def status_colour(status: Column | str) -> Column:
    return looked_up(status, STATUS_COLOURS, "vert")


def client_colour(given: Column | str, status: Column | str) -> Column:
    """The model's own colour, else orange for Identique and green for the rest."""
    return F.coalesce(F.nullif(col(given), F.lit("")), F.when(col(status) == "Identique", "orange").otherwise("vert"))


def status_group(status: Column | str) -> Column:
    return looked_up(status, STATUS_GROUPS)


def badge(status: Column | str) -> Column:
    text = F.lower(F.coalesce(col(status), F.lit("")))
    found = None
    for colour, phrases in BADGES:
        test = None
        for phrase in phrases:
            test = text.contains(phrase) if test is None else test | text.contains(phrase)
        if colour == "red":
            test = test | text.isin("—", "")
        found = F.when(test, colour) if found is None else found.when(test, colour)
    return found.otherwise("gray")


def impact_label(kind: Column | str) -> Column:
    return looked_up(kind, IMPACT_LABELS, col(kind))


def group_label(kind: Column | str) -> Column:
    return looked_up(kind, GROUP_LABELS, col(kind))


def colour_emoji(colour: Column | str) -> Column:
    return looked_up(colour, COLOUR_EMOJI, "🟢")


def is_rate_limit(message: Column | str) -> Column:
    return F.coalesce(F.lower(col(message)).rlike("429|rate limit|quota"), F.lit(False))
