"""Model classification: a pluggable classifier called inside Spark tasks, one row an error at most."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import replies, rules
from ..functions.text import trim_base_url
from .ranking import ranked

#: A classifier takes a request (JSON, see request()) and returns the model's reply; it may raise.
Classifier = Callable[[str], str]
#: Temperature and most tokens of a reply.
MODES = {"fast": (0.1, 4096), "deep": (0.6, 16384)}
AGAIN = "La réponse précédente n'était pas un JSON valide. Répondez par le seul JSON demandé."
RULES = (
    "Classez l'amendement TEST par rapport à REF : Identique (même article, même dispositif), Discussion commune (même article), sinon Isolé. "
    'Répondez par un seul objet JSON : {"statut": "...", "justification": "..."}.'
)


@dataclass(frozen=True)
class Options:
    system_prompt: str = RULES
    provider: str = "local"
    base_url: str = ""
    model: str = "stub"
    mode: str = "fast"
    pause_s: float = 0.0  # between the starts of two calls of a partition
    retries: int = 0  # after an error, or a reply that holds no JSON
    most_failures: int = 2  # in a row, after which the rest of a partition is marked without a call


class ClassifierError(Exception):
    """kind: auth, rate_limit, http or network."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


def error_kind(status: int | None) -> str:
    """Of an HTTP status; None for no answer."""
    if status is None:
        return "network"
    return "auth" if status == 401 else "rate_limit" if status == 429 else "http" if status >= 400 else "none"


def error_kind_of(status: Column) -> Column:
    """error_kind() of a column."""
    return F.when(status.isNull(), "network").when(status == 401, "auth").when(status == 429, "rate_limit").when(status >= 400, "http").otherwise("none")


def route(provider: Column, base_url: Column) -> Column:
    """Struct(target, address) of the provider to call: a local one has an address without the last slash and /v1."""
    local = provider == "local"
    return F.struct(F.when(local, "local").otherwise("cloud").alias("target"), F.when(local, trim_base_url(base_url)).otherwise("").alias("address"))


def request(prompt: Column, options: Options = Options()) -> Column:
    """The body of a chat call as JSON: the system's message and the user's, with the mode's settings."""
    temperature, tokens = MODES[options.mode]
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", F.lit(options.system_prompt)), message("user", prompt))
    return F.to_json(F.struct(F.lit(options.model).alias("model"), F.lit(temperature).alias("temperature"), F.lit(tokens).alias("max_tokens"), messages.alias("messages")))


def stub(body: str) -> str:
    """Deterministic, without a model: compares the two texts of a pair prompt."""
    prompt = json.loads(body)["messages"][1]["content"]
    texts = [" ".join(line[7:].split()).lower() for line in prompt.splitlines() if line.startswith("Texte: ")]
    if len(texts) < 2:
        return '{"error": "hors_sujet"}'
    same = texts[0] == texts[1] and texts[0] != ""
    status = "Identique" if same else "Discussion commune" if texts[0].split()[:3] == texts[1].split()[:3] and texts[0] else "Isolé"
    return json.dumps({"statut": status, "justification": "Comparaison mécanique."}, ensure_ascii=False)


def healthy(check: Callable[[], bool]) -> bool:
    """Probe on the driver before a job; any exception counts as no."""
    try:
        return bool(check())
    except Exception:
        return False


def preflight(df: DataFrame, check: Callable[[], bool], message: str = "Modèle injoignable.") -> tuple[DataFrame, DataFrame]:
    """(to ask, settled): if the probe fails, no row is asked and each that has no status gets Erreur in red."""
    if healthy(check):
        return df.where("statut is null"), df.where("statut is not null")
    lost = F.col("statut").isNull()
    failed = {"statut": F.coalesce("statut", F.lit("Erreur")), "justification": F.when(lost, message).otherwise(F.col("justification")), "alerte_couleur": F.when(lost, "rouge").otherwise(F.col("alerte_couleur"))}
    return df.limit(0), df.withColumns(failed)


def schedule(df: DataFrame, rank: str, lanes: int = 4, pause_s: float = 3.0) -> DataFrame:
    """Adds lane and start_s: rows in the order of rank, lanes of them at a time, and a pause between two starts of a lane."""
    at = F.col(rank) - 1
    return df.withColumns({"lane": (at % lanes).cast("int"), "start_s": (F.floor(at / lanes) * F.lit(pause_s)).cast("double")})


def interrupted(df: DataFrame, failed: str, order: str, within: list[str], most: int = 2) -> DataFrame:
    """Adds interrupted: rows after the first run of most failures of their sequence, which are not asked any more."""
    w = Window.partitionBy(*within).orderBy(order)
    run = F.sum(F.col(failed).cast("int")).over(w.rowsBetween(-(most - 1), 0)) == most
    df = df.withColumn("__trips", run)
    return df.withColumn("interrupted", F.coalesce(F.bool_or("__trips").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).drop("__trips")


def batch_fallback(df: DataFrame, failed: str, batch: str) -> DataFrame:
    """A batch in which a row failed is marked Erreur in red as a whole."""
    bad = df.groupBy(batch).agg(F.bool_or(failed).alias("__bad"))
    out = df.join(bad, batch)
    return out.withColumns({"statut": F.when(F.col("__bad"), "Erreur").otherwise(F.col("statut")), "alerte_couleur": F.when(F.col("__bad"), "rouge").otherwise(F.col("alerte_couleur"))}).drop("__bad")


def pair_prompts(pairs: DataFrame) -> DataFrame:
    """Adds prompt from auteur, texte, ref_auteur, ref_texte."""
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")
    return pairs.withColumn("prompt", F.concat(F.lit("REF - Auteur: "), flat("ref_auteur"), F.lit("\nTexte: "), flat("ref_texte"), F.lit("\nTEST - Auteur: "), flat("auteur"), F.lit("\nTexte: "), flat("texte")))


def batch_prompts(records: DataFrame, within: list[str], rank: str = "rang", most: int = 50) -> DataFrame:
    """batch, n and prompt: a group's rows as JSON in order, most of them in a prompt at most."""
    dealt = ranked(records, [F.col(rank)], "__nth", within={c: F.col(c) for c in within})
    dealt = dealt.withColumn("batch", F.floor((F.col("__nth") - 1) / most).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct(rank, "id", "article", "numero", "texte")))
    return dealt.groupBy(*within, "batch").agg(F.count("*").alias("n"), F.to_json(rows).alias("prompt"))


def holds_json(reply: str | None) -> bool:
    """Whether an object or a list can be read from the first bracket of a reply to the last."""
    found = re.search(r"\[.*\]|\{.*\}", reply or "", re.DOTALL)
    try:
        return found is not None and isinstance(json.loads(found[0]), dict | list)
    except ValueError:
        return False


def corrected(body: str) -> str:
    """The request with a corrective message, once."""
    asked = json.loads(body)
    if asked["messages"][-1]["content"] != AGAIN:
        asked["messages"].append({"role": "user", "content": AGAIN})
    return json.dumps(asked, ensure_ascii=False)


def call(prompts: DataFrame, classifier: Classifier = stub, options: Options = Options(), key: str = "id") -> DataFrame:
    """key, reply, erreur. Each failure is that row's alone; after several in a row a partition calls no more.

    A call that fails, or whose reply holds no JSON, is repeated with a corrective message as often as the options say.
    """
    columns = prompts.select(key, request(F.col("prompt"), options).alias("prompt"))
    schema = f"{key} {columns.schema[key].dataType.simpleString()}, reply string, erreur string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures, next_start = 0, 0.0
        for frame in frames:
            out = []
            for body in frame["prompt"]:
                reply = error = None
                if failures >= options.most_failures:
                    error = "interrupted"
                else:
                    for _ in range(options.retries + 1):
                        time.sleep(max(0.0, next_start - time.monotonic()))
                        next_start = time.monotonic() + options.pause_s
                        try:
                            reply, error = classifier(body), None
                        except ClassifierError as e:
                            error = f"{e.kind}: {e}"
                        except Exception as e:
                            error = str(e) or type(e).__name__
                        if error is None and holds_json(reply):
                            break
                        body = corrected(body)
                    failures = failures + 1 if error else 0
                out.append((reply, error))
            yield pd.DataFrame({key: frame[key], "reply": [x for x, _ in out], "erreur": [x for _, x in out]})

    return columns.mapInPandas(run, schema)


def verdicts(replied: DataFrame, key: str = "id") -> DataFrame:
    """key, statut, justification, alerte_couleur, groupe_type, limite. Errors give Erreur in red."""
    v = replies.verdict("reply")
    out = replied.withColumn("v", v)
    off_topic = F.get_json_object(replies.first_json("reply"), "$.error") == "hors_sujet"
    bad = F.col("erreur").isNotNull() | F.coalesce(off_topic, F.lit(False))
    status = F.when(bad, "Erreur").otherwise(F.col("v.statut"))
    return out.select(
        key, status.alias("statut"), F.when(bad, F.coalesce("erreur", F.lit("Hors sujet."))).otherwise(F.col("v.justification")).alias("justification"),
        F.when(bad, "rouge").otherwise(F.col("v.alerte_couleur")).alias("alerte_couleur"), rules.status_group(status).alias("groupe_type"), rules.is_rate_limit("erreur").alias("limite"),
    )


def classify_pairs(pairs: DataFrame, classifier: Classifier = stub, options: Options = Options(), key: str = "id") -> DataFrame:
    return verdicts(call(pair_prompts(pairs), classifier, options, key), key)
