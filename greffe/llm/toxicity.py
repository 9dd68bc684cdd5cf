"""Operator 6: toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of three hashed embeddings: of the word, and of its first six and first four bytes, so that
unseen forms of a stem are known. Filters of one, two and three words slide over the whole text; the largest response
of each is kept, and a logistic layer turns them into a score. Spark picks a bounded sample of labelled rows, one task
trains on it, and all texts are scored in their partitions.

Scores are calibrated by language: on rows held back from the fit, each language gets a threshold, which becomes the
score 0.5. The language is told from the text's words alone (naive Bayes on hashed words); the lang column serves only
as the target of that. Labels, lang, source and doc_id are never inputs of a score.

Null and empty texts get the score of a text without words. A null label teaches nothing. If the sample lacks a class,
every score is the share of label 1 in it, or 0 without labels. A null doc_id is not held out. Repeated rows get equal
scores; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work, words

#: Bounds of the training sample: rows a class, and bytes of a text (larger ones are not in the sample, but are scored).
SAMPLE_ROWS, SAMPLE_BYTES = 3_000, 32_768
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
EPOCHS, RATE, SEED = 6, 0.15, 7
TABLE_SCALE = 0.02
#: One in so many rows of the sample is held back for the thresholds; a language needs so many of each class there.
HELD_BACK, ENOUGH = 4, 10
LANGUAGE_BUCKETS = 1 << 15

PUNCTUATED = words.SEPARATOR.copy()
PUNCTUATED[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of each word, of its first six and of its first four bytes; and where each text's words start."""
    split = words.split(texts, lower=True, gaps=PUNCTUATED)
    columns = []
    for most in (None, 6, 4):
        ends = split.ends if most is None else np.minimum(split.ends, split.starts + most)
        hashed = words.hashes(words.Words(split.data, split.starts, ends, split.docs))
        columns.append(((hashed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.uint16))
    return columns, split.docs


@dataclass
class Model:
    tables: list[np.ndarray] = field(default_factory=list)  # three embeddings, BUCKETS x DIMS
    kernels: list[np.ndarray] = field(default_factory=list)  # for each width: width x DIMS x FILTERS
    biases: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0
    languages: np.ndarray | None = None  # log likelihoods, LANGUAGE_BUCKETS x languages
    thresholds: np.ndarray | None = None  # of the logit, for each language
    constant: float | None = None

    def vectors(self, columns: list[np.ndarray], at: slice) -> np.ndarray:
        rows = sum(table[column[at]] for table, column in zip(self.tables, columns))
        short = max(WIDTHS) - len(rows)
        return np.vstack([rows, np.zeros((short, DIMS), np.float32)]) if short > 0 else rows

    def logits(self, columns: list[np.ndarray], docs: np.ndarray) -> np.ndarray:
        out = np.empty(len(docs) - 1)
        for i, (a, b) in enumerate(zip(docs[:-1].tolist(), docs[1:].tolist())):
            best = np.full(FILTERS * len(WIDTHS), -np.inf, dtype=np.float32)
            for at in range(a, max(b, a + 1), 65_536):  # a very long text in overlapping parts
                rows = self.vectors(columns, slice(at, min(b, at + 65_536 + max(WIDTHS) - 1)))
                np.maximum(best, np.concatenate([x.max(axis=0) for x in self.responses(rows)]), out=best)
            out[i] = np.maximum(best, 0) @ self.weights + self.bias
        return out

    def responses(self, rows: np.ndarray) -> list[np.ndarray]:
        out = []
        for width, kernel, bias in zip(WIDTHS, self.kernels, self.biases):
            many = len(rows) - width + 1
            response = rows[:many] @ kernel[0]
            for j in range(1, width):
                response += rows[j : j + many] @ kernel[j]
            out.append(response + bias)
        return out

    def language(self, columns: list[np.ndarray], docs: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(np.diff(docs))
        out = np.zeros(len(docs) - 1, dtype=np.int64)
        if len(full):
            seen = self.languages[columns[0] % LANGUAGE_BUCKETS]
            out[full] = np.add.reduceat(seen, docs[:-1][full], axis=0).argmax(axis=1)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        columns, docs = features(texts)
        return sigmoid(self.logits(columns, docs) - self.thresholds[self.language(columns, docs)])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[str], labels: np.ndarray, langs: list[str]) -> Model:
    """Fit on the sample. Rows are taken in the order given, so the same sample gives the same model."""
    labels = np.asarray(labels, dtype=np.float64)
    if len(set(labels.tolist())) < 2:
        return Model(constant=float(labels.mean()) if len(labels) else 0.0)
    columns, docs = features(pa.array(texts, pa.string()))
    back = np.arange(len(labels)) % HELD_BACK == 0
    rng = np.random.default_rng(SEED)
    model = Model()
    model.tables = [rng.normal(0, TABLE_SCALE, (BUCKETS, DIMS)).astype(np.float32) for _ in range(3)]
    model.kernels = [rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    model.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    model.weights = rng.normal(0, 0.3, FILTERS * len(WIDTHS))
    squares = {id(x): np.full(x.shape, 1e-2, dtype=np.float32) for x in [*model.tables, *model.kernels, *model.biases]}
    square_w, square_b = np.full(model.weights.shape, 1e-2), 1e-2

    def step(x, at, grad):
        """Adagrad, at some rows of an array."""
        square = squares[id(x)]
        np.add.at(square, at, grad * grad)
        np.add.at(x, at, (-RATE * grad / np.sqrt(square[at])).astype(np.float32))

    use = np.flatnonzero(~back) if (~back).sum() > 1 and len(set(labels[~back].tolist())) == 2 else np.arange(len(labels))
    for _ in range(EPOCHS):
        for i in rng.permutation(use).tolist():
            a, b = int(docs[i]), int(docs[i + 1])
            rows = model.vectors(columns, slice(a, b))
            responses = model.responses(rows)
            where = [x.argmax(axis=0) for x in responses]
            most = np.concatenate([x[w, np.arange(FILTERS)] for x, w in zip(responses, where)])
            pooled = np.maximum(most, 0)
            error = sigmoid(pooled @ model.weights + model.bias) - labels[i]
            down = np.where(most > 0, error * model.weights, 0)
            grad = error * pooled
            square_w += grad * grad
            square_b += error * error
            model.weights -= RATE * grad / np.sqrt(square_w)
            model.bias -= RATE * error / np.sqrt(square_b)
            for k, width in enumerate(WIDTHS):
                own = down[k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
                live = np.flatnonzero(own)
                if not len(live):
                    continue
                step(model.biases[k], live, own[live])
                for j in range(width):
                    at = where[k][live] + j
                    to_kernel = rows[at].T * own[live]
                    to_rows = model.kernels[k][j][:, live].T * own[live, None]
                    change = np.zeros((DIMS, FILTERS), np.float32)
                    change[:, live] = to_kernel
                    step(model.kernels[k], j, change)
                    real = at < b - a
                    for table, column in zip(model.tables, columns):
                        step(table, column[a + at[real]], to_rows[real])
    learn_languages(model, columns, docs, langs)
    calibrate(model, columns, docs, labels, back)
    return model


def learn_languages(model: Model, columns: list[np.ndarray], docs: np.ndarray, langs: list[str]) -> None:
    names = sorted({x or "" for x in langs})
    seen = np.ones((LANGUAGE_BUCKETS, len(names)))
    owner = np.repeat([names.index(x or "") for x in langs], np.diff(docs))
    np.add.at(seen, (columns[0] % LANGUAGE_BUCKETS, owner), 1)
    model.languages = np.log(seen / seen.sum(axis=0)).astype(np.float32)


def calibrate(model: Model, columns: list[np.ndarray], docs: np.ndarray, labels: np.ndarray, back: np.ndarray) -> None:
    logits, language = model.logits(columns, docs), model.language(columns, docs)
    model.thresholds = np.full(model.languages.shape[1], threshold(logits[back], labels[back]))
    for i in range(len(model.thresholds)):
        own = back & (language == i)
        if min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= ENOUGH:
            model.thresholds[i] = threshold(logits[own], labels[own])


def threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap in the logits at which the fewest rows are wrong; of several gaps the widest."""
    if len(set(labels.tolist())) < 2:
        return 0.0
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)])
    false = (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
    edges = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
    cost = missed + false
    best = np.flatnonzero(cost <= cost.min())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[widest] + edges[widest + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs(doc_id, text, lang) and labels(doc_id, toxic), of rows that aren't held out."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id")
    own = own.join(short, "doc_id", "left_semi")
    chosen = None
    for label in (0, 1):
        some = own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE_ROWS)
        chosen = some if chosen is None else chosen.unionByName(some)
    # 2 * SAMPLE_ROWS rows at most
    rows = docs.select("doc_id", "text", "lang").where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc_id", "toxic", "x.text", "x.lang")
    return work.fitted(rows, train_on)


def train_on(rows: pa.Table) -> Model:
    """train() on the rows in an order that depends on themselves alone."""
    ids, texts = rows["doc_id"].to_pylist(), rows["text"].to_pylist()
    order = sorted(range(rows.num_rows), key=lambda i: (ids[i] * 0x9E3779B1 % (1 << 32), ids[i], texts[i]))
    rows = rows.take(pa.array(order, pa.int64()))
    return train(rows["text"].to_pylist(), rows["toxic"].to_numpy(), rows["lang"].to_pylist())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5) for every document."""
    spark = docs.sparkSession
    work.arrow_batches(spark)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    model = spark.sparkContext.broadcast(fit(docs, labels.select("doc_id", "toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    work.arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "toxic")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
