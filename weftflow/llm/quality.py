"""Quality classifier on random-indexing word vectors (operator 7).

Words, marks and case are tokens, hashed to ``BUCKETS``. Random indexing gives each bucket a sparse random
index vector and a word vector, the sum of the index vectors around its occurrences in the training texts.
A document is the mean of its tokens' word vectors, with a few shape figures (how many tokens repeat the
one before, how many are distinct, its length). A network of one hidden layer and a logistic output, fitted
in numpy, scores it; a temperature fitted on rows kept out of training calibrates the probabilities.

The model is fitted on at most about ``SAMPLE`` labelled rows, drawn by a hash of the document id over all
labelled rows that the caller allows; ids, languages, sources and labels are never inputs of a score.
Scoring is one narrow pass over whole texts.

Edge cases: null and empty texts have no tokens and get the score of a zero vector; labels are 0 or 1, and
null labels or labels of unknown documents teach nothing; different labels of a document all count, equal ones once; with no
usable labels every score is 0.5; other columns are left out (:func:`score`) or kept (:func:`keep`) whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.routing import spread
from .common import slices
from .pieces import PieceCoder, held, packed

BUCKETS = 1 << 14
SIZE = 48
NONZERO = 6
HIDDEN = 24
REACH = 2
#: Labelled rows that the model may be fitted on.
SAMPLE = 6000
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def tokens(piece: str) -> list[str]:
    """Lower-case words, numbers by length, runs of marks; a word in capitals also gives ``<caps>``."""
    out = []
    for token in _TOKEN.findall(piece):
        if token[0].isalpha():
            out.append(token.lower())
            if len(token) > 1 and token.isupper():
                out.append("<caps>")
        elif token[0].isdigit():
            out.append(f"<number {min(len(token), 9)}>")
        else:
            out.append(token)
    return out


def _code(words: list[str]) -> list[bytes]:
    return [np.array([zlib.crc32(t.encode()) % BUCKETS for t in tokens(word)], dtype="<u2").tobytes() for word in words]


def coder() -> PieceCoder:
    return held("quality", lambda: PieceCoder(lambda piece: [piece], _code))


def buckets(texts: pa.Array, own: PieceCoder) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2") for x in packed(texts, own).to_pylist()]


def word_vectors(docs: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """Random indexing over token sequences: index vectors plus those of ``REACH`` neighbours each way."""
    rng = np.random.default_rng(seed)
    index = np.zeros((BUCKETS, SIZE), dtype=np.float32)
    where = rng.random((BUCKETS, SIZE)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(index, where, rng.choice(np.float32([-1, 1]), (BUCKETS, NONZERO)), axis=1)
    context = np.zeros_like(index)
    for start in range(0, len(docs), 100):
        part = docs[start : start + 100]
        # gaps between documents are a bucket of their own, whose vectors are dropped
        gap = np.full(REACH, BUCKETS, dtype=np.int64)
        row = np.concatenate([x for doc in part for x in (doc.astype(np.int64), gap)])
        wide = np.vstack([index, np.zeros((1, SIZE), dtype=np.float32)])
        around = np.zeros((len(row), SIZE), dtype=np.float32)
        for reach in range(1, REACH + 1):
            around[reach:] += wide[row[:-reach]]
            around[:-reach] += wide[row[reach:]]
        order = np.argsort(row, kind="stable")
        found, first = np.unique(row[order], return_index=True)
        sums = np.add.reduceat(around[order], first, axis=0)
        real = found < BUCKETS
        context[found[real]] += sums[real]
    vectors = index + context / np.maximum(1e-6, np.linalg.norm(context, axis=1, keepdims=True))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def features(docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """A row for each document: pooled vector, share of repeats, share of distinct tokens, log length."""
    out = np.zeros((len(docs), SIZE + 4), dtype=np.float32)
    for k, doc in enumerate(docs):
        if len(doc):
            if len(doc) > BUCKETS:
                out[k, :SIZE] = np.bincount(doc, minlength=BUCKETS).astype(np.float32) @ vectors / len(doc)
            else:
                out[k, :SIZE] = vectors[doc].mean(axis=0)
            out[k, SIZE] = np.mean(doc[1:] == doc[:-1]) if len(doc) > 1 else 0
            out[k, SIZE + 1] = len(np.unique(doc)) / np.sqrt(len(doc))
            out[k, SIZE + 2] = np.log1p(len(doc))
            out[k, SIZE + 3] = 1
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(features(docs, self.vectors)) / self.temperature))


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 40, seed: int = 7) -> Model:
    """Adam on the logistic loss; a tenth of the rows, dealt at random, sets the temperature."""
    rng = np.random.default_rng(seed)
    vectors = word_vectors(docs)
    x = features(docs, vectors)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    model = Model(vectors, mean, scale, [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)])
    order = rng.permutation(len(x))
    aside, own = order[: len(x) // 10], order[len(x) // 10 :]
    z, y = (x - mean) / scale, labels.astype(float)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in model.weights]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            w1, b1, w2, b2 = model.weights
            hidden = np.tanh(z[part] @ w1 + b1)
            error = (1 / (1 + np.exp(-(hidden @ w2 + b2))) - y[part]) / len(part)
            back = np.outer(error, w2) * (1 - hidden**2)
            grads = [z[part].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)]
            step += 1
            for w, grad, m in zip(model.weights, grads, moments):
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * grad**2
                w -= 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    if len(aside):
        logits = model.logits(x[aside])
        losses = {t: np.logaddexp(0, -np.where(y[aside] > 0, 1, -1) * logits / t).mean() for t in np.geomspace(0.25, 8, 41)}
        model.temperature = float(min(losses, key=losses.get))
    return model


def train(documents: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on labelled rows where ``allowed`` (an expression over the label's document id) holds.

    Rows are drawn by the hash of their id, at a share that gives about ``sample``; their texts become
    bucket numbers on the executors, and only those come to the driver.
    """
    usable = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(allowed & F.col("label").isin(0, 1))
    usable = usable.select(F.col(id_col).alias("label_id"), "label").distinct()
    total = usable.count()
    if total > sample:
        usable = usable.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(usable), F.col("doc_id") == F.col("label_id")).select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([packed(part.column(0), own), part.column(1)], names=["buckets", "label"])

    got = rows.mapInArrow(run, "buckets binary, label int").toArrow().sort_by([("label", "ascending"), ("buckets", "ascending")])
    if got.num_rows == 0:
        return None
    docs = [np.frombuffer(x, dtype="<u2") for x in got["buckets"].to_pylist()]
    return fit(docs, got["label"].to_numpy())


def score(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each whole text: the calibrated probability of label 1."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            for part in slices(batch, "text"):
                docs = buckets(part.column(1), own)
                scores = held.value.scores(docs) if held.value else np.full(len(docs), 0.5)
                yield pa.record_batch([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    read = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return spread(read).mapInArrow(run, f"doc_id {kind}, score double")


def keep(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` with a score of at least ``threshold``, with all their columns."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(part.schema.get_field_index(text_col)).fill_null("")
                if held.value:
                    part = part.filter(pa.array(held.value.scores(buckets(texts, own)) >= threshold))
                yield part

    return spread(documents).mapInArrow(run, documents.schema)
