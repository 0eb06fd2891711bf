"""Quality classifier: hashed word n-gram logistic regression, learned by FTRL.

Features of a text are hashed n-grams of its words and of its word shapes
(a shape keeps the classes of a word's bytes, runs collapsed, and whether the
word repeats the one before).  Each family of n-grams is averaged, so a score
does not depend on a text's length.  Weights are learned by
follow-the-regularised-leader updates; a score is the logistic function of one
sparse dot product.

Defined cases: a null or empty text has no features and gets the score of the
intercept.  A very long text is scored whole, in slices.  Of several labels of one
doc_id the smallest counts, and of several texts the largest.  Repeated rows get
equal scores.  An empty table gives an empty result; without labelled rows every
score is 0.5.  Other columns are ignored
by :func:`fit` and kept by :func:`score`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .common import give_back, slices, small_batches, staged, with_fields

U64 = np.uint64
BITS = 17
#: Weight of each family in a score: words, word pairs, shapes, shape pairs, shape triples.
FAMILIES = (2.0, 1.0, 4.0, 4.0, 4.0)
#: At most so many labelled documents are learned from (a documented bound).
SAMPLE_ROWS = 4000
EPOCHS = 4

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def predict(self, column: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text."""
        total = np.zeros(len(column))
        for weight, (codes, first) in zip(FAMILIES, features(column), strict=True):
            n = np.maximum(np.diff(first), 1)
            total += weight * B.gathered_sums(self.weights, codes, first) / n
        return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -35, 35)))


def _grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of word codes, none across rows."""
    if n == 1:
        return h, first
    out = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        out = B.mix(out + h[k : k + len(out)] * U64(0xD6E8FEB86659FD93))
    row_end = np.repeat(first[1:], np.diff(first))[: len(out)]
    keep = np.arange(len(out)) + n <= row_end
    counts = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], counts[np.minimum(first, len(out))]


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family its bucket numbers, and each row's first entry in them."""
    data, offsets = B.raw_bytes(column)
    starts, ends, first = B.spans(data, offsets, B.NOT_SPACE)
    words = B.hashes(data, starts, ends)
    kinds = _CLASS[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = B.hashes(kinds[keep], place[starts], place[ends])
    same = np.zeros(len(words), dtype=bool)
    same[1:] = words[1:] == words[:-1]
    inner = first[:-1][first[:-1] < len(words)]
    same[inner] = False
    shapes = B.mix(shapes + same.astype(U64))
    out = []
    for salt, (codes, n) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        grams, at = _grams(codes, first, n)
        out.append(((B.mix(grams + U64(salt * 7919 + 1)) >> U64(64 - BITS)).astype(np.int64), at))
    return out


def _rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row as distinct bucket numbers and values."""
    families = features(column)
    out = []
    for i in range(len(column)):
        codes, values = [], []
        for weight, (all_codes, first) in zip(FAMILIES, families, strict=True):
            own = all_codes[first[i] : first[i + 1]]
            if len(own):
                unique, counts = np.unique(own, return_counts=True)
                codes.append(unique)
                values.append(weight * counts / len(own))
        joined = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
        unique, back = np.unique(joined, return_inverse=True)
        out.append((unique, np.bincount(back, np.concatenate(values)) if codes else np.zeros(0)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Follow-the-regularised-leader, proximal form, one update a row."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    order = np.random.default_rng(seed)
    positive = max(float(np.mean(labels)), 1e-6) if len(labels) else 0.5
    costs = (0.5 / max(1 - positive, 1e-6), 0.5 / positive) if 0 < positive < 1 else (1.0, 1.0)
    weight = np.sqrt(costs)  # halves the effect of uneven classes

    def lead(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            idx, x = rows[i]
            w = lead(z[idx], n[idx])
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x + b, -35, 35)))
            g = (p - labels[i]) * weight[int(labels[i])]
            gx = g * x
            z[idx] += gx - (np.sqrt(n[idx] + gx * gx) - np.sqrt(n[idx])) / alpha * w
            n[idx] += gx * gx
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    return Model(lead(z, n).astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def fit(documents: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents, chosen by a hash of doc_id.

    ``labels`` has doc_id and quality; pairs with a null are left out.  The
    sample is bounded by ``rows``, and learned from in one task.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("double")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    chosen = staged(chosen, "chosen", rows=rows)  # a table whose size Spark knows when it plans the join
    texts = documents.select("doc_id", "text").join(chosen, "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("text").alias("text"))

    def learn(batches):
        got, ys, ids = [], [], []
        for batch in slices(batches, "text"):
            got += _rows(batch.column("text"))
            ys += batch.column("quality").to_pylist()
            ids += batch.column("doc_id").to_pylist()
        order = np.argsort(np.asarray(ids, dtype=np.int64), kind="stable")
        model = train([got[i] for i in order], np.asarray(ys)[order]) if got else Model(np.zeros(1 << BITS, np.float32), 0.0)
        got.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    got = texts.repartition(1).mapInArrow(learn, "weights binary, bias double").collect()
    if not got:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(got[0].weights, dtype=np.float32), got[0].bias)


def score(documents: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each whole text in column ``out`` (replaced if there)."""
    held = small_batches(documents.sparkSession).sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c != out]
    base = documents.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches):
        for batch in slices(batches, text):
            scores = pa.array(held.value.predict(batch.column(text)), pa.float64())
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, scores], [*kept, out])

    return base.mapInArrow(run, with_fields(base, **{out: "double"}))
