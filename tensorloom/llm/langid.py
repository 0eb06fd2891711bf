"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the average of the embeddings of its hashed subwords (its words,
and byte n-grams of the lower-cased text).  Embeddings and the softmax layer
are learned together by stochastic gradient descent in NumPy.  For scoring
both are folded into one table of class scores per bucket, which gives the
same result.  A temperature and a rejection threshold are calibrated on a part
of the sample that was not learned from.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.
A text with letters gets a learned language; ``accepted`` tells whether its
score reaches the calibrated threshold.  A very long text is averaged whole, in
blocks.  Of equally likely languages the first by name is given.  Repeated rows
get equal results; an empty table gives an empty one; without a labelled row all
is ``und``.  Other columns are ignored when learning and kept when scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords as B
from .common import slices, small_batches, staged, with_fields

U64 = np.uint64
BITS, DIM = 16, 16
GRAMS = (3, 4)
#: About so many documents of each language are learned from (documented bounds).
ROWS_PER_LANGUAGE = 600
MOST_ROWS = 12_000
EPOCHS = 4
#: Bytes whose n-grams are worked on at a time.
BLOCK = 1 << 20
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # class scores of each bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, calibrated probabilities and acceptance of each text."""
        letters = np.fromiter((t is not None and _LETTER.search(t) is not None for t in column.to_pylist()), bool, len(column))
        if not self.languages:
            return ["und"] * len(column), np.zeros(len(column)), np.zeros(len(column), dtype=bool)
        logits = np.zeros((len(column), len(self.languages)))
        n = np.zeros(len(column))
        for codes, first in features(column):
            logits += B.gathered_sums(self.table, codes, first)
            n += np.diff(first)
        p = _softmax((logits / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(letters, p[np.arange(len(p)), best], 0.0)
        names = [self.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
        return names, score, letters & (score >= self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def features(column: pa.Array):
    """Bucket numbers and each row's first entry in them: of the words, then of blocks of byte n-grams."""
    data, offsets = B.raw_bytes(column)
    data = B.LOWER[data]
    starts, ends, first = B.spans(data, offsets, B.NOT_SPACE)
    yield (B.hashes(data, starts, ends) >> U64(64 - BITS)).astype(np.int64), first
    for n in GRAMS:
        for begin in range(0, max(0, len(data) - n + 1), BLOCK):
            last = min(BLOCK, len(data) - n + 1 - begin)
            packed = np.zeros(last, dtype=np.uint32)
            for k in range(n):
                packed |= data[begin + k : begin + k + last].astype(np.uint32) << np.uint32(8 * k)
            codes = ((packed * np.uint32(2654435761) + np.uint32(n * 97)) >> np.uint32(32 - BITS)).astype(np.int32)
            keep = np.ones(last, dtype=bool)
            for cut in offsets[1:-1][(offsets[1:-1] > begin) & (offsets[1:-1] < begin + last + n)] - begin:
                keep[max(0, cut - n + 1) : max(0, cut)] = False  # would cross into the next row
            counts = np.concatenate([[0], np.cumsum(keep)])
            yield codes[keep], counts[np.clip(offsets - begin, 0, last)]


def _rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row as distinct buckets and their shares."""
    families = list(features(column))
    out = []
    for i in range(len(column)):
        codes = np.concatenate([c[f[i] : f[i + 1]] for c, f in families])
        unique, counts = np.unique(codes, return_counts=True)
        out.append((unique, counts / max(1, len(codes))))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], names: list[str], *, rate: float = 4.0, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Stochastic gradient descent over rows, then calibration on every tenth."""
    languages = tuple(sorted(set(names)))
    if not languages:
        return Model((), np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BITS, DIM))
    layer, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    y = np.searchsorted(np.asarray(languages), np.asarray(names))
    held = np.arange(len(rows)) % 10 == 9 if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
    own = np.flatnonzero(~held)
    step, steps = 0, epochs * max(1, len(own))
    for _ in range(epochs):
        for i in rng.permutation(own):
            idx, x = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(idx):
                continue
            mean = x @ embed[idx]
            g = _softmax((mean @ layer + bias)[None])[0]
            g[y[i]] -= 1
            back = layer @ g
            layer -= 0.1 * lr * np.outer(mean, g)
            bias -= 0.01 * lr * g
            embed[idx] -= lr * np.outer(x, back) * min(50.0, 1 / max(1e-9, float(x @ x)) ** 0.5)
    table = (embed @ layer).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    logits = np.array([x @ table[idx] + bias for idx, x in (rows[i] for i in check)])
    truth = y[check]
    # The temperature that gives the held-out part the least log loss.
    temperature = min(np.geomspace(0.02, 5, 60), key=lambda t: -np.mean(np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12)) + 1e-4 * abs(np.log(t)))
    p = _softmax(logits / temperature)
    right = p[np.arange(len(truth)), truth]
    # Accept what is at least as sure as the least sure hundredth of right answers.
    threshold = float(np.quantile(right[p.argmax(axis=1) == truth], 0.01)) if (p.argmax(axis=1) == truth).any() else 0.0
    return Model(languages, table, bias, float(temperature), threshold)


def fit(documents: DataFrame, *, lang: str = "lang", per_language: int = ROWS_PER_LANGUAGE, most: int = MOST_ROWS) -> Model:
    """Learn from rows with a language, about ``per_language`` of each, fewer where ``most`` is shared by many.

    Rows are chosen by a hash of doc_id within each language, so the sample is
    bounded and has every language; it is learned from in one task.
    """
    known = documents.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy(lang).agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(1.0), F.least(F.lit(float(per_language)), F.lit(float(most)) / F.count("*").over(Window.partitionBy())))
    shares = counts.withColumn("share", F.least(F.lit(1.0), 4 * each / F.col("n"))).withColumn("each", F.floor(each))  # a row a language
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # About four times as many as wanted are drawn, and the first of each language kept; a rare language comes whole.
    drawn = known.select("doc_id", lang).join(shares, lang).where((draw < F.col("share")) | (F.col("n") <= 4 * F.col("each")))
    first = Window.partitionBy(lang).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = drawn.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= F.col("each")).select("doc_id").distinct()
    chosen = staged(chosen, "chosen", rows=most)  # a table whose size Spark knows when it plans the join
    sample = known.select("doc_id", F.col(lang).alias("lang"), "text").join(chosen, "doc_id")

    def learn(batches):
        got, names, ids = [], [], []
        for batch in slices(batches, "text"):
            got += _rows(batch.column("text"))
            names += batch.column("lang").to_pylist()
            ids += batch.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], names[i], len(got[i][0])))
        model = train([got[i] for i in order], [names[i] for i in order])
        values = [list(model.languages), model.table.astype(np.float32).tobytes(), model.bias.tolist(), model.temperature, model.threshold]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["languages", "table", "bias", "temperature", "threshold"])

    got = sample.repartition(1).mapInArrow(learn, "languages array<string>, table binary, bias array<double>, temperature double, threshold double").collect()
    if not got or not got[0].languages:
        return train([], [])
    table = np.frombuffer(got[0].table, dtype=np.float32).reshape(1 << BITS, len(got[0].languages))
    return Model(tuple(got[0].languages), table, np.asarray(got[0].bias), got[0].temperature, got[0].threshold)


def identify(documents: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Add lang_pred, score and accepted to every row (replaced if there)."""
    held = small_batches(documents.sparkSession).sparkContext.broadcast(model)
    new = ["lang_pred", "score", "accepted"]
    kept = [c for c in documents.columns if c not in new]
    base = documents.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches):
        for batch in slices(batches, text):
            names, score, accepted = held.value.predict(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], [*kept, *new])

    return base.mapInArrow(run, with_fields(base, lang_pred="string", score="double", accepted="boolean"))
