"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

The model is fitted on about FIT_ROWS labelled documents outside the held-out
fold (all, if there are fewer), picked by a hash of their ids. Each hashed
n-gram gets its smoothed log-count ratio between toxic and other documents. A
logistic regression on presence times ratio gives the weights of all n-grams
whose ratio can be told from zero, however many; it is minimised to a stated
gradient norm, each step a pass over the sample's features where they lie.
Scoring reads whole texts and adds up the weights of the n-grams present.

Defined cases: null and empty texts have no n-grams and get the score of the
bias; without labels of both kinds every score is the share of label 1 (0 if
there are none); repeated rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.descent import minimise
from siltstone.llm.folds import held_out, sample
from siltstone.runtime import cut

ORDERS = (3, 4, 5)
#: Bits of a hashed n-gram; a text of 130 000 characters holds 3 % of the values.
BITS = 20
SMOOTHING = 1.0
#: An n-gram's ratio counts as told from zero at so many standard errors.
LEAST_Z = 4.0
#: The bound of the labelled sample that the model is fitted on.
FIT_ROWS = 16_000
THRESHOLD = 0.5
PENALTY = 1e-3
#: Partitions of the sample, and so partial sums that the driver adds up at each step.
FIT_TASKS = 12

#: Code points of a text that are hashed at a time.
_AT_ONCE = 1 << 20
_place = np.zeros(1 << BITS, np.int32)


def _distinct(grams: np.ndarray) -> np.ndarray:
    """Each value once: the row that its place remembers, which is the last to have been written there."""
    rows = np.arange(len(grams), dtype=np.int32)
    _place[grams] = rows
    return grams[_place[grams] == rows]


def ngrams(text: bytes | None, used: np.ndarray | None = None) -> np.ndarray:
    """The distinct hashed n-grams (of the used ones) of the lower-cased text's code points, in no order."""
    folded = (text or b"").decode("utf-8", "replace").lower()
    parts = []
    for at in range(0, len(folded), _AT_ONCE):
        piece = folded[at : at + _AT_ONCE + ORDERS[-1] - 1]
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        for n in ORDERS:
            size = min(_AT_ONCE, len(points) - n + 1)
            if size < 1:
                break
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h = (h + points[k : size + k]) * np.uint64(0x9E3779B97F4A7C15)
            grams = (h >> np.uint64(64 - BITS)).astype(np.int32)
            parts.append(_distinct(grams if used is None else grams[used[grams]]))
    return _distinct(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


@dataclass
class Model:
    """score = sigmoid(bias + sum of weights of the n-grams present)."""

    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    used: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, bool))

    def score(self, text: bytes | None) -> float:
        z = self.bias + float(self.weights[ngrams(text, self.used)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a task: numbers of documents, and of documents that hold each n-gram, by label."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts[y][ngrams(text.as_py())] += 1
            rows[y] += 1
    yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()]), pa.array([zlib.compress(counts.tobytes(), 1)])], ["rows", "counts"])


def ratios(counts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-count ratio of each n-gram, and whether it can be told from zero; rows of counts and docs are the labels 0 and 1."""
    q, p = ((n + SMOOTHING) / (d + 2 * SMOOTHING) for n, d in zip(counts, docs, strict=True))
    ratio = np.log(p / q)
    error = np.sqrt((1 - p) / (counts[1] + SMOOTHING) + (1 - q) / (counts[0] + SMOOTHING))
    return ratio, (np.abs(ratio) >= LEAST_Z * error) & counts.any(axis=0)


def partial_loss(x: np.ndarray, ratio: np.ndarray, slots: list[np.ndarray], y: np.ndarray) -> tuple[float, np.ndarray]:
    """Of rows that hold the n-grams at slots: the sum of their logistic losses, and its gradient by weights and bias, x."""
    total, g = 0.0, np.zeros(len(x))
    for row, label in zip(slots, y, strict=True):
        z = x[-1] + (x[row] * ratio[row]).sum()
        total += np.logaddexp(0, z) - label * z
        off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
        g[row] += off * ratio[row]
        g[-1] += off
    return float(total), g


def fit_logistic(rows: DataFrame, ratio: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias: the least mean loss plus PENALTY / 2 times the weights' squares, over rows (slots, y)."""
    n = rows.count()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, g = 0.0, np.zeros(len(x))
            for batch in batches:
                part, h = partial_loss(x, ratio, [np.frombuffer(s.as_py(), "<i4") for s in batch.column(0)], batch.column(1).to_numpy())
                total, g = total + part, g + h
            yield pa.RecordBatch.from_arrays([pa.array([np.append(g, total).tobytes()])], ["sums"])

        parts = rows.mapInArrow(sums, "sums binary").toArrow().column(0).to_pylist()  # a row for each of FIT_TASKS
        all_ = np.sum([np.frombuffer(p) for p in parts], axis=0)
        w = np.append(x[:-1], 0.0)
        return all_[-1] / n + PENALTY / 2 * float(w @ w), all_[:-1] / n + PENALTY * w

    return minimise(loss, np.zeros(len(ratio) + 1))[0]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    known = cut(sample(docs, labels, "toxic", FIT_ROWS).coalesce(FIT_TASKS))
    counted = known.mapInArrow(_document_counts, "rows binary, counts binary").toArrow()  # a row for each of FIT_TASKS
    totals, counts = np.zeros(2, np.int64), np.zeros((2, 1 << BITS), np.int64)
    for rows, held in zip(counted.column(0), counted.column(1), strict=True):
        totals += np.frombuffer(rows.as_py(), np.int64)
        counts += np.frombuffer(zlib.decompress(held.as_py()), np.int32).reshape(counts.shape)
    if not totals.all():
        return Model(bias=50.0 if totals[1] else -50.0)
    ratio, used = ratios(counts, totals)
    slot = (np.cumsum(used) - 1).astype("<i4")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [slot[ngrams(t.as_py(), used)].tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), batch.column(1)], ["slots", "y"])

    x = fit_logistic(cut(known.mapInArrow(chosen, "slots binary, y int")), ratio[used])
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x[:-1] * ratio[used]
    return Model(float(x[-1]), weights, used)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.fromiter((shipped.value.score(t.as_py()) for t in batch.column(2)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows predicted toxic; all columns as they were."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            yield batch.filter(pa.array([shipped.value.score(t.as_py()) < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
