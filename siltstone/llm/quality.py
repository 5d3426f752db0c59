"""Quality: positive-unlabelled learning by the non-negative unbiased risk.

Trusted positives are documents labelled 1; the unlabelled text is documents of
any label or none. With class prior pi and logistic loss l, the risk is

    pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)]),

minimised over linear g to a stated gradient norm. As the loss is proper,
sigmoid(g) estimates the probability of label 1. Labels of other documents are
never looked at, for pi neither: it is the best-bin estimate, the least ratio of
unlabelled to positive texts above a score of a classifier that tells these two
apart, measured on texts it was not fitted on.

Features: a text's word shapes (runs of letters, capitals, digits and each
symbol), hashed, as shares of its words; and a few shares such as words equal to
the one before. Their mean and spread are taken over all documents outside the
held-out fold; the two expectations of the risk over bounded samples.

Defined cases: null and empty texts have all features 0; without positives
every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.descent import minimise
from siltstone.llm.folds import chosen, held_out, sample, share_of

SHAPES = 512
#: The bounds of the samples that the model is fitted on; documents are picked by a hash of their ids and texts.
FIT_POSITIVES, FIT_UNLABELLED = 8_000, 16_000
THRESHOLD = 0.3
PENALTY = 1e-4
#: The risk's maximum with 0 is rounded off by half of this at most, so that it has a gradient where it begins to act.
ROUNDED = 1e-3
#: Best-bin estimate: the chance that a bound on its shares fails, and the bound's weight.
BIN_DELTA, BIN_WEIGHT = 0.1, 1.01
LEAST_PRIOR, MOST_PRIOR = 0.01, 0.99

_CLASSES = bytes(
    ord("a") if 0x61 <= b <= 0x7A or b >= 0x80 else ord("A") if 0x41 <= b <= 0x5A else ord("0") if 0x30 <= b <= 0x39 else b for b in range(256)
)
_SHARES = 8
_AT_ONCE = 1 << 22


def features(text: bytes | None) -> np.ndarray:
    """float32 of SHAPES + _SHARES values."""
    out = np.zeros(SHAPES + _SHARES, np.float32)
    words = (text or b"").split()
    if not words:
        return out
    n = len(words)
    shapes: Counter = Counter()
    classes = np.zeros(256, np.int64)
    for at in range(0, n, _AT_ONCE // 8):
        part = np.frombuffer(b" ".join(words[at : at + _AT_ONCE // 8]).translate(_CLASSES), np.uint8)
        classes += np.bincount(part, minlength=256)
        shapes.update(part[np.concatenate(([True], part[1:] != part[:-1]))].tobytes().split())
    for shape, count in shapes.items():
        out[zlib.crc32(shape) % SHAPES] += count
    out[:SHAPES] = np.sqrt(out[:SHAPES] / n)
    chars = max(1, int(classes.sum()) - (n - 1))
    letters, capitals, digits = int(classes[ord("a")]), int(classes[ord("A")]), int(classes[ord("0")])
    same = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    out[SHAPES:] = (
        math.sqrt(same / n), capitals / chars, digits / chars, (chars - letters - capitals - digits) / chars,
        math.log1p(n) / 10, math.log1p(distinct) / math.log1p(n), min(1.0, chars / n / 20), 1.0 if n < 5 else 0.0,
    )
    return out


@dataclass
class Model:
    prior: float
    bias: float
    weights: np.ndarray

    def score(self, text: bytes | None) -> float:
        z = self.bias + float(features(text).astype(np.float64) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def risk(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk of g = rows @ x[:-1] + x[-1], plus PENALTY / 2 times the weights' squares; and its gradient."""
    w, b = x[:-1].astype(np.float32), x[-1]
    gp, gu = (positive @ w + b).astype(np.float64), (unlabelled @ w + b).astype(np.float64)
    sp, su = (1 / (1 + np.exp(-np.clip(g, -500, 500))) for g in (gp, gu))
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    root = math.hypot(negative, ROUNDED)
    value, slope = prior * np.logaddexp(0, -gp).mean() + (negative + root) / 2, (1 + negative / root) / 2
    cp, cu = prior * (sp - 1 - slope * sp) / len(gp), slope * su / len(gu)
    g = np.append(positive.T @ cp.astype(np.float32) + unlabelled.T @ cu.astype(np.float32), cp.sum() + cu.sum())
    g[:-1] += PENALTY * x[:-1]
    return value + PENALTY / 2 * float(x[:-1] @ x[:-1]), g


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, by the scores of both: the least of their shares' ratios above a score, with regard to chance."""
    at = np.sort(positive)
    p = 1 - np.arange(len(at)) / len(at)
    u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    chance = np.sqrt(np.log(4 / BIN_DELTA) / 2 / len(positive)) + np.sqrt(np.log(4 / BIN_DELTA) / 2 / len(unlabelled))
    k = int(np.argmin((u + BIN_WEIGHT * chance) / p))
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, u[k] / p[k])))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Of standardised rows: every other one fits the classifier that tells the two apart, the others are scored."""
    p, u = positive[::2], unlabelled[::2]
    x, _ = minimise(lambda x: _apart(x, p, u), np.zeros(p.shape[1] + 1))
    w = x[:-1].astype(np.float32)
    return best_bin(positive[1::2] @ w, unlabelled[1::2] @ w)


def _apart(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss of telling positive rows from unlabelled ones, both kinds of equal weight; and its gradient."""
    w, b = x[:-1].astype(np.float32), x[-1]
    gp, gu = (positive @ w + b).astype(np.float64), (unlabelled @ w + b).astype(np.float64)
    cp = (1 / (1 + np.exp(-np.clip(gp, -500, 500))) - 1) / len(gp) / 2
    cu = 1 / (1 + np.exp(-np.clip(gu, -500, 500))) / len(gu) / 2
    g = np.append(positive.T @ cp.astype(np.float32) + unlabelled.T @ cu.astype(np.float32), cp.sum() + cu.sum())
    g[:-1] += PENALTY * x[:-1]
    return np.logaddexp(0, -gp).mean() / 2 + np.logaddexp(0, gu).mean() / 2 + PENALTY / 2 * float(x[:-1] @ x[:-1]), g


def fit(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, spread: np.ndarray, prior: float | None = None) -> Model:
    """The model of least risk on features standardised by mean and spread; the prior is estimated unless given."""
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 0.02), 0.0)
    p, u = (((rows - mean) * scale).astype(np.float32) for rows in (positive, unlabelled))
    if prior is None:
        prior = estimated_prior(p, u) if min(len(p), len(u)) > 1 else MOST_PRIOR
    x, _ = minimise(lambda x: risk(x, p, u, prior), np.append(np.zeros(p.shape[1]), math.log(prior / (1 - prior))))
    weights = x[:-1] * scale
    return Model(prior, float(x[-1] - mean @ weights), weights)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()).tobytes() for t in batch.column(0)], pa.binary())], ["x"])


def _matrix(texts: DataFrame) -> np.ndarray:
    rows = texts.select("text").mapInArrow(_featured, "x binary").toArrow().column(0).to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, SHAPES + _SHARES)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, squares, n = np.zeros(SHAPES + _SHARES), np.zeros(SHAPES + _SHARES), 0
    for batch in batches:
        for text in batch.column(0):
            x = features(text.as_py()).astype(np.float64)
            sums, squares, n = sums + x, squares + x * x, n + 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums), pa.array(squares), pa.array(np.full(len(sums), n))], ["slot", "x", "xx", "n"])


def moments(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the features over all texts; zero where there are none."""
    per = texts.select("text").mapInArrow(_summed, "slot int, x double, xx double, n long")
    rows = per.groupBy("slot").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.sum("n").alias("n")).orderBy("slot").toArrow()  # a row for each feature
    if not rows.num_rows or not rows.column(3)[0].as_py():
        return np.zeros(SHAPES + _SHARES), np.zeros(SHAPES + _SHARES)
    x, xx, n = (rows.column(k).to_numpy() for k in (1, 2, 3))
    return x / n, np.sqrt(np.maximum(0, xx / n - (x / n) ** 2))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    positive = _matrix(sample(docs, labels, "quality", FIT_POSITIVES, kind=1))
    if not len(positive):
        return Model(0.0, -1e6, np.zeros(SHAPES + _SHARES))
    web = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("binary").alias("text"))
    picked = chosen("web", share_of(web, FIT_UNLABELLED), F.col("doc_id"), F.xxhash64("text"))
    return fit(positive, _matrix(web.where(picked)), *moments(web))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.fromiter((shipped.value.score(t.as_py()) for t in batch.column(2)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
