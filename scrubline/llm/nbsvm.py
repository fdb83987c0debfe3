"""Text quality by naive-Bayes support vectors.

A text is the set of its hashed n-grams: words, pairs of words, and threes of bytes. Each
indicator is scaled by its class log-count ratio, the vector is brought to length one,
and a linear hinge-loss model is fitted by dual coordinate descent. Weights are
interpolated with the plain naive-Bayes weights, and margins become chances by a logistic
curve fitted to rows that the weights have not seen.

The model is fitted to at most ``sample_rows`` labelled rows, those of the least key hashes;
their keys are broadcast, so no text is shuffled to meet its label. Scoring reads every
text once.

Defined results: a null text is empty; an empty text has no n-grams and is scored by the
intercept; without labels of both classes every text has the share of label 1 (0.5 if
there are no labels); a key with several labels has the least one; null labels and null keys
are not learnt from; repeated rows get the same score; other columns take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import record, slices

#: n-grams are hashed to so many features.
FEATURE_BITS = 18

#: Bound on the labelled rows that the model is fitted to.
SAMPLE_ROWS = 12_000

#: Smoothing of the counts, cost of a wrong margin, passes, share of the fitted weights.
ALPHA, COST, PASSES, BETA = 1.0, 1.0, 15, 0.5

_BITS = np.uint64(64 - FEATURE_BITS)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(data: bytes) -> np.ndarray:
    """The sorted features of a text."""
    words = np.fromiter(map(zlib.crc32, data.split()), np.uint64)
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    threes = raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16)
    pairs = (words[:-1] * _B) ^ words[1:]
    found = np.concatenate([(words + _A) * _A, (pairs + _B) * _C, (np.unique(threes) + _C) * _B])
    return np.unique((found ^ (found >> np.uint64(29))) * _A >> _BITS).astype(np.int32)


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # of each feature
    weight: np.ndarray  # of each scaled feature
    intercept: float
    slope: float  # of the logistic curve
    shift: float

    def margin(self, found: np.ndarray) -> float:
        scaled = self.ratio[found]
        norm = float(np.sqrt(scaled @ scaled))
        return self.intercept + (float(scaled @ self.weight[found]) / norm if norm else 0.0)

    def chance(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    size = 1 << FEATURE_BITS
    sums = []
    for side in (True, False):
        chosen = [r for r, one in zip(rows, y) if one == side]
        count = ALPHA + np.bincount(np.concatenate(chosen) if chosen else [], minlength=size)
        sums.append(np.log(count / count.sum()))
    return sums[0] - sums[1]


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, seed: int = 5
) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise |w|^2 / 2 + sum cost * max(0, 1 - y (w x + b)).

    One dual variable at a time is moved to its optimum within [0, cost] (Hsieh et al., 2008).
    The intercept is the weight of a feature that every row has.
    """
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(PASSES):
        rng.shuffle(order)
        largest = 0.0
        for i in order:
            gradient = y[i] * (w[rows[i]] @ values[i] + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            move = (new - alpha[i]) * y[i]
            if move:
                w[rows[i]] += move * values[i]
                b += move
                alpha[i] = new
                largest = max(largest, abs(move))
        if largest < 1e-3:
            break
    return w, b


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the chance of label 1 by margin (Platt's targets)."""
    n1, n0 = int(y.sum()), int((~y).sum())
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        r, v = p - target, p * (1 - p)
        g = np.array([r @ margins, r.sum()])
        h = np.array([[v @ margins**2 + 1e-6, v @ margins], [v @ margins, v.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return a, b


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Fits to feature sets and labels; every fifth row is kept for the logistic curve."""
    size = 1 << FEATURE_BITS
    if y.all() or not y.any():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    curve = np.zeros(len(y), bool)
    for side in (True, False):
        curve[np.flatnonzero(y == side)[::5]] = True
    learn = np.flatnonzero(~curve)
    if y[learn].all() or not y[learn].any():
        learn = np.arange(len(y))
    chosen = [rows[i] for i in learn]
    ratio = log_count_ratio(chosen, y[learn])
    values = [ratio[r] / (np.sqrt(ratio[r] @ ratio[r]) or 1.0) for r in chosen]
    sign = np.where(y[learn], 1.0, -1.0)
    cost = np.where(sign > 0, COST * len(learn) / (2 * (sign > 0).sum()), COST * len(learn) / (2 * (sign < 0).sum()))
    w, b = dual_coordinate_descent(chosen, values, sign, cost, size)
    w = BETA * w + (1 - BETA) * np.abs(w).mean()
    model = Model(ratio, w, b, 1.0, 0.0)
    margins = np.array([model.margin(r) for r, c in zip(rows, curve) if c])
    return Model(ratio, w, b, *logistic_curve(margins, y[curve]))


def _hashed(df: DataFrame) -> DataFrame:
    """(label, found) of rows (label, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                yield record(
                    label=part.column(0), found=pa.array([features(t).tobytes() for t in texts], pa.binary())
                )

    return df.mapInArrow(work, "label int, found binary")


def fit(
    df: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", learn: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fits to the labelled rows of ``df`` (``labels``: key and label 0 or 1) for which ``learn`` holds."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if learn is not None:
        rows = rows.filter(learn)
    rows = rows.groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
    rows = rows.orderBy(F.xxhash64("_key"), "_key").limit(sample_rows)  # the bound of what is broadcast
    texts = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    found = _hashed(texts.join(F.broadcast(rows), "_key").select("_label", "_text")).toArrow()
    y = found.column(0).to_numpy() == 1
    return fit_rows([np.frombuffer(b, np.int32) for b in found.column(1).to_pylist()], y)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (chance of label 1) of every row of ``df``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                margins = np.array([model.margin(features(t)) for t in texts])
                yield record(key=part.column(0), score=model.chance(margins))

    kind = dict(df.dtypes)[key]
    return (
        df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(work, f"key {kind}, score double")
        .withColumnRenamed("key", key)
    )
