"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased and framed by blanks; its features are the distinct n-grams of `lo` to `hi` characters,
hashed into 2^bits places. Training counts in how many toxic and other texts a feature occurs, takes the
smoothed log ratio r of the two as the feature's value where it is `errors` standard errors from 0, and fits a
logistic regression with an L2 penalty on top. The fit uses at most `per_class` texts of each label, those with the smallest hash of their id (and at
most `most_features` features: bounds on the driver's memory, the same at every size; where texts average more than
`most_features` / (2 `per_class`) distinct n-grams, 8,000 or a few kB, the later ones by hash are left out); the scores are then calibrated on held-out halves to the true share of the labels.

Nulls: a null text is an empty one; a null id or label never trains; scores are given to every row. A text of
any length is scored whole. An id that is labelled twice counts as toxic if either label says so. If a class
has no rows, every score is the share of toxic labels. Only the named columns are read; other columns, also
of clashing names, do no harm. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    lo: int = 3
    hi: int = 5
    bits: int = 18
    alpha: float = 1.0
    errors: float = 2.5
    l2: float = 3e-3
    per_class: int = 2000
    most_features: int = 32_000_000
    steps: int = 100


class Features:
    """Distinct hashed n-grams of a text, in place order."""

    def __init__(self, p: Params):
        self.p, self.seen = p, np.zeros(1 << p.bits, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = c + np.uint64(1)
        shift, mult = np.uint64(64 - self.p.bits), np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, self.p.hi + 1):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
            if n >= self.p.lo:
                self.seen[((h ^ (h >> np.uint64(29))) * mult) >> shift] = True
        ids = np.flatnonzero(self.seen).astype(np.uint32)
        self.seen[ids] = False
        return ids


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    params: Params

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum(dtype=np.float64) + self.intercept)


def _logistic(value: np.ndarray, col: np.ndarray, row: np.ndarray, size: int, y: np.ndarray, weight: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by Adam on the whole batch, which gives the same result every time."""
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    g = np.empty(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=theta[col] * value, minlength=len(y)) + theta[size]
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        g[:size] = np.bincount(col, weights=e[row] * value, minlength=size) + l2 * theta[:size]
        g[size] = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.2 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return theta[:size], float(theta[size])


def _fit_once(ids: list[np.ndarray], y: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    size = 1 << p.bits
    pos, neg = np.full(size, p.alpha), np.full(size, p.alpha)
    for x, toxic in zip(ids, y > 0, strict=True):
        (pos if toxic else neg)[x] += 1
    r = np.log(pos / (y.sum() + 2 * p.alpha)) - np.log(neg / ((1 - y).sum() + 2 * p.alpha))
    r[np.abs(r) < p.errors * np.sqrt(1 / pos + 1 / neg)] = 0
    used = np.flatnonzero(r)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    at = [k[k >= 0] for k in (place[x] for x in ids)]  # few features pass, so only theirs are put side by side
    col, row = np.concatenate(at), np.repeat(np.arange(len(ids)), [len(k) for k in at])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    beta, b = _logistic(r[used][col], col, row, len(used), y, weight, p.l2, p.steps)
    w = np.zeros(size)
    w[used] = beta * r[used]
    return w, b


def fit(ids: list[np.ndarray], toxic: np.ndarray, share: float, p: Params) -> Model:
    """ids: the features of each text; share: of toxic texts among all that are labelled. Two halves are fitted
    and score each other; a logistic curve through those scores turns the margin of the whole fit into a probability."""
    share, y = min(max(share, 1e-6), 1 - 1e-6), toxic.astype(np.float64)
    prior = float(np.log(share / (1 - share)))
    half = np.arange(len(ids)) % 2 == 0
    if min((y[h] == k).sum() for h in (half, ~half) for k in (0, 1)) < 2:
        return Model(np.zeros(1 << p.bits, np.float32), prior, p)
    margin = np.zeros(len(ids))
    for h in (half, ~half):
        w, b = _fit_once([x for x, k in zip(ids, h, strict=True) if k], y[h], p)
        for i in np.flatnonzero(~h):
            margin[i] = w[ids[i]].sum() + b
    w, b = _fit_once(ids, y, p)
    unit = np.abs(margin).mean() + 1e-9
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (1 - y).sum())
    zero = np.zeros(len(ids), np.int64)
    slope, shift = _logistic(margin / unit, zero, np.arange(len(ids)), 1, y, weight, 1e-4, 400)
    slope = max(float(slope[0]), 1e-6) / unit
    return Model((w * slope).astype(np.float32), b * slope + shift, p)


def train(docs: DataFrame, labels: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", params: Params = Params()) -> Model:
    """may_train: over the id column; False or null keeps a labelled row out of everything that is learned."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isNotNull() & may_train).groupBy(id_col).agg(F.max("y").alias("y"))
    total = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") != 0, 1).otherwise(0)).alias("k")).first()
    picked = None
    for y in (0, 1):  # bounded by per_class, so it may be broadcast
        part = known.where(F.col("y") != 0 if y else F.col("y") == 0).orderBy(F.xxhash64(id_col), id_col).limit(params.per_class)
        picked = part if picked is None else picked.unionByName(part)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(params)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([make(t).tobytes() for t in part.column(1).to_pylist()], pa.binary()), part.column(2)], ["y", "ids", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).join(F.broadcast(picked), id_col).select("y", "t", F.col(id_col).alias("key"))
    # in the order of the hash until the driver has most_features of them: 4,000 texts reach it at 8,000 each, a few kB of text
    rows, held = [], 0
    for r in joined.mapInArrow(features, f"y int, ids binary, key {kind}").orderBy(F.xxhash64("key"), "key", "ids").toLocalIterator():
        held += len(r.ids) // 4
        if held > params.most_features:
            break
        rows.append(r)
    return fit([np.frombuffer(r.ids, np.uint32) for r in rows], np.array([r.y != 0 for r in rows], bool), (total.k or 0) / max(total.n, 1), params)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, score (0 to 1) and predicted (1 from 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        make = Features(m.params)
        for batch in batches:
            z = np.array([m.margin(make(t.as_py())) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())], [id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
