"""A feed-forward network with ReLU units, L2 penalty and Adam (D9), trained on distributed rows.

One pass is one epoch. Every task starts from the current weights and moments, takes Adam steps over mini-batches of its own rows,
and yields its weights and moments times its rows; the sums over tasks, divided by the rows, start the next epoch
(parameter averaging). Only vectors of the network's size travel. A table of at most ``ONE_TASK`` rows (and, beyond ``FEW`` rows, of a broadcast's size) is one task's, which then
takes its epochs one after the other in one pass: without other tasks there is nothing to average in between. Training ends after
``patience`` epochs whose loss has not fallen by ``tol``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binlens.functions.sizing import MAX_BROADCAST_BYTES
from binlens.functions.sums import vector_sum

#: Rows up to which a table is one task's.
ONE_TASK = 200_000
#: Rows up to which the width of the table does not count.
FEW = 20_000


class Shape:
    """Layer sizes, and the places of weights and biases in one flat vector."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.parts, at = [], 0
        for a, b in zip(sizes, sizes[1:]):
            self.parts.append((at, at + a * b, at + a * b + b, a, b))
            at += a * b + b
        self.total = at

    def layers(self, w: np.ndarray):
        return [(w[i:j].reshape(a, b), w[j:k]) for i, j, k, a, b in self.parts]

    def start(self, seed: int) -> np.ndarray:
        """Uniform within sqrt(6 / (fan in + fan out)); the last layer within sqrt(2 / ...)."""
        rng, out = np.random.default_rng(seed), np.zeros(self.total)
        for n, (i, _, k, a, b) in enumerate(self.parts):
            r = math.sqrt((6 if n < len(self.parts) - 1 else 2) / (a + b))
            out[i:k] = rng.uniform(-r, r, k - i)
        return out

    def margins(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        h, layers = x, self.layers(w)
        for n, (m, b) in enumerate(layers):
            h = h @ m + b
            if n < len(layers) - 1:
                h = np.maximum(h, 0)
        return h[:, 0]

    def loss_and_gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
        """Mean log loss of the batch plus alpha / 2 of the squared weights (not biases) over its rows."""
        layers, acts = self.layers(w), [x]
        for n, (m, b) in enumerate(layers):
            z = acts[-1] @ m + b
            acts.append(np.maximum(z, 0) if n < len(layers) - 1 else z)
        z, rows = acts[-1][:, 0], len(x)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss = float(np.mean(np.logaddexp(0, z) - y * z)) + 0.5 * alpha * sum(float((m * m).sum()) for m, _ in layers) / rows
        grad, d = np.zeros_like(w), ((p - y) / rows)[:, None]
        for n in range(len(layers) - 1, -1, -1):
            i, j, k, _, _ = self.parts[n]
            m = layers[n][0]
            grad[i:j] = (acts[n].T @ d + alpha * m / rows).ravel()
            grad[j:k] = d.sum(0)
            if n:
                d = (d @ m.T) * (acts[n] > 0)
        return loss, grad


class NetworkModel:
    def __init__(self, sizes: list[int], weights: np.ndarray, features_col: str = "features", epochs: int = 0, losses: list[float] | None = None):
        self.sizes, self.weights, self.features_col, self.epochs, self.losses = sizes, np.asarray(weights, float), features_col, epochs, losses or []

    def score(self) -> Column:
        shape, w = Shape(self.sizes), self.weights

        @F.pandas_udf("double")
        def scored(x):
            import pandas as pd

            return pd.Series(1 / (1 + np.exp(-shape.margins(w, np.stack(x.to_numpy())))) if len(x) else [], dtype=float)

        return scored(vector_to_array(F.col(self.features_col)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", self.score()).withColumn("prediction", (F.col("score") > 0.5).cast("double"))


def adam_epoch(shape: Shape, state: tuple, x: np.ndarray, y: np.ndarray, alpha: float, batch: int, rate: float, rng) -> tuple[tuple, float]:
    """One pass over the rows in random order; (weights, moments, squares, steps) and the summed loss."""
    w, m, v, t = state
    order, total = rng.permutation(len(x)), 0.0
    for lo in range(0, len(x), batch):
        at = order[lo:lo + batch]
        loss, g = shape.loss_and_gradient(w, x[at], y[at], alpha)
        total += loss * len(at)
        t += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
    return (w, m, v, t), total


def fit_network(train: DataFrame, hidden: tuple[int, ...] = (100,), alpha: float = 1e-4, max_iter: int = 200, tol: float = 1e-4, patience: int = 10, batch: int = 200,
                rate: float = 1e-3, seed: int = 1, features_col: str = "features", label_col: str = "label") -> NetworkModel:
    data = train.select(vector_to_array(F.col(features_col)).alias("x"), F.col(label_col).cast("double").alias("y"))
    first, n = data.first(), train.count()
    shape = Shape([len(first["x"]) if first else 0, *hidden, 1])
    alone = n <= ONE_TASK and (n <= FEW or n * shape.sizes[0] * 8 <= MAX_BROADCAST_BYTES)
    if alone:
        data = data.coalesce(1)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    k, spark = shape.total, train.sparkSession
    state, losses = (shape.start(seed), np.zeros(k), np.zeros(k), 0), []

    def epoch_of(parts, state, epoch):
        """(state, rows, loss) after one epoch over a task's parts."""
        rows = loss = 0
        for part, (x, y) in enumerate(parts):
            state, more = adam_epoch(shape, state, x, y, alpha, min(batch, len(x)), rate, np.random.default_rng([seed, epoch, part]))
            rows, loss = rows + len(x), loss + more
        return state, rows, loss

    def parts_of(batches):
        for b in batches:
            if b.num_rows:
                yield b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, shape.sizes[0]), b.column(1).to_numpy(zero_copy_only=False)

    def row(values):
        return pa.RecordBatch.from_arrays([pa.array([np.asarray(values).tolist()], pa.list_(pa.float64()))], names=["v"])

    if alone and n:
        def run(batches, state=state):
            parts, losses = list(parts_of(batches)), []
            while not _ended(losses, max_iter, tol, patience):
                state, rows, loss = epoch_of(parts, state, len(losses))
                losses.append(loss / rows)
            yield row([*state[0], *losses])

        got = data.mapInArrow(run, "v array<double>").collect()[0]["v"]
        state, losses = (np.array(got[:k]), *state[1:]), list(got[k:])
    while not alone and not _ended(losses, max_iter, tol, patience):
        sent, epoch = spark.sparkContext.broadcast(state), len(losses)

        def step(batches, sent=sent, epoch=epoch):
            state, rows, loss = epoch_of(parts_of(batches), sent.value, epoch)
            if rows:
                yield row(np.concatenate([*(rows * s for s in state[:3]), [rows * state[3], loss, rows]]))

        got = vector_sum(data.mapInArrow(step, "v array<double>"), 3 * k + 3)
        sent.unpersist()
        rows = got[-1]
        state = got[:k] / rows, got[k:2 * k] / rows, got[2 * k:3 * k] / rows, int(round(got[-3] / rows))
        losses.append(got[-2] / rows)
    data.unpersist()
    return NetworkModel(shape.sizes, state[0], features_col, len(losses), losses)


def _ended(losses: list[float], max_iter: int, tol: float, patience: int) -> bool:
    """After ``max_iter`` epochs, or ``patience`` in a row that did not beat the best before them by ``tol``."""
    best, stale = np.inf, 0
    for v in losses:
        stale = 0 if v < best - tol else stale + 1
        best = min(best, v)
    return len(losses) >= max_iter or stale >= patience
