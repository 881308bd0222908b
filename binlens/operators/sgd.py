"""Linear models under the SGD losses that Spark lacks (D6): modified Huber and perceptron
(hinge and log map to LinearSVC / LogisticRegression, and are also available here).

Full-batch sub-gradient descent: every step each partition sums its rows' gradients with numpy
(``mapInPandas``), the partitions' vectors are added position by position in a shuffle, and one
(d + 2)-vector reaches the driver however many partitions and batches there are; the weights
(d + 1 numbers) travel back to the executors inside the next step's closure.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binlens.functions.sums import vector_sum


def _dloss(loss: str, z: np.ndarray) -> np.ndarray:
    """d loss / d margin for y*margin = z (y in {-1, +1})."""
    if loss == "hinge":
        return np.where(z < 1.0, -1.0, 0.0)
    if loss == "perceptron":
        return np.where(z <= 0.0, -1.0, 0.0)
    if loss == "log":
        return -1.0 / (1.0 + np.exp(np.clip(z, -50, 50)))
    if loss == "modified_huber":
        return np.where(z >= 1.0, 0.0, np.where(z >= -1.0, -2.0 * (1.0 - z), -4.0))
    raise ValueError(loss)


class SGDLinearModel:
    def __init__(self, coef, intercept, loss, features_col):
        self.coef, self.intercept, self.loss, self.features_col = list(map(float, coef)), float(intercept), loss, features_col

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.features_col))
        w = F.array(*[F.lit(c) for c in self.coef])
        margin = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) + F.lit(self.intercept)
        if self.loss == "modified_huber":
            score = (F.least(F.greatest(margin, F.lit(-1.0)), F.lit(1.0)) + 1.0) / 2.0
        else:
            score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        return df.withColumn("margin", margin).withColumn("score", score) \
                 .withColumn("prediction", (F.col("margin") > 0).cast("double"))


def fit_sgd(train: DataFrame, loss: str = "hinge", alpha: float = 1e-4, max_iter: int = 50, eta0: float = 0.5,
            features_col: str = "features", label_col: str = "label", tol: float = 1e-4) -> SGDLinearModel:
    data = train.select(vector_to_array(F.col(features_col)).alias("x"),
                        (F.col(label_col).cast("double") * 2.0 - 1.0).alias("y")).cache()
    n = data.count()
    d = len(data.first()["x"]) if n else 0
    w = np.zeros(d)
    b = 0.0
    prev = None
    for t in range(1, max_iter + 1):
        wb, bb = w.copy(), b

        def grads(it, wb=wb, bb=bb):
            total = np.zeros(len(wb) + 2)
            for pdf in it:
                if pdf.empty:
                    continue
                X = np.stack(pdf["x"].to_numpy())
                y = pdf["y"].to_numpy()
                z = y * (X @ wb + bb)
                g = _dloss(loss, z) * y
                total += np.concatenate([X.T @ g, [g.sum(), len(y)]])
            yield pd.DataFrame({"v": [total]})

        tot = vector_sum(data.mapInPandas(grads, "v array<double>"), d + 2)
        gw = tot[:d] / max(n, 1) + alpha * w
        gb = tot[d] / max(n, 1)
        eta = eta0 / np.sqrt(t)
        w = w - eta * gw
        b = b - eta * gb
        step = float(np.abs(eta * gw).max()) if d else 0.0
        if prev is not None and step < tol:
            break
        prev = step
    data.unpersist()
    return SGDLinearModel(w, b, loss, features_col)


def search_sgd(train: DataFrame, candidates: list[dict], folds: list[int], fold_col: str = "cv_fold", max_iter: int = 50, eta0: float = 0.5, tol: float = 1e-4,
               features_col: str = "features", label_col: str = "label") -> DataFrame:
    """(candidate, fold, split = 'test', n, ap, pp, tp, hit) of every {loss, alpha} on every fold.

    All candidate x fold models step together: one pass sums the gradients of all of them (models x (d + 2) numbers), and one
    more pass counts each model's hits on its fold. A model that has converged stays where it is.
    """
    data = train.select(vector_to_array(F.col(features_col)).alias("x"), (F.col(label_col).cast("double") * 2.0 - 1.0).alias("y"), F.col(fold_col).cast("int").alias("fold")).cache()
    jobs = [(i, f) for i in range(len(candidates)) for f in folds]
    loss, alpha = [candidates[i]["loss"] for i, _ in jobs], np.array([float(candidates[i]["alpha"]) for i, _ in jobs])
    out_fold, m = np.array([f for _, f in jobs]), len(jobs)
    first = data.first()
    d = len(first["x"]) if first else 0
    w, b, prev, live = np.zeros((m, d)), np.zeros(m), np.full(m, np.inf), np.ones(m, bool)

    def margins(pdf, w, b):
        y, inside = pdf["y"].to_numpy()[:, None], pdf["fold"].to_numpy()[:, None] != out_fold[None, :]
        x = np.stack(pdf["x"].to_numpy())
        return x, y, inside, x @ w.T + b

    for t in range(1, max_iter + 1):
        if not live.any():
            break

        def grads(it, w=w.copy(), b=b.copy()):
            total = np.zeros((m, d + 2))
            for pdf in it:
                if pdf.empty:
                    continue
                x, y, inside, z = margins(pdf, w, b)
                g = np.empty_like(z)
                for kind in set(loss):
                    at = np.array([k == kind for k in loss])
                    g[:, at] = _dloss(kind, (y * z)[:, at]) * y
                g *= inside
                total += np.column_stack([g.T @ x, g.sum(0), inside.sum(0)])
            yield pd.DataFrame({"v": [total.ravel()]})

        tot = vector_sum(data.mapInPandas(grads, "v array<double>"), m * (d + 2)).reshape(m, d + 2)
        n = np.maximum(tot[:, d + 1], 1)[:, None]
        eta = eta0 / np.sqrt(t)
        gw, gb = tot[:, :d] / n + alpha[:, None] * w, tot[:, d] / n[:, 0]
        w[live] -= eta * gw[live]
        b[live] -= eta * gb[live]
        step = np.abs(eta * gw).max(1, initial=0.0)
        live &= ~((step < tol) & np.isfinite(prev))
        prev = step

    def count(it):
        total = np.zeros((m, 5))
        for pdf in it:
            if pdf.empty:
                continue
            _, y, inside, z = margins(pdf, w, b)
            held, one, hit = ~inside, (y > 0) & np.ones_like(inside), (z > 0) == (y > 0)
            total += np.column_stack([(held & c).sum(0) for c in (True, one, z > 0, one & (z > 0), hit)])
        yield pd.DataFrame({"v": [total.ravel()]})

    got = vector_sum(data.mapInPandas(count, "v array<double>"), m * 5).reshape(m, 5).astype(int).tolist()
    data.unpersist()
    return train.sparkSession.createDataFrame([(i, f, "test", *c) for (i, f), c in zip(jobs, got)],
                                              "candidate int, fold int, split string, n long, ap long, pp long, tp long, hit long")
