"""AdaBoost with real-valued stage outputs (SAMME.R, binary) over depth-1 gini trees.

Spark has no boosting of weighted stumps, and a ``DecisionTreeClassifier`` fit per round costs
several jobs for a single split. Here a round is one pass:

* once: per-feature candidate thresholds (approximate quantiles, at most ``max_bins - 1`` per
  feature, as Spark's trees bin continuous features) and each row's bin per feature, persisted;
* per round: every task weighs its rows by exp(-lr y* F), y* in {-1, +1} and F the sum of the stage outputs
  so far, and sums the weights of each class per (feature, bin); only these sums, whose size does not depend on the
  rows, reach the driver, which adds them in the order of the tasks and takes the split of the smallest weighted
  gini impurity (ties -> lower feature, lower threshold);
* the leaves' weighted class shares p give the stage output h = (log p1 - log p0) / 2.

A table of at most ``ONE_TASK`` rows is one task's, which takes its rounds one after the other without a job for each.
Leaf shares and gini comparisons are invariant to the scale of the weights, so the weights of a round are divided by
the total of the round before. Prediction sums the stage outputs as one JVM expression on the raw feature values.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table is one task's.
ONE_TASK = 200_000
EPS = float(np.finfo(np.float64).eps)


def _h(p1: float, p0: float) -> float:
    return 0.5 * (np.log(max(p1, EPS)) - np.log(max(p0, EPS)))


class AdaBoostModel:
    """Stages are (feature index, threshold, h_left, h_right); x[j] <= threshold goes left.
    A stage with feature -1 is a single leaf (h_left everywhere)."""

    def __init__(self, stages, features_col, learning_rate):
        self.stages = stages
        self.features_col = features_col
        self.learning_rate = learning_rate

    def decision(self) -> Column:
        x = vector_to_array(F.col(self.features_col))
        total = F.lit(0.0)
        for j, t, hl, hr in self.stages:
            h = F.lit(hl) if j < 0 else F.when(x[j] <= F.lit(t), F.lit(hl)).otherwise(F.lit(hr))
            total = total + F.lit(self.learning_rate) * h
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        n = float(max(1, len(self.stages)))
        out = df.withColumn("_F", self.decision())
        return (out.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col("_F") / F.lit(n))))
                   .withColumn("prediction", (F.col("_F") > 0).cast("double")).drop("_F"))


def stump_thresholds(df: DataFrame, features_col: str = "features", max_bins: int = 256) -> list[list[float]]:
    """Sorted distinct approximate quantiles per feature (features x bins numbers)."""
    x = vector_to_array(F.col(features_col))
    qs = [i / max_bins for i in range(1, max_bins)]
    long = df.select(F.posexplode(x).alias("j", "v"))
    rows = long.groupBy("j").agg(F.percentile_approx("v", qs, 10000).alias("q")).collect()
    d = max((r["j"] for r in rows), default=-1) + 1
    out = [[] for _ in range(d)]
    for r in rows:
        out[r["j"]] = sorted(set(float(v) for v in r["q"]))
    return out


def _binned(df: DataFrame, features_col: str, thresholds: list[list[float]]) -> DataFrame:
    """(label, bins): one byte or two per feature, the number of thresholds below the value."""
    thr = [np.asarray(t, dtype=float) for t in thresholds]
    kind = _bin_kind(thresholds)

    def bin_rows(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(thr))
            bins = np.stack([np.searchsorted(t, x[:, j], side="left") for j, t in enumerate(thr)], 1).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in bins], pa.binary())], names=["label", "bins"])

    return df.select("label", vector_to_array(F.col(features_col)).alias("x")).mapInArrow(bin_rows, "label double, bins binary")


def _bin_kind(thresholds):
    return np.uint8 if max(map(len, thresholds), default=0) < 256 else np.uint16


def class_weights(parts, stages: list[tuple], sizes: list[int], learning_rate: float, shift: float) -> np.ndarray:
    """(2, bins of all features) weights of class 0 and 1 over (bins, label) parts; ``shift`` is taken from the logarithm of each weight. Stages are
    (feature, bin, h_left, h_right)."""
    out, at = np.zeros((2, sum(sizes))), np.cumsum([0, *sizes])
    for bins, y in parts:
        total = np.zeros(len(y))
        for j, b, hl, hr in stages:
            total += hl if j < 0 else np.where(bins[:, j] <= b, hl, hr)
        w = np.exp(-learning_rate * np.where(y == 1.0, total, -total) - shift)
        for j, size in enumerate(sizes):
            for c, v in enumerate((w * (1.0 - y), w * y)):
                out[c, at[j]:at[j + 1]] += np.bincount(bins[:, j], v, size)
    return out


def best_stage(sums: np.ndarray, sizes: list[int]) -> tuple[tuple, float]:
    """((feature, bin, h_left, h_right), total weight) of the smallest weighted gini; feature -1 where every row is in one bin of every feature."""
    best, total = None, float(sums[:, :sizes[0]].sum()) if sizes else 0.0
    node = lambda a, b: np.where(a + b > 0, a + b - (a * a + b * b) / np.where(a + b > 0, a + b, 1.0), 0.0)
    at = np.cumsum([0, *sizes])
    for j, size in enumerate(sizes):
        l0, l1 = np.cumsum(sums[:, at[j]:at[j] + size], 1)
        t0, t1 = l0[-1], l1[-1]
        r0, r1 = t0 - l0, t1 - l1
        eps = (t0 + t1) * 1e-12       # tiny remainders are rounding
        ok = np.flatnonzero((l0 + l1 > eps) & (r0 + r1 > eps))
        if ok.size:
            gini = (node(l0, l1) + node(r0, r1))[ok]
            b = int(ok[gini.argmin()])
            if best is None or gini.min() < best[0]:
                wl, wr = l0[b] + l1[b], r0[b] + r1[b]
                best = gini.min(), (j, b, float(_h(l1[b] / wl, l0[b] / wl)), float(_h(r1[b] / wr, r0[b] / wr))), float(t0 + t1)
    if best is not None:
        return best[1], best[2]
    t1, size = float(sums[1, :sizes[0]].sum()) if sizes else 0.0, total or 1.0
    h = float(_h(t1 / size, (total - t1) / size))
    return (-1, 0, h, h), total


def fit_adaboost(train: DataFrame, features_col: str = "features", label_col: str = "label", rounds: int = 50,
                 learning_rate: float = 1.0, checkpoint_every: int = 5, max_bins: int = 256) -> AdaBoostModel:
    """``checkpoint_every`` is accepted as before; weights are computed from the stages, so no lineage grows that would have to be cut."""
    base = train.select(features_col, F.col(label_col).cast("double").alias("label"))
    thresholds = stump_thresholds(base, features_col, max_bins)
    sizes, kind = [len(t) + 1 for t in thresholds], _bin_kind(thresholds)
    rows = _binned(base, features_col, thresholds)
    small = train.count() <= ONE_TASK
    rows = (rows.coalesce(1) if small else rows).persist(StorageLevel.MEMORY_AND_DISK)

    def parts_of(batches):
        for b in batches:
            if b.num_rows:
                yield np.frombuffer(b"".join(b.column(1).to_pylist()), kind).reshape(b.num_rows, len(sizes)), b.column(0).to_numpy(zero_copy_only=False)

    def boosted(sums_of):
        stages, shift = [], 0.0
        for _ in range(rounds):
            stage, total = best_stage(sums_of(stages, shift), sizes)
            stages.append(stage)
            shift += math.log(total) if total > 0 else 0.0
        return stages

    def row(values):
        return pa.RecordBatch.from_arrays([pa.array([np.asarray(values, float).tolist()], pa.list_(pa.float64()))], names=["v"])

    def all_rounds(batches):
        parts = list(parts_of(batches))
        yield row(np.array(boosted(lambda stages, shift: class_weights(parts, stages, sizes, learning_rate, shift))).ravel())

    def pass_over(stages, shift):
        def run(batches):
            yield row(class_weights(parts_of(batches), stages, sizes, learning_rate, shift).ravel())

        return sum((np.array(r["v"]) for r in rows.mapInArrow(run, "v array<double>").collect()), np.zeros(2 * sum(sizes))).reshape(2, -1)     # one of a task

    found = rows.mapInArrow(all_rounds, "v array<double>").collect() if small else []
    stages = np.array(found[0]["v"]).reshape(-1, 4).tolist() if found else boosted(pass_over)
    rows.unpersist()
    named = [(int(j), float(thresholds[int(j)][int(b)]) if j >= 0 else 0.0, hl, hr) for j, b, hl, hr in stages]
    return AdaBoostModel(named, features_col, learning_rate)
