"""Model selection over fold columns.

A search ends in rows of counts (candidate, fold, split, n, ap, pp, tp, hit), from which every metric follows. Trees, forests,
boosted trees and linear models are fitted many at a time (``trees.search_forests``, ``newton.fit_many``, ``sgd.search_sgd``); other
models run one fit per (candidate, fold) from a thread pool. ``adaptive_rounds`` proposes its candidates itself, in batches.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binlens.operators.roster import Fitted
from binlens.operators.trees import count_metrics


def _tp(c):
    return F.sum(((F.col("label") == c) & (F.col("prediction") == c)).cast("double"))


def metric_columns(classes=(0, 1)) -> dict[str, Column]:
    """Accuracy, class-1 precision / recall and the macro recall / f1 (0/0 -> 0) as aggregates."""
    out = {"accuracy": F.avg((F.col("label") == F.col("prediction")).cast("double"))}

    def safe(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    prec, rec, f1 = {}, {}, {}
    for c in classes:
        pp = F.sum((F.col("prediction") == c).cast("double"))
        ap = F.sum((F.col("label") == c).cast("double"))
        prec[c], rec[c] = safe(_tp(c), pp), safe(_tp(c), ap)
        f1[c] = safe(2 * prec[c] * rec[c], prec[c] + rec[c])
    out["precision"] = prec[classes[-1]]
    out["recall"] = rec[classes[-1]]
    out["recall_macro"] = sum(rec.values()) / F.lit(float(len(classes)))
    out["f1_macro"] = sum(f1.values()) / F.lit(float(len(classes)))
    return out


COUNTED = "candidate int, fold int, split string, n long, ap long, pp long, tp long, hit long"


def counted(scored: DataFrame) -> tuple:
    """(rows, actual positives, predicted positives, both, hits) of a scored frame: one aggregate, one row."""
    one, pred = (F.col("label") == 1).cast("long"), (F.col("prediction") == 1).cast("long")
    cols = (F.count(F.lit(1)), F.sum(one), F.sum(pred), F.sum(one * pred), F.sum((F.col("label") == F.col("prediction")).cast("long")))
    return tuple(int(v or 0) for v in scored.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def run_folds(train: DataFrame, candidates: list[tuple[int, dict, Callable[[DataFrame], Fitted]]], folds: list[int],
              fold_col: str = "cv_fold", score_train: bool = False, parallelism: int = 8,
              subset: Callable[[DataFrame, int, dict], DataFrame] | None = None,
              fold_aware: bool = False) -> DataFrame:
    """Fit every (candidate, fold) pair on the rows outside the fold; score the fold
    (split = 'test') and optionally the fitted rows (split = 'train').

    ``subset`` narrows a fold's training rows (learning curves); with ``fold_aware`` the builder
    is called as ``build(rows, fold)`` (selectors refitted per fold).
    Returns (candidate, fold, split, n, ap, pp, tp, hit): a fit ends as one row of counts in its thread, so no
    plan grows with the number of fits."""
    def one(job):
        (cid, params, build), f = job
        tr = train.filter(F.col(fold_col) != f)
        if subset is not None:
            tr = subset(tr, f, params)
        m = build(tr, f) if fold_aware else build(tr)
        parts = {"test": train.filter(F.col(fold_col) == f)} | ({"train": tr} if score_train else {})
        return [(cid, f, split, *counted(m.score(rows))) for split, rows in parts.items()]

    jobs = list(itertools.product(candidates, folds))
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = [r for rs in pool.map(one, jobs) for r in rs]
    return train.sparkSession.createDataFrame(rows, COUNTED)


def fold_metrics(counts: DataFrame, metrics: list[str]) -> DataFrame:
    """(candidate, fold, split, <metric>...) from the counts."""
    cols = count_metrics()
    return counts.select("candidate", "fold", "split", *[cols[m].alias(m) for m in metrics])


def summarise(per_fold: DataFrame, metrics: list[str], params: DataFrame | None = None) -> DataFrame:
    """(candidate, split, metric, mean, std) with the population std over folds (as numpy)."""
    long = per_fold.select("candidate", "fold", "split", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("mv"))
    s = long.groupBy("candidate", "split", F.col("mv.metric").alias("metric")).agg(
        F.avg("mv.value").alias("mean"), F.stddev_pop("mv.value").alias("std"))
    return s if params is None else s.join(F.broadcast(params), "candidate")


def params_frame(spark, candidates) -> DataFrame:
    """(candidate, params) with the parameters as sorted JSON text."""
    return spark.createDataFrame([(cid, json.dumps(p, sort_keys=True)) for cid, p, _ in candidates],
                                 "candidate int, params string")


def grid(space: dict[str, list]) -> list[dict]:
    keys = sorted(space)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]


def sample_grid(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """``n`` distinct grid points drawn without replacement (the whole grid when it is smaller)."""
    g = grid(space)
    if n >= len(g):
        return g
    idx = np.random.RandomState(seed).choice(len(g), size=n, replace=False)
    return [g[i] for i in sorted(idx)]


def sample_space(space: dict[str, tuple], n: int, seed: int) -> list[dict]:
    """Seeded draws from continuous / discrete spaces: ('uniform', lo, hi), ('quniform', lo,
    hi, q) and ('choice', [values])."""
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(n):
        p = {}
        for k in sorted(space):
            spec = space[k]
            if spec[0] == "uniform":
                p[k] = float(rng.uniform(spec[1], spec[2]))
            elif spec[0] == "quniform":
                q = spec[3]
                p[k] = float(round(rng.uniform(spec[1], spec[2]) / q) * q)
            elif spec[0] == "choice":
                p[k] = spec[1][rng.randint(len(spec[1]))]
            else:
                raise ValueError(spec[0])
        out.append(p)
    return out


def min_leaf_rows(value, n_rows: int) -> int:
    """Fractional ``min_samples_leaf`` -> ceil(f * n) rows; integers pass through."""
    if isinstance(value, float) and value < 1.0:
        return max(1, math.ceil(value * n_rows))
    return int(value)


# ---------------------------------------------------------------- adaptive search

def _unit(spec: tuple, value) -> float:
    """A value's place in [0, 1) of its range; choices are numbered."""
    if spec[0] == "choice":
        return (spec[1].index(value) + 0.5) / len(spec[1])
    return (value - spec[1]) / (spec[2] - spec[1])


def _value(spec: tuple, u: float):
    if spec[0] == "choice":
        return spec[1][min(int(u * len(spec[1])), len(spec[1]) - 1)]
    v = spec[1] + u * (spec[2] - spec[1])
    return float(round(v / spec[3]) * spec[3]) if spec[0] == "quniform" else float(v)


class _Density:
    """Density of one parameter over the unit range, from the places of some trials, with one uniform pseudo-trial: a mixture
    of normals cut at the ends, each as wide as the gap to its neighbours; for choices, shares."""

    def __init__(self, spec: tuple, places: list[float]):
        self.spec, self.at = spec, np.sort(np.array(places))
        if spec[0] == "choice":
            k = len(spec[1])
            n = np.bincount((self.at * k).astype(int), minlength=k) + 1.0
            self.share = n / n.sum()
            return
        edges = np.concatenate([[0.0], self.at, [1.0]])
        self.width = np.clip(np.maximum(np.diff(edges)[:-1], np.diff(edges)[1:]), 1.0 / (1 + len(self.at)) / 4, 0.5) if len(self.at) else np.zeros(0)

    def draw(self, rng) -> float:
        if self.spec[0] == "choice":
            return (rng.choice(len(self.share), p=self.share) + 0.5) / len(self.share)
        i = rng.randint(len(self.at) + 1)
        if i == len(self.at):
            return rng.uniform()
        while True:
            u = rng.normal(self.at[i], self.width[i])
            if 0 <= u < 1:
                return u

    def log(self, u: float) -> float:
        if self.spec[0] == "choice":
            return math.log(self.share[min(int(u * len(self.share)), len(self.share) - 1)])
        total = 1.0
        for m, s in zip(self.at, self.width):
            inside = 0.5 * (math.erf((1 - m) / s / math.sqrt(2)) - math.erf(-m / s / math.sqrt(2)))
            total += math.exp(-0.5 * ((u - m) / s) ** 2) / (s * math.sqrt(2 * math.pi) * inside)
        return math.log(total / (len(self.at) + 1))


def adaptive_rounds(space: dict[str, tuple], score: Callable[[list[dict]], list[float]], trials: int, batch: int = 10, seed: int = 0, good: float = 0.15,
                    draws: int = 8) -> list[tuple[dict, float]]:
    """(params, value) of ``trials`` trials of ``space`` (as ``sample_space``), in order; larger values are better.

    The first batch is drawn from the space. Each later one compares, parameter by parameter, the density of the best ``good`` share of the trials so far
    with that of the others, draws ``draws`` points a trial from the first and takes the one whose ratio of densities is largest. ``score`` gets a whole batch, so that
    its fits can share their passes over the data.
    """
    rng = np.random.RandomState(seed)
    done: list[tuple[dict, float]] = []
    names = sorted(space)
    while len(done) < trials:
        size = min(batch, trials - len(done))
        if not done:
            todo = sample_space(space, size, seed)
        else:
            ranked = sorted(done, key=lambda t: -t[1])
            cut = max(1, math.ceil(good * len(ranked)))
            best, rest = ({n: _Density(space[n], [_unit(space[n], p[n]) for p, _ in part]) for n in names} for part in (ranked[:cut], ranked[cut:]))
            todo, seen = [], {str(p) for p, _ in done}
            for _ in range(size):
                points = [{n: best[n].draw(rng) for n in names} for _ in range(draws)]
                points.sort(key=lambda u: -sum(best[n].log(u[n]) - rest[n].log(u[n]) for n in names))
                made = [{n: _value(space[n], u[n]) for n in names} for u in points]
                todo.append(next((p for p in made if str(p) not in seen), made[0]))     # a point not tried yet, if any
                seen.add(str(todo[-1]))
        done += list(zip(todo, score(todo)))
    return done
