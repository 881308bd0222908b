"""Second-order gradient boosting of histogram trees (D3, D4), several models side by side.

Every round grows one tree per model from gradients g = p - y and hessians h = p (1 - p): a cut's gain is
``GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)`` and must pass ``gamma``, both sides must hold ``min_child_weight`` of hessian, a leaf is
worth ``-eta G/(H+l)``, and a tree looks at ``colsample`` of the features and ``subsample`` of the rows, drawn by hashes. The models (folds of
a validation, candidates of a search) share the passes over the rows; a model that has stopped takes no more part.

Rows carry the margins of all models. The trees of the last rounds are added on the fly; every ``FOLD_IN`` rounds they are folded
into the margins by a reliable checkpoint. The error of a round is summed in the first pass of the next one. A table of at most ``trees.IN_PLACE`` rows
(and within a broadcast's limit) is sent to the executors instead, and every model is one task's, which takes its rounds one after the other. With a
validation fold a model ends when its error has not fallen for ``patience`` rounds, and keeps the trees of its best round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binlens.functions.hashing import mixed, uniform
from binlens.operators import trees
from binlens.operators.trees import FOREST, UNIT, Binned, Columns, Forest, Resident, Specs, bin_rows, descend, grow, grow_resident, sendable, sent_table
from binlens.session import cut_lineage

FOLD_IN = 10
DEFAULTS = dict(learning_rate=0.3, max_depth=11, colsample=0.8317, subsample=0.9099, min_child_weight=3.0, gamma=0.292, reg_lambda=0.447)


@dataclass
class Ensemble:
    """Trees of many rounds in one set of arrays; ``values`` are leaf weights, ``roots`` lists (root, model, round)."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    levels: int = 0

    def plus(self, f: Forest, values: np.ndarray, models: np.ndarray, number: int) -> Ensemble:
        base = len(self.feature)
        roots = np.stack([base + np.arange(f.trees), models, np.full(f.trees, number)], 1)
        return Ensemble(np.concatenate([self.feature, f.feature]), np.concatenate([self.cut, f.cut]), np.concatenate([self.left, f.left + base]),
                        np.concatenate([self.values, values]), np.concatenate([self.roots, roots]), max(self.levels, f.levels()))

    def margins(self, bins: np.ndarray, models: int) -> np.ndarray:
        """(rows, models) sums of leaf weights, tree by tree in a fixed order."""
        out = np.zeros((len(bins), models))
        if not len(self.roots) or not len(bins):
            return out
        step = max(1, (1 << 20) // len(self.roots))
        for lo in range(0, len(bins), step):
            part = bins[lo:lo + step]
            start = np.broadcast_to(self.roots[:, 0], (len(part), len(self.roots)))
            worth = self.values[descend(self.feature, self.cut, self.left, part, start, self.levels)]
            for m in range(models):
                out[lo:lo + step, m] = worth[:, self.roots[:, 1] == m].sum(1)
        return out


@dataclass
class BoostedModel:
    """``trace`` holds (round, training error, validation error or None); ``rounds`` are those kept."""

    ensemble: Ensemble
    thresholds: list[list[float]]
    rounds: int
    trace: list[tuple]
    features_col: str = "features"

    def score(self) -> Column:
        e, cuts = self.ensemble, [np.asarray(t, float) for t in self.thresholds]

        @F.pandas_udf("double")
        def scored(x):
            import pandas as pd

            if not len(x):
                return pd.Series([], dtype=float)
            m = np.stack(x.to_numpy())
            bins = np.stack([np.searchsorted(c, m[:, j], side="left") for j, c in enumerate(cuts)], 1)
            return pd.Series(1 / (1 + np.exp(-e.margins(bins, 1)[:, 0])))

        return scored(vector_to_array(F.col(self.features_col)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", self.score()).withColumn("prediction", (F.col("score") > 0.5).cast("double"))


def _kept(e: Ensemble, model: int, rounds: int) -> Ensemble:
    """The first ``rounds`` trees of one model, renumbered as model 0."""
    out = Ensemble()
    for root, m, r in e.roots.tolist():
        if m == model and r < rounds:
            # a round's trees share one block of nodes; keep those reached from the root
            nodes, queue = [], [root]
            while queue:
                nodes.append(queue.pop(0))
                if e.feature[nodes[-1]] >= 0:
                    queue += [int(e.left[nodes[-1]]), int(e.left[nodes[-1]]) + 1]
            at = np.array(nodes)
            base = len(out.feature)
            place = {n: base + i for i, n in enumerate(nodes)}
            left = [place.get(int(e.left[n]), 0) if e.feature[n] >= 0 else 0 for n in nodes]
            out = Ensemble(np.concatenate([out.feature, e.feature[at]]), np.concatenate([out.cut, e.cut[at]]), np.concatenate([out.left, np.array(left, np.int32)]),
                           np.concatenate([out.values, e.values[at]]), np.concatenate([out.roots, [[base, 0, r]]]).astype(np.int64), e.levels)
    return out


def _errors(label, fold, p, out_fold, models):
    """(number, sum of squares, rows) of each model's training (2 m) and held-out (2 m + 1) rows."""
    for i, m in enumerate(models):
        sq = np.rint((label - p[:, i]) ** 2 * UNIT).astype(np.int64)
        held = (fold == out_fold[i]) & (out_fold[i] >= 0)
        for kind, mine in ((0, ~held), (1, held)):
            yield 2 * int(m) + kind, int(sq[mine].sum()), int(mine.sum())


def fit_many(train: DataFrame, params: list[dict], rounds: int = 100, held_folds: list[int] | None = None, fold_col: str | None = None, patience: int | None = None,
             seed: int = 0, features_col: str = "features", label_col: str = "label", id_col: str = "id") -> list[BoostedModel]:
    """One model for each entry of ``params`` (``DEFAULTS`` where not given), fitted on the rows outside its entry of ``held_folds``
    (-1: on all), which are also what ``patience`` looks at."""
    params = [DEFAULTS | p for p in params]
    models = len(params)
    held = np.array(held_folds if held_folds is not None else [-1] * models)
    data = bin_rows(train, features_col, label_col, id_col, fold_col, trees=models)
    d, spark = len(data.thresholds), train.sparkSession
    if 0 < data.n <= trees.IN_PLACE and sendable(data.n, d):
        return _fit_solo(data, params, rounds, held, patience, seed, features_col)
    get = lambda k: np.array([float(p[k]) for p in params])
    eta, lam, keep = get("learning_rate"), get("reg_lambda"), get("subsample")
    zero = np.zeros(models).tobytes()
    rows = data.rows.withColumn("margins", F.lit(zero))
    total, recent = Ensemble(), Ensemble()
    live, best, low = list(range(models)), [0] * models, [np.inf] * models
    traces: list[list] = [[] for _ in range(models)]
    held_rows = rows

    def margins_of(recent_sent):
        def of(b, bins):
            stored = np.frombuffer(b"".join(b.column(b.schema.get_field_index("margins")).to_pylist()), float).reshape(b.num_rows, models)
            return stored + recent_sent.value.margins(bins, models)
        return of

    def note_totals(r, noted):
        for m in live:
            (ts, tn), (vs, vn) = noted.get(2 * m, (0, 0)), noted.get(2 * m + 1, (0, 0))
            rmse = lambda s, n: float(np.sqrt(s / UNIT / n)) if n else None
            traces[m].append((r, rmse(ts, tn), rmse(vs, vn)))
            if vn and rmse(vs, vn) < low[m]:
                low[m], best[m] = rmse(vs, vn), r

    for r in range(rounds + 1):
        if not live:
            break
        sent, now = spark.sparkContext.broadcast(recent), np.array(live)
        margins = margins_of(sent)
        out_fold = held[now]

        def probabilities(b, bins):
            return 1 / (1 + np.exp(-margins(b, bins)[:, now]))

        def notes(b, bins):
            label, fold = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("label", "fold"))
            return _errors(label, fold, probabilities(b, bins), out_fold, now)

        def newton(b, bins, r=r):
            label, rid = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("label", "rid"))
            return _sums(probabilities(b, bins), label, rid, keep[now], now, r, seed)

        part = Binned(rows, data.thresholds, data.n, data.tasks)
        if r < rounds:
            forest, noted = grow(part, _specs(params, now, out_fold, r, seed, d), newton, notes)
        else:
            noted = _notes_only(part, notes)
        if r:
            note_totals(r, noted)
            if patience is not None:
                live = [m for m in live if held[m] < 0 or r - best[m] < patience]
        if r < rounds:
            worth = _worth(forest, eta[now], lam[now])
            total, recent = total.plus(forest, worth, now, r), recent.plus(forest, worth, now, r)
        sent.unpersist()
        if len(recent.roots) and (r + 1) % FOLD_IN == 0 and live and r < rounds:
            rows = _folded(rows, recent, models, d)
            if held_rows is not data.rows:
                held_rows.unpersist()
            held_rows, recent = rows, Ensemble()
    data.release()
    held_rows.unpersist()
    out = []
    for m in range(models):
        kept = best[m] if patience is not None and held[m] >= 0 and best[m] else len(traces[m])
        out.append(BoostedModel(_kept(total, m, kept), data.thresholds, kept, traces[m], features_col))
    return out


def _round_keys(now: np.ndarray, r: int, seed: int) -> np.ndarray:
    return now.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(r + (seed << 40))


def _specs(params: list[dict], now: np.ndarray, out_fold: np.ndarray, r: int, seed: int, d: int) -> Specs:
    """The trees of a round, one for each of the models ``now``."""
    get = lambda k: np.array([float(params[m][k]) for m in now])
    return Specs.of(len(now), fold=out_fold, key=mixed(_round_keys(now, r, seed) + np.uint64(7)), per_tree=np.maximum(1, (get("colsample") * d + 1e-9).astype(int)),
                    depth=get("max_depth").astype(int), min_leaf=get("min_child_weight"), lam=get("reg_lambda"), gamma=get("gamma"))


def _sums(p: np.ndarray, label: np.ndarray, rid: np.ndarray, keep: np.ndarray, now: np.ndarray, r: int, seed: int):
    """(rows, models) hessians and gradients as integers, nought for rows that a round does not draw."""
    draw = uniform(rid.astype(np.uint64)[:, None] ^ mixed(_round_keys(now, r, seed))[None, :])
    use = draw < keep
    g = np.rint((p - label[:, None]) * UNIT).astype(np.int64) * use
    h = np.maximum(np.rint(p * (1 - p) * UNIT), 1).astype(np.int64) * use
    return h, g


def _worth(forest: Forest, eta: np.ndarray, lam: np.ndarray) -> np.ndarray:
    out = -eta[forest.tree] * (forest.b / UNIT) / (forest.a / UNIT + lam[forest.tree] + 1e-300)
    out[forest.a <= 0] = 0.0
    return out


def _fit_solo(data: Binned, params: list[dict], rounds: int, held: np.ndarray, patience: int | None, seed: int, features_col: str) -> list[BoostedModel]:
    """As ``fit_many``, each model in a task that holds the table's bins: the same sums, draws and cuts without a job for each level and round."""
    d, spark, offsets, models = len(data.thresholds), data.rows.sparkSession, data.offsets, len(params)
    sent = sent_table(data)
    data.release()

    def rounds_of(m):
        """(round, training error, validation error, forest, leaf weights) of every round; the errors are those before it."""
        bins, label, rid, fold = sent.value
        columns = Columns(bins, offsets)
        now, out_fold = np.array([m]), held[[m]]
        base, recent = np.zeros(len(bins)), np.zeros((len(bins), 0))
        best, low = 0, np.inf
        for r in range(rounds + 1):
            p = 1 / (1 + np.exp(-(base + recent.sum(1))))[:, None]
            rmse = {k: float(np.sqrt(x / UNIT / y)) if y else None for k, x, y in _errors(label, fold, p, out_fold, [0])}
            if r and rmse[1] is not None and rmse[1] < low:
                low, best = rmse[1], r
            if r == rounds or (patience is not None and held[m] >= 0 and r - best >= patience):
                yield r, rmse[0], rmse[1], None, None
                return
            h, g = (x[:, 0] for x in _sums(p, label, rid, np.array([params[m]["subsample"]], float), now, r, seed))
            at = np.flatnonzero(((h != 0) | (g != 0)) & (fold != (held[m] if held[m] >= 0 else -2)))
            specs = _specs(params, now, out_fold, r, seed, d)
            forest = grow_resident(Resident(bins, at, np.zeros(len(at), np.int64), h[at], g[at], offsets, columns), specs, True)
            worth = _worth(forest, *(np.array([float(params[m][k])]) for k in ("learning_rate", "reg_lambda")))
            leaf = descend(forest.feature, forest.cut, forest.left, bins, np.zeros((len(bins), 1), np.int32), forest.levels())[:, 0]
            recent = np.concatenate([recent, worth[leaf][:, None]], 1)
            if (r + 1) % FOLD_IN == 0:
                base, recent = base + recent.sum(1), recent[:, :0]
            yield r, rmse[0], rmse[1], forest, worth

    def run(batches):
        for batch in batches:
            for m in batch.column(0).to_pylist():
                for r, a, b, forest, worth in rounds_of(m):
                    cols = [*(getattr(forest, n) for n in FOREST), worth] if forest else [[0]] * (len(FOREST) + 1)
                    n = len(cols[0])
                    yield pa.RecordBatch.from_arrays([*[pa.array([x] * n, t) for x, t in ((m, pa.int64()), (r if forest else -1 - r, pa.int64()), (a, pa.float64()), (b, pa.float64()))],
                                                      *[pa.array(c, t) for c, t in zip(cols, _SOLO_KINDS)]], names=_SOLO_NAMES)

    schema = ", ".join(f"{n} {'double' if t == pa.float64() else 'long'}" for n, t in zip(_SOLO_NAMES, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), *_SOLO_KINDS]))
    got = spark.range(0, models, 1, models).mapInArrow(run, schema).toArrow()       # the trees
    sent.destroy()
    cols = {n: got.column(n).to_numpy() for n in _SOLO_NAMES}
    out = []
    for m in range(models):
        mine = np.flatnonzero(cols["model"] == m)
        order = mine[np.argsort(np.where(cols["round"][mine] < 0, -1 - cols["round"][mine], cols["round"][mine]), kind="stable")]
        number = cols["round"][order]
        first = np.flatnonzero(np.diff(number, prepend=-1 << 40))
        trace, total = [], Ensemble()
        best, low = 0, np.inf
        for lo, hi in zip(first, [*first[1:], len(order)]):
            at = order[lo:hi]
            r = int(number[lo]) if number[lo] >= 0 else -1 - int(number[lo])
            a, b = (None if np.isnan(x) else float(x) for x in (cols["train_error"][at[0]], cols["held_error"][at[0]]))
            if r:
                trace.append((r, a, b))
                if b is not None and b < low:
                    low, best = b, r
            if number[lo] >= 0:
                forest = Forest(1).grown(**{n: cols[n][at] for n in FOREST})
                total = total.plus(forest, cols["worth"][at], np.array([0]), r)
        kept = best if patience is not None and held[m] >= 0 and best else len(trace)
        out.append(BoostedModel(_kept(total, 0, kept), data.thresholds, kept, trace, features_col))
    return out


_SOLO_KINDS = [pa.float64() if n == "gain" else pa.int64() for n in FOREST] + [pa.float64()]
_SOLO_NAMES = ["model", "round", "train_error", "held_error", *FOREST, "worth"]


def _notes_only(data: Binned, notes) -> dict:
    d = len(data.thresholds)

    def run(batches):
        got = {}
        for b in batches:
            bins = np.frombuffer(b"".join(b.column(b.schema.get_field_index("bins")).to_pylist()), np.uint8).reshape(b.num_rows, d)
            for t, x, y in notes(b, bins):
                p = got.get(t, (0, 0))
                got[t] = (p[0] + x, p[1] + y)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), *[pa.array([v[i] for v in got.values()], pa.int64()) for i in (0, 1)]], names=["t", "x", "y"])

    return {r["t"]: (r["x"], r["y"]) for r in data.rows.mapInArrow(run, "t long, x long, y long").groupBy("t").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}


def _folded(rows: DataFrame, recent: Ensemble, models: int, d: int) -> DataFrame:
    """The rows with the recent trees' worth in their margins, checkpointed."""
    sent = rows.sparkSession.sparkContext.broadcast(recent)

    def run(batches):
        for b in batches:
            names = b.schema.names
            bins = np.frombuffer(b"".join(b.column(names.index("bins")).to_pylist()), np.uint8).reshape(b.num_rows, d)
            m = np.frombuffer(b"".join(b.column(names.index("margins")).to_pylist()), float).reshape(b.num_rows, models) + sent.value.margins(bins, models)
            cols = [c for c, n in zip(b.columns, names) if n != "margins"] + [pa.array([x.tobytes() for x in m], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n in names if n != "margins"] + ["margins"])

    cols = [c for c in rows.columns if c != "margins"] + ["margins"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in cols)
    out = cut_lineage(rows.mapInArrow(run, schema)).persist(StorageLevel.MEMORY_AND_DISK)
    sent.unpersist()
    return out


def fit_boosted(train: DataFrame, rounds: int = 100, held_fold: int = -1, fold_col: str | None = None, patience: int | None = None, seed: int = 0, features_col: str = "features",
                label_col: str = "label", id_col: str = "id", **params) -> BoostedModel:
    return fit_many(train, [params], rounds, [held_fold], fold_col, patience, seed, features_col, label_col, id_col)[0]
