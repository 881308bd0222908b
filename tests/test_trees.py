"""Level-wise trees equal a recursive grower on the same bins (D1, D2); candidates cut back from shared trees equal their own
fits (F3, F5, F9); second-order boosting equals a plain numpy booster and stops by its patience (D3, D4)."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from binlens.operators import newton as N
from binlens.operators import trees as T


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.RandomState(1)
    x = np.column_stack([rng.normal(0, 1, 260), rng.randint(0, 4, 260), rng.rand(260) < 0.3, rng.normal(0, 1, 260).round(1)]).astype(float)
    y = ((x[:, 0] + 0.6 * x[:, 1] * (x[:, 3] > 0) + rng.normal(0, 0.7, 260)) > 0.8).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), i % 4, Vectors.dense(x[i].tolist())) for i in range(260)], ["id", "label", "cv_fold", "features"]).cache()
    return df, x, y


def bins_of(x, thresholds):
    return np.stack([np.searchsorted(np.array(t, float), x[:, j], side="left") for j, t in enumerate(thresholds)], 1)


def gini(y):
    return len(y) * 2 * y.mean() * (1 - y.mean()) if len(y) else 0.0


def recursive(b, y, depth, min_split, min_leaf, level=0):
    """(n, ones) of a leaf, or (feature, bin, left, right); first best cut in feature, bin order."""
    if level < depth and len(y) >= min_split and 0 < y.sum() < len(y):
        best = None
        for f in range(b.shape[1]):
            for c in sorted(set(b[:, f].tolist()))[:-1]:
                left = b[:, f] <= c
                if left.sum() >= min_leaf and (~left).sum() >= min_leaf:
                    gain = round(gini(y) - gini(y[left]) - gini(y[~left]), 9)
                    if best is None or gain > best[0]:
                        best = gain, f, c, left
        if best:
            _, f, c, left = best
            return f, c, recursive(b[left], y[left], depth, min_split, min_leaf, level + 1), recursive(b[~left], y[~left], depth, min_split, min_leaf, level + 1)
    return len(y), int(y.sum())


def nested(forest, node):
    f = int(forest.feature[node])
    if f < 0:
        return int(forest.a[node]), int(forest.b[node])
    return f, int(forest.cut[node]), nested(forest, int(forest.left[node])), nested(forest, int(forest.left[node]) + 1)


@pytest.mark.parametrize("in_place", [0, 20_000], ids=["shuffled", "in place"])
@pytest.mark.parametrize("depth,min_split,min_leaf", [(5, 2, 1), (9, 40, 1), (9, 0.2, 3), (4, 2, 0.1)])
def test_tree_equals_recursion(table, monkeypatch, in_place, depth, min_split, min_leaf):
    monkeypatch.setattr(T, "IN_PLACE", in_place or 40)
    df, x, y = table
    model = T.fit_forest(df, max_depth=depth, min_samples_split=min_split, min_samples_leaf=min_leaf)
    want = recursive(bins_of(x, model.thresholds), y, depth, T.split_rows(min_split, 260), T.rows_of(min_leaf, 260))
    assert nested(model.forest, 0) == want


def test_ignored_settings_are_not_ignored(table):
    df, _, _ = table
    sizes = [len(T.fit_forest(df, max_depth=9, min_samples_split=s).forest.feature) for s in (2, 30, 120, 1.0)]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4 and sizes[-1] == 3


def test_both_plans_grow_one_forest(table, monkeypatch):
    df, _, _ = table
    kw = dict(n_estimators=7, max_depth=6, max_features=2, bootstrap_rows=True, seed=3)
    here = T.fit_forest(df, **kw).forest
    monkeypatch.setattr(T, "IN_PLACE", 100)
    monkeypatch.setattr(T, "CELLS", 64)         # many sends and merges
    there = T.fit_forest(df, **kw).forest
    assert [nested(here, t) for t in range(7)] == [nested(there, t) for t in range(7)]
    assert len({str(nested(here, t)) for t in range(7)}) == 7


def test_bootstrap_weights_are_poisson():
    w = T.bootstrap(np.arange(200_000), np.array([-1, 0, 1, 0]))
    assert (w[:, 0] == 1).all() and (w[:, 1] == w[:, 3]).all() and abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.01
    assert abs(w[:, 1].mean() - 1) < 0.01 and abs(w[:, 1].var() - 1) < 0.02 and abs((w[:, 1] == 0).mean() - math.exp(-1)) < 0.005


@pytest.mark.parametrize("budget", [8_000_000, 2_000])
def test_shared_trees_equal_own_fits(spark, table, monkeypatch, budget):
    monkeypatch.setattr(T, "NODE_BUDGET", budget)
    df, x, y = table
    cands = [dict(n_estimators=n, max_depth=d, max_features=m, min_samples_split=s, min_samples_leaf=leaf, criterion=c)
             for n, d, m, s, leaf, c in [(1, 2, 2, 2, 1, "gini"), (3, 8, 2, 2, 1, "gini"), (3, 8, 2, 0.2, 1, "gini"), (5, 3, 4, 25, 0.1, "entropy"), (5, 8, 4, 2, 0.1, "entropy")]]
    got = {(r.candidate, r.fold, r.split): r for r in T.search_forests(df, cands, [0, 2], ["accuracy", "precision", "recall", "recall_macro", "f1_macro"], seed=1).collect()}
    assert len(got) == len(cands) * 2 * 2
    thresholds = None
    for i, p in enumerate(cands):
        for fold in (0, 2):
            if thresholds is None:
                thresholds = T.stump_thresholds(df, "features", 256)
            data = T.bin_rows(df, fold_col="cv_fold", thresholds=thresholds)
            inside = np.arange(260) % 4 != fold
            n, k = int(inside.sum()), p["n_estimators"]
            specs = T.Specs.of(k, fold=fold, sample=np.arange(k) + 1000, key=T.mixed(np.arange(k) + 1000), per_node=p["max_features"], depth=p["max_depth"],
                               min_split=T.split_rows(p["min_samples_split"], n), min_leaf=T.rows_of(p["min_samples_leaf"], n), entropy=p["criterion"] == "entropy")
            forest, _ = T.grow(data, specs)
            leaf = T.descend(forest.feature, forest.cut, forest.left, bins_of(x, thresholds), np.tile(np.arange(k), (260, 1)), 20)
            pred = ((forest.b / np.maximum(forest.a, 1))[leaf].mean(1) > 0.5 + 1e-12).astype(int)
            for split, mine in (("test", ~inside), ("train", inside)):
                a, q = y[mine], pred[mine]
                r = got[i, fold, split]
                tp, pp, ap = int((a & q).sum()), int(q.sum()), int(a.sum())
                tn, pn, an = int(((1 - a) & (1 - q)).sum()), int((1 - q).sum()), int((1 - a).sum())
                safe = lambda u, v: u / v if v else 0.0
                f1 = lambda u, v: safe(2 * u * v, u + v)
                want = [(a == q).mean(), safe(tp, pp), safe(tp, ap), (safe(tp, ap) + safe(tn, an)) / 2, (f1(safe(tp, pp), safe(tp, ap)) + f1(safe(tn, pn), safe(tn, an))) / 2]
                assert [r.accuracy, r.precision, r.recall, r.recall_macro, r.f1_macro] == pytest.approx(want)


def test_sent_table_and_passes_count_alike(table, monkeypatch):
    df, _, _ = table
    cands = [dict(n_estimators=n, max_depth=d, max_features=m, min_samples_split=s, min_samples_leaf=leaf, criterion=c)
             for n, d, m, s, leaf, c in [(1, 3, 2, 2, 1, "gini"), (4, 9, 2, 0.1, 1, "gini"), (6, 9, 4, 5, 0.05, "entropy"), (6, 2, "auto", 5, 3, "gini")]]

    def got():
        return sorted(map(tuple, T.search_forests(df, cands, [0, 1, 3], ["accuracy", "precision", "recall_macro"]).collect()))

    monkeypatch.setattr(T, "ROOM", 500)         # two trees in a bundle
    sent = got()
    monkeypatch.setattr(T, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(T, "_dealt_counts", None)
    assert got() == sent and len(sent) == len(cands) * 3 * 2


@pytest.mark.parametrize("below", [10, 60, 1000])
def test_finished_subtrees_equal_level_passes(table, monkeypatch, below):
    df, _, _ = table
    monkeypatch.setattr(T, "IN_PLACE", 60)
    params = [dict(max_depth=7, min_child_weight=0.5, gamma=0.0), dict(max_depth=4, colsample=0.5)]

    def fits():
        return [[nested_weights(m.ensemble, int(r[0])) for r in m.ensemble.roots] for m in N.fit_many(df, params, 3, [1, -1], "cv_fold")]

    monkeypatch.setattr(T, "FINISH", 0)
    want = fits()
    monkeypatch.setattr(T, "FINISH", below)
    calls, finish = [], T.finished
    monkeypatch.setattr(T, "finished", lambda *a: calls.append(len(a[4])) or finish(*a))
    assert fits() == want and calls


def nested_weights(e, node):
    f = int(e.feature[node])
    return float(e.values[node]) if f < 0 else (f, int(e.cut[node]), nested_weights(e, int(e.left[node])), nested_weights(e, int(e.left[node]) + 1))


def test_node_rows_walk_to_the_scores(spark, table):
    df, x, _ = table
    model = T.fit_forest(df, n_estimators=3, max_depth=5, max_features=2, bootstrap_rows=True)
    nodes = {(r[0], r[1]): r for r in model.node_rows()}
    got = {r.id: r.score for r in model.transform(df).collect()}
    for i in range(260):
        total = 0.0
        for t in range(3):
            r = nodes[t, 0]
            while r[3] is not None:
                r = nodes[t, r[5] if x[i, r[3]] <= r[4] else r[6]]
            total += r[10]
        assert got[i] == pytest.approx(total / 3)
    assert model.importances().sum() == pytest.approx(1)


def test_no_rows_and_one_class(spark, table):
    df, _, _ = table
    one = T.fit_forest(df.where("label = 1"))
    assert len(one.forest.feature) == 1 and one.transform(df).where("prediction <> 1").count() == 0


# ---------------------------------------------------------------- boosting

def booster(b, y, rounds, eta, depth, mcw, gamma, lam, fit, per_tree=None):
    """Margins after every round, plainly."""
    margin, out = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * T.UNIT) / T.UNIT, np.rint(p * (1 - p) * T.UNIT) / T.UNIT
        step = np.zeros(len(y))

        def score(at):
            return g[at].sum() ** 2 / (h[at].sum() + lam)

        def cut(at, everyone, level):
            best = None
            if level < depth:
                for f in range(b.shape[1]):
                    for c in sorted(set(b[at, f].tolist()))[:-1]:
                        left, right = at[b[at, f] <= c], at[b[at, f] > c]
                        if min(h[left].sum(), h[right].sum()) >= mcw:
                            gain = score(left) + score(right) - score(at)
                            if gain > max(gamma, 1e-9) and (best is None or gain > best[0] + 1e-12):
                                best = gain, f, c
            if best is None:
                step[everyone] = -eta * g[at].sum() / (h[at].sum() + lam)
                return
            _, f, c = best
            cut(at[b[at, f] <= c], everyone[b[everyone, f] <= c], level + 1)
            cut(at[b[at, f] > c], everyone[b[everyone, f] > c], level + 1)

        cut(np.flatnonzero(fit), np.arange(len(y)), 0)
        margin = margin + step
        out.append(margin)
    return out


@pytest.mark.parametrize("in_place", [40, 20_000], ids=["shuffled", "in place"])
def test_boosting_equals_numpy(spark, table, monkeypatch, in_place):
    monkeypatch.setattr(T, "IN_PLACE", in_place)
    monkeypatch.setattr(N, "FOLD_IN", 3)
    df, x, y = table
    p = dict(learning_rate=0.3, max_depth=4, colsample=1.0, subsample=1.0, min_child_weight=2.0, gamma=0.2, reg_lambda=0.5)
    m = N.fit_boosted(df, rounds=7, held_fold=1, fold_col="cv_fold", **p)
    fit = np.arange(260) % 4 != 1
    margins = booster(bins_of(x, m.thresholds), y, 7, 0.3, 4, 2.0, 0.2, 0.5, fit)
    got = {r.id: r.score for r in m.transform(df).collect()}
    assert [got[i] for i in range(260)] == pytest.approx((1 / (1 + np.exp(-margins[-1]))).tolist(), abs=1e-6)
    for (r, tr, va), z in zip(m.trace, margins):
        sq = (y - 1 / (1 + np.exp(-z))) ** 2
        assert (tr, va) == (pytest.approx(np.sqrt(sq[fit].mean()), abs=1e-6), pytest.approx(np.sqrt(sq[~fit].mean()), abs=1e-6))
    assert [r for r, _, _ in m.trace] == list(range(1, 8)) and m.rounds == 7


def test_patience_keeps_the_best_round(table):
    df, _, y = table
    m = N.fit_boosted(df, rounds=300, held_fold=0, fold_col="cv_fold", patience=10, learning_rate=0.5)
    errors = [e for _, _, e in m.trace]
    assert 1 < m.rounds < 300 and len(m.trace) == m.rounds + 10
    assert errors[m.rounds - 1] == min(errors) and len(m.ensemble.roots) == m.rounds


def test_models_side_by_side_equal_single_fits(table):
    df, _, _ = table
    params = [dict(max_depth=3), dict(max_depth=6, subsample=0.8, colsample=0.5), dict(gamma=5.0)]
    many = N.fit_many(df, params, 6, [0, 1, -1], "cv_fold", patience=2)
    for i, (p, f) in enumerate(zip(params, [0, 1, -1])):
        assert many[i].rounds >= 1 and all(a[1] is not None for a in many[i].trace) and (many[i].trace[0][2] is None) == (f < 0)
    alone = N.fit_many(df, params[:1], 6, [0], "cv_fold", patience=2)[0]
    assert alone.trace == many[0].trace


def test_l2_and_gamma_hold_leaves_back(table):
    df, _, _ = table
    spread = lambda **p: df.sparkSession.createDataFrame(N.fit_boosted(df, rounds=3, **p).transform(df).select("score").collect()).agg({"score": "stddev"}).first()[0]
    assert spread(reg_lambda=0.0) > spread(reg_lambda=50.0)
    assert len(N.fit_boosted(df, rounds=1, gamma=0.0).ensemble.feature) > len(N.fit_boosted(df, rounds=1, gamma=8.0).ensemble.feature)


@pytest.mark.parametrize("cells", [50, 1 << 20])
def test_models_in_tasks_equal_passes(table, monkeypatch, cells):
    df, _, _ = table
    params = [dict(max_depth=7, min_child_weight=0.5, gamma=0.0), dict(max_depth=4, colsample=0.5, subsample=0.7), dict(max_depth=3, gamma=5.0)]

    def fits():
        return [(m.rounds, [tuple(None if v is None else round(v, 9) for v in t) for t in m.trace], [nested_weights(m.ensemble, int(r[0])) for r in m.ensemble.roots])
                for m in N.fit_many(df, params, 23, [0, -1, 2], "cv_fold", patience=4)]

    monkeypatch.setattr(T, "CELLS", cells)
    in_tasks = fits()
    monkeypatch.setattr(T, "IN_PLACE", 60)
    monkeypatch.setattr(N, "_fit_solo", None)
    assert in_tasks == fits()


def test_a_task_cuts_few_cells_at_a_time(monkeypatch):
    rng = np.random.default_rng(0)
    bins, y = rng.integers(0, 200, (20_000, 6)).astype(np.uint8), rng.integers(0, 2, 20_000)
    offsets = np.arange(7) * 256
    specs, most, cut = T.Specs.of(1, depth=30, min_leaf=1.0), [], T.best_cuts
    monkeypatch.setattr(T, "CELLS", 4096)
    monkeypatch.setattr(T, "best_cuts", lambda keys, *a: most.append(len(keys)) or cut(keys, *a))

    def grown():
        state = T.Resident.of_table(bins, y, np.arange(20_000), np.full(20_000, -1), specs, offsets)
        return T._grown(specs, False, state.cuts_of(specs, False))[0]

    few = grown()
    assert max(most) <= 4096 + 6 * 256
    monkeypatch.setattr(T, "CELLS", 1 << 30)
    assert nested(few, 0) == nested(grown(), 0)


# ---------------------------------------------------------------- columns of a resident table

def _one_hot_table(rng, n):
    """Bins of two categories' slots, a numeric feature and a slot that two categories' rows share."""
    a, b = rng.randint(0, 4, n), rng.randint(0, 6, n)
    slots = [(a == i).astype(np.uint8) * 2 for i in range(4)] + [(b == i).astype(np.uint8) for i in range(6)]
    return np.stack([*slots, rng.randint(0, 50, n).astype(np.uint8), (rng.rand(n) < 0.3).astype(np.uint8)], 1), np.array([3] * 4 + [2] * 6 + [50, 2])


def test_exclusive_features_share_a_column_and_sums_stay():
    rng = np.random.RandomState(3)
    bins, sizes = _one_hot_table(rng, 3000)
    offsets = np.cumsum([0, *sizes])
    columns = T.Columns(bins, offsets)
    assert len(columns.columns) < bins.shape[1]
    for codes, _, members in columns.columns:      # no row has two members outside their common bins
        if len(members) > 1:
            assert ((bins[:, [f for f, _, _ in members]] != [c for *_, c in members]).sum(1) <= 1).all()
    row = rng.choice(3000, 2000, replace=False)
    q, wa, wb = rng.randint(0, 5, 2000), rng.randint(1, 1 << 28, 2000), rng.randint(-(1 << 28), 1 << 28, 2000)
    looked = rng.rand(5, len(sizes)) < 0.6
    looked[:, 0] = True
    sub_at, sub = np.append(0, np.cumsum(looked.sum(1))), np.concatenate([np.flatnonzero(x) for x in looked]).astype(np.int32)
    held = T._Held()
    for part in T.histograms(q, row, wa, wb, bins, sub_at, sub, offsets):
        held.add(*part)
    for got, want in zip(columns.cells(q, row, wa, wb, looked), held.sum()):
        assert got.tolist() == want.tolist()


def test_features_that_meet_in_one_row_are_not_exclusive():
    bins = np.zeros((1000, 2), np.uint8)
    bins[:10, 0] = bins[10:20, 1] = 1
    assert T.exclusive(bins, np.array([2, 2]))[0] == [[0, 1]]
    bins[500] = 1
    assert T.exclusive(bins, np.array([2, 2]))[0] == [[0], [1]]


def test_grown_from_columns_or_pairs_is_the_same_tree(monkeypatch):
    rng = np.random.RandomState(5)
    bins, sizes = _one_hot_table(rng, 4000)
    offsets = np.cumsum([0, *sizes])
    h, g = rng.randint(1, 1 << 26, 4000), rng.randint(-(1 << 28), 1 << 28, 4000)
    specs = T.Specs.of(2, key=[1, 2], per_tree=9, depth=7, min_leaf=[1.0, 3.0], lam=0.4, gamma=0.01)
    at, tree = np.tile(np.arange(4000), 2), np.repeat([0, 1], 4000)

    def grown(columns):
        return T.grow_resident(T.Resident(bins, at, tree, h[at], g[at], offsets, columns), specs, True)

    want = grown(None)
    monkeypatch.setattr(T, "histograms", lambda *a: pytest.fail("pairs were counted"))
    monkeypatch.setattr(T.Columns, "pays", lambda *a: True)
    for room in (T.CELLS, 200):       # all nodes at once, and a few
        monkeypatch.setattr(T, "CELLS", room)
        got = grown(T.Columns(bins, offsets))
        assert len(want.feature) > 20
        for n in T.FOREST:
            assert getattr(got, n).tolist() == getattr(want, n).tolist()


def test_a_small_table_comes_packed(spark):
    """The rows of a table that is sent are no Python objects on the driver: a row a task arrives, not a row a row."""
    rng = np.random.RandomState(1)
    df = spark.createDataFrame([(i, i % 2, i % 5, Vectors.dense(rng.rand(3).tolist())) for i in range(500)], ["id", "label", "f", "features"]).repartition(4)
    data = T.bin_rows(df, fold_col="f", trees=1000)
    arrived = []
    whole = type(df).toArrow

    def noted(self):
        out = whole(self)
        arrived.append(out.num_rows)
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(data.rows), "toArrow", noted)
        bins, label, rid, fold = T.small_table(data)
    want = {r["rid"]: (r["label"], r["fold"], bytes(r["bins"])) for r in data.rows.collect()}
    assert {int(i): (int(a), int(f), b.tobytes()) for i, a, f, b in zip(rid, label, fold, bins)} == want and len(rid) == 500
    assert max(arrived) <= data.tasks
    data.release()
