"""Voting is order-free with ties to the lowest class (D13, D14); selection helpers."""

import random

import pytest

from binlens.operators import selection as S
from binlens.operators.ensemble import vote_hard, vote_soft


def _preds(spark, rows):
    return spark.createDataFrame(rows, "model string, id long, prediction int, score double")


def test_hard_vote_tie_lowest_and_order_free(spark):
    rows = [("a", 1, 1, .9), ("b", 1, 0, .2), ("a", 2, 1, .9), ("b", 2, 1, .8), ("c", 2, 0, .1)]
    want = {1: 0, 2: 1}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = {r.id: r.prediction for r in vote_hard(_preds(spark, rows)).collect()}
        assert got == want


def test_soft_vote_half_goes_to_lower_class(spark):
    rows = [("a", 1, 1, .75), ("b", 1, 0, .25), ("a", 2, 1, .9), ("b", 2, 1, .7)]
    got = {r.id: (r.prediction, r.score) for r in vote_soft(_preds(spark, rows)).collect()}
    assert got[1] == (0, pytest.approx(0.5)) and got[2][0] == 1


def test_metric_columns_macro(spark):
    rows = [(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 1), (5, 1, 0)]
    df = spark.createDataFrame(rows, "id long, label int, prediction int")
    cols = S.metric_columns()
    r = df.agg(*[c.alias(k) for k, c in cols.items()]).first()
    assert r.accuracy == pytest.approx(3 / 5)
    assert r.precision == pytest.approx(2 / 3) and r.recall == pytest.approx(2 / 3)
    assert r.recall_macro == pytest.approx((0.5 + 2 / 3) / 2)
    f0 = 2 * 0.5 * 0.5 / 1.0
    f1 = 2 * (2 / 3) * (2 / 3) / (4 / 3)
    assert r.f1_macro == pytest.approx((f0 + f1) / 2)


def test_grid_sampling_is_seeded_and_distinct():
    space = {"a": [1, 2, 3, 4], "b": [0.1, 0.2, 0.3]}
    d1, d2 = S.sample_grid(space, 5, 0), S.sample_grid(space, 5, 0)
    assert d1 == d2 and len({tuple(sorted(p.items())) for p in d1}) == 5
    assert len(S.sample_grid(space, 50, 0)) == 12


def test_space_draws_in_range():
    draws = S.sample_space({"k": ("quniform", 2, 10, 1), "c": ("uniform", 0, 20), "kern": ("choice", ["rbf", "poly"])}, 20, 1)
    assert all(2 <= p["k"] <= 10 and float(p["k"]).is_integer() for p in draws)
    assert all(0 <= p["c"] <= 20 and p["kern"] in ("rbf", "poly") for p in draws)


def test_min_leaf_rows():
    assert S.min_leaf_rows(0.1, 95) == 10 and S.min_leaf_rows(5, 95) == 5


def test_adaptive_rounds_beat_seeded_draws():
    space = {"x": ("uniform", -5, 5), "n": ("quniform", 1, 40, 1), "kind": ("choice", ["a", "b", "c", "d"])}
    value = lambda p: -(p["x"] - 1.7) ** 2 - ((p["n"] - 31) / 8) ** 2 - 3 * (p["kind"] != "c")
    wins = 0
    for seed in range(12):
        got = S.adaptive_rounds(space, lambda ps: [value(p) for p in ps], trials=60, batch=6, seed=seed)
        drawn = S.sample_space(space, 60, seed)
        assert len(got) == 60 and [p for p, _ in got[:6]] == S.sample_space(space, 6, seed)
        assert all(-5 <= p["x"] <= 5 and 1 <= p["n"] <= 40 and p["kind"] in "abcd" and v == value(p) for p, v in got)
        wins += max(v for _, v in got) > max(map(value, drawn))
        late = [v for _, v in got[30:]]
        assert sum(late) / len(late) > sum(map(value, drawn)) / 60
    assert wins >= 9
    assert S.adaptive_rounds(space, lambda ps: [value(p) for p in ps], 20, 6, 1) == S.adaptive_rounds(space, lambda ps: [value(p) for p in ps], 20, 6, 1)


def test_adaptive_rounds_on_few_points():
    got = S.adaptive_rounds({"k": ("quniform", 2, 3, 1)}, lambda ps: [p["k"] for p in ps], trials=9, batch=4)
    assert len(got) == 9 and {p["k"] for p, _ in got} <= {2.0, 3.0}


@pytest.fixture(scope="module")
def small(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.RandomState(2)
    y = rng.randint(0, 2, 120)
    x = rng.normal(0, 1, (120, 3)) + 0.8 * y[:, None]
    return spark.createDataFrame([(i, int(y[i]), i % 3, Vectors.dense(x[i].tolist())) for i in range(120)], ["id", "label", "fold", "features"]).repartition(3).cache(), x, y


def test_linear_models_side_by_side_equal_single_fits(small):
    from binlens.operators import sgd

    df, _, _ = small
    points = [{"loss": k, "alpha": a} for k in ("hinge", "log", "modified_huber", "perceptron") for a in (1e-4, 10)]
    got = {(r.candidate, r.fold): tuple(r[3:]) for r in sgd.search_sgd(df, points, [0, 2], "fold", max_iter=12).collect()}
    assert len(got) == 16
    for (i, f), counts in list(got.items())[::3]:
        m = sgd.fit_sgd(df.where(f"fold <> {f}"), max_iter=12, **points[i])
        assert counts == S.counted(m.transform(df.where(f"fold = {f}")))


def test_neighbour_candidates_share_a_join(small):
    import numpy as np

    from binlens.plans.q_select import knn_counts

    df, x, y = small
    got = {(r.candidate, r.fold): r for r in knn_counts(df, [{"n_neighbors": k, "p": p} for p in (1, 2) for k in (1, 4)], [1], "fold").collect()}
    held = np.arange(120) % 3 == 1
    for i, (p, k) in enumerate((p, k) for p in (1, 2) for k in (1, 4)):
        d = (np.abs(x[held][:, None] - x[~held][None]) ** p).sum(-1)
        votes = y[~held][np.argsort(d, 1)[:, :k]].mean(1)
        assert got[i, 1].hit == ((votes > 0.5).astype(int) == y[held]).sum() and got[i, 1].n == held.sum()


def test_a_fit_ends_as_one_row_of_counts(small):
    from binlens.plans.q_select import _dt

    df, _, _ = small
    out = S.run_folds(df, [(0, {}, _dt()), (1, {}, _dt(1))], [0, 1, 2], "fold", score_train=True)
    assert out.count() == 12 and out.where("split = 'test'").agg({"n": "sum"}).first()[0] == 240
    per = S.fold_metrics(out, ["accuracy", "recall_macro"]).collect()
    assert all(0 <= r.accuracy <= 1 and 0 <= r.recall_macro <= 1 for r in per)
