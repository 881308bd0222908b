"""The network's gradient is checked numerically and its epochs against plain numpy (D9); the randomised SVD equals numpy's on a wide
sparse matrix (C19)."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from binlens.operators import network as W
from binlens.operators import sparse_svd as V


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    shape = W.Shape([4, 5, 3, 1])
    w, x, y = shape.start(2), rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float)
    _, g = shape.loss_and_gradient(w, x, y, 0.7)
    for i in range(shape.total):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = (shape.loss_and_gradient(w + step, x, y, 0.7)[0] - shape.loss_and_gradient(w - step, x, y, 0.7)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-6)


@pytest.fixture(scope="module")
def moons(spark):
    rng = np.random.RandomState(3)
    a = rng.rand(400) * np.pi
    y = rng.randint(0, 2, 400)
    x = np.column_stack([np.cos(a) * (1 - 2 * y) + y, np.sin(a) * (1 - 2 * y) + 0.5 * y]) + rng.normal(0, 0.12, (400, 2))
    return spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i].tolist())) for i in range(400)], ["id", "label", "features"]).repartition(4).cache(), x, y


@pytest.mark.parametrize("one_task", [20_000, 10], ids=["one task", "averaged"])
def test_curved_classes_are_learnt(moons, monkeypatch, one_task):
    monkeypatch.setattr(W, "ONE_TASK", one_task)
    df, _, _ = moons
    m = W.fit_network(df, hidden=(30,), alpha=1e-3, max_iter=40, rate=0.02, batch=25)
    assert m.transform(df).where("prediction = label").count() > 375       # a line gets about 350
    assert m.losses[-1] < 0.3 < m.losses[0]


def test_one_task_equals_plain_epochs(spark, moons):
    df, _, _ = moons
    one = df.coalesce(1)
    m = W.fit_network(one, hidden=(8,), alpha=0.1, max_iter=3, batch=50, seed=4)
    rows = one.collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([float(r.label) for r in rows])
    shape = W.Shape([2, 8, 1])
    state = (shape.start(4), np.zeros(shape.total), np.zeros(shape.total), 0)
    for e in range(3):
        state, _ = W.adam_epoch(shape, state, x, y, 0.1, 50, 1e-3, np.random.default_rng([4, e, 0]))
    assert m.weights == pytest.approx(state[0], abs=1e-12) and m.epochs == 3


def test_l2_shrinks_and_patience_stops(moons):
    df, _, _ = moons
    big, small = (np.abs(W.fit_network(df, hidden=(8,), alpha=a, max_iter=15, rate=0.02).weights).sum() for a in (0.0, 50.0))
    assert small < 0.8 * big
    assert W.fit_network(df, hidden=(4,), max_iter=200, tol=10.0, patience=3).epochs == 4
    assert W.fit_network(df.limit(0), hidden=(4,)).epochs == 0


# ---------------------------------------------------------------- SVD

def _long(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(r), int(c), float(a[r, c])) for r, c in zip(i, j)], "id long, feature_idx int, value double").repartition(4)


def test_wide_sparse_matrix_equals_numpy(spark):
    rng = np.random.default_rng(0)
    d, k = 20_000, 6
    a = np.zeros((150, d))
    for r in range(150):        # a few topics, so that singular values fall off
        t = r % 6
        at = t * 3000 + rng.integers(0, 200 + 40 * t, 40)
        a[r, at] = rng.random(40) * (6 - t + 2)
    proj, s, v = V.randomised_svd(V.sparse_rows(_long(spark, a)), d, k, n_iter=40)
    u, want, vt = np.linalg.svd(a, full_matrices=False)
    assert s == pytest.approx(want[:k], rel=1e-6)
    sign = np.sign((vt[:k] * v.T).sum(1))
    assert np.abs(v.T - sign[:, None] * vt[:k]).max() < 1e-4
    got = {r.id: r.components for r in proj.collect()}
    assert np.abs(np.array([got[i] for i in range(150)]) - a @ v).max() < 1e-9


def test_repeated_cells_add_up_and_no_rows(spark):
    long = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (2, 1, 4.0)], "id long, feature_idx int, value double")
    _, s, _ = V.randomised_svd(V.sparse_rows(long), 3, 2)
    assert s == pytest.approx([4.0, 3.0])
    proj, s, _ = V.randomised_svd(V.sparse_rows(long.limit(0)), 3, 2)
    assert proj.count() == 0 and s.tolist() == [0.0, 0.0]


def test_words_are_counted_few_documents_a_task(spark, tmp_path, monkeypatch):
    from binlens.plans import q_models

    (spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 5}") for i in range(60)] + [(3, "w1 again"), (None, "w2"), (None, "w2")], "doc_id long, text string")
     .write.parquet(str(tmp_path / "documents.parquet")))
    found = []
    monkeypatch.setattr(q_models.sparse_svd, "randomised_svd", lambda rows, *a, **k: found.append(rows) or (rows.selectExpr("id", "values AS components"), None, None))
    q_models.q_svd_tokens(spark, str(tmp_path))
    monkeypatch.setattr(q_models, "DOCS_OF_A_TASK", 3)
    q_models.q_svd_tokens(spark, str(tmp_path))
    few, many = found
    assert many.rdd.getNumPartitions() == 21 and few.rdd.getNumPartitions() <= 8
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and many.count() == 61


def test_a_task_counts_words_of_bounded_text(spark, tmp_path, monkeypatch):
    from binlens.plans import q_models

    spark.createDataFrame([(i, "long words " * (100 if i < 30 else 1)) for i in range(60)] + [(70, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = []
    monkeypatch.setattr(q_models.sparse_svd, "randomised_svd", lambda rows, *a, **k: found.append(rows) or (rows.selectExpr("id", "values AS components"), None, None))
    monkeypatch.setattr(q_models, "TEXT_OF_A_TASK", 1_000)
    q_models.q_svd_tokens(spark, str(tmp_path))
    assert found[0].rdd.getNumPartitions() == 34 and found[0].count() == 60



def test_a_table_over_20000_rows_is_one_pass(spark, monkeypatch):
    rng = np.random.RandomState(2)
    x = rng.rand(20_500, 2)
    df = spark.createDataFrame([(Vectors.dense(r.tolist()), int(r[0] > r[1])) for r in x], ["features", "label"]).repartition(4)
    monkeypatch.setattr(W, "vector_sum", lambda *a: pytest.fail("an epoch was a job"))
    m = W.fit_network(df, hidden=(4,), max_iter=4, rate=0.01)
    assert m.epochs == 4 and m.transform(df).where("prediction = label").count() > 19_000


def test_wide_tables_are_averaged(spark, moons, monkeypatch):
    df, _, _ = moons
    called = []
    monkeypatch.setattr(W, "FEW", 10)
    monkeypatch.setattr(W, "MAX_BROADCAST_BYTES", 100)
    real = W.vector_sum
    monkeypatch.setattr(W, "vector_sum", lambda *a: called.append(1) or real(*a))
    assert W.fit_network(df, hidden=(4,), max_iter=2).epochs == len(called) == 2


def test_refits_run_beside_the_folds_and_long_fits_first(spark, monkeypatch, tmp_path):
    from threading import Event

    from binlens.plans import q_models
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, i % 2, "test" if i % 6 == 5 else "train", i % 5) for i in range(60)], "id long, label int, split string, cv_fold int")
    refits, folds, started = Event(), Event(), []

    class Scored:
        def score(self, rows):
            return rows.select("id", "label", F.lit(1).alias("prediction"), F.lit(0.5).alias("score"))

    def builder(name):
        def fit(train):
            started.append(name)
            folds.set()
            assert refits.wait(60), "the refits wait for the folds"
            return Scored()
        return fit

    def fit_roster(train, names, *a, **k):
        refits.set()
        assert folds.wait(60)
        return {n: Scored() for n in names}

    monkeypatch.setattr(q_models, "train_test", lambda *a: (df.where("split = 'train'"), df.where("split = 'test'"), []))
    monkeypatch.setattr(q_models.roster, "builders", lambda *a, **k: {n: builder(n) for n in q_models.ROSTER})
    monkeypatch.setattr(q_models.roster, "fit_roster", fit_roster)
    oof, bases = q_models.stack_tables(spark, str(tmp_path))
    assert oof.count() == 7 * 50 and bases.count() == 7 * 10
    assert set(started[:5]) <= {"boosting", "mlp", "adaboost"}
