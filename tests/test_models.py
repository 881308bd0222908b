"""Fits on separable toy data (D1-D11): accuracy, determinism and the uniform score interface."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from binlens.operators import roster


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.RandomState(0)
    rows = []
    for i in range(240):
        y = i % 2
        x = rng.normal(0, 0.3, 4) + (2.0 if y else -2.0) * np.array([1.0, 0.5, 0.0, 0.0])
        rows.append((i, y, Vectors.dense(x.tolist())))
    df = spark.createDataFrame(rows, ["id", "label", "features"]).cache()
    return df.filter("id % 4 != 0"), df.filter("id % 4 = 0")


FAST = ["decision_tree", "random_forest", "logistic", "linear_svm", "knn", "mlp", "sgd_modified_huber",
        "sgd_perceptron"]


@pytest.mark.parametrize("name", FAST)
def test_separable_accuracy(spark, toy, name):
    train, test = toy
    f = roster.builders(4, train.count())[name](train)
    out = f.score(test)
    assert out.columns == ["id", "label", "prediction", "score"]
    rows = out.collect()
    acc = np.mean([r.label == r.prediction for r in rows])
    assert acc >= 0.95
    assert all(0.0 <= r.score <= 1.0 for r in rows)


def test_adaboost_few_rounds(spark, toy):
    from binlens.operators.boosting import fit_adaboost

    train, test = toy
    m = fit_adaboost(train, rounds=6, checkpoint_every=3)
    rows = m.transform(test).collect()
    assert np.mean([r.label == r.prediction for r in rows]) >= 0.95


def test_same_seed_same_predictions(spark, toy):
    train, test = toy
    b = roster.builders(4)
    a = [tuple(r) for r in b["random_forest"](train).score(test).orderBy("id").collect()]
    c = [tuple(r) for r in roster.builders(4)["random_forest"](train).score(test).orderBy("id").collect()]
    assert a == c


def test_gbt_early_stop_uses_validation_slice(spark, toy):
    from pyspark.sql import functions as F

    from binlens.operators.models import boosted_trees

    train, _ = toy
    tv = train.withColumn("is_val", (F.col("id") % 3) == 0)
    m = boosted_trees(rounds=50, max_depth=3, validation_col="is_val", tol=0.01).fit(tv)
    assert 1 <= m.getNumTrees <= 50


@pytest.fixture(scope="module")
def lopsided(spark):
    """12 % positives whose features overlap with the rest."""
    rng = np.random.RandomState(4)
    rows = []
    for i in range(600):
        y = int(rng.rand() < 0.12)
        rows.append((i, y, i % 5, Vectors.dense((rng.normal(0, 1, 5) + 1.2 * y).tolist())))
    df = spark.createDataFrame(rows, ["id", "label", "cv_fold", "features"]).cache()
    return df.filter("id % 4 != 0"), df.filter("id % 4 = 0")


def test_boosting_learns_on_a_lopsided_class(spark, lopsided):
    train, test = lopsided
    rows = roster.builders(5, train.count())["boosting"](train).score(test).collect()
    assert len({r.score for r in rows}) > 20
    assert {r.prediction for r in rows} == {0, 1}
    majority = np.mean([r.label == 0 for r in rows])
    assert np.mean([r.label == r.prediction for r in rows]) >= majority - 0.02
    ranked = sorted(rows, key=lambda r: r.score)
    pos = [i for i, r in enumerate(ranked) if r.label]
    auc = (sum(pos) - len(pos) * (len(pos) - 1) / 2) / (len(pos) * (len(rows) - len(pos)))
    assert auc > 0.7


def test_early_stop_takes_several_rounds(spark, lopsided):
    from binlens.operators.models import boosted_trees
    train, _ = lopsided
    m = boosted_trees(rounds=60, max_depth=4, n_rows=train.count(), validation_col="is_val", tol=0.01, learning_rate=0.1).fit(
        train.selectExpr("*", "cv_fold = 0 AS is_val"))
    assert 2 <= m.getNumTrees <= 60


def test_depth_beyond_the_estimators_is_an_error():
    from binlens.operators.models import decision_tree
    with pytest.raises(ValueError, match="depth 33"):
        decision_tree(max_depth=33)


def test_one_vector_reaches_the_driver(spark):
    from binlens.functions.sums import vector_sum
    df = spark.range(5000).selectExpr("array(double(id), 1.0D, if(id % 2 = 0, 2.0D, null)) AS v").repartition(7)
    assert vector_sum(df, 3).tolist() == [5000 * 4999 / 2, 5000.0, 5000.0]
    assert vector_sum(df.limit(0), 3).tolist() == [0.0, 0.0, 0.0]


def test_sgd_yields_once_per_partition(spark, monkeypatch):
    """A partition of many Arrow batches adds one vector to the sum."""
    from binlens.operators import sgd
    seen = []
    real = sgd.vector_sum
    monkeypatch.setattr(sgd, "vector_sum", lambda parts, size: (seen.append(parts.count()), real(parts, size))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame([(i, i % 2, Vectors.dense([1.0 if i % 2 else -1.0])) for i in range(1000)], ["id", "label", "features"]).coalesce(1)
        sgd.fit_sgd(df, max_iter=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen and set(seen) == {1}


def test_adaboost_in_a_task_equals_passes(spark, monkeypatch):
    import numpy as np

    from binlens.operators import boosting

    rng = np.random.RandomState(3)
    x = np.column_stack([rng.normal(0, 1, 400), rng.randint(0, 5, 400), rng.rand(400) < 0.4]).astype(float)
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(0, 0.6, 400) > 0.7).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i].tolist())) for i in range(400)], ["id", "label", "features"]).repartition(5)
    jobs = []
    gini = boosting.best_stage
    monkeypatch.setattr(boosting, "best_stage", lambda *a: jobs.append(1) or gini(*a))
    one = boosting.fit_adaboost(df, rounds=12)
    assert not jobs                          # no job of the driver's for a round
    monkeypatch.setattr(boosting, "ONE_TASK", 10)
    many = boosting.fit_adaboost(df, rounds=12)
    assert len(jobs) == 12 and len(one.stages) == 12
    w, star = np.ones(400), np.where(y == 1, 1.0, -1.0)
    for a, b in zip(one.stages, many.stages):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:])
        best = min((sum(m.sum() - ((w[m] * 1.0)[y[m] == 1].sum() ** 2 + w[m][y[m] == 0].sum() ** 2) / w[m].sum() - m.sum() + w[m].sum() for m in (x[:, j] <= t, x[:, j] > t)), j)
                   for j in range(3) for t in np.unique(x[:, j])[:-1])[0]
        left = x[:, a[0]] <= a[1]
        mine = sum(w[m].sum() - (w[m][y[m] == 1].sum() ** 2 + w[m][y[m] == 0].sum() ** 2) / w[m].sum() for m in (left, ~left))
        assert mine <= best * 1.02           # thresholds are quantiles
        w = w * np.exp(-star * np.where(left, a[2], a[3]))
        w /= w.sum()
