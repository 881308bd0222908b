"""Statistics and encoders against hand computations."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from binlens.operators.features import (PopulationScaler, TopKSelector, chi2_scores, mutual_information,
                                        one_hot_stages, top_k)


def _mi(xs, ys):
    n = len(xs)
    out = 0.0
    for x in set(xs):
        for y in set(ys):
            c = sum(1 for a, b in zip(xs, ys) if a == x and b == y)
            if c:
                cx, cy = xs.count(x), ys.count(y)
                out += c / n * math.log(c * n / (cx * cy))
    return out


def test_mutual_information_matches_hand(spark):
    # feature f1 = label exactly, f2 independent-ish; zeros are implied (not in the long table)
    ids = list(range(8))
    labels = [0, 0, 0, 0, 1, 1, 1, 1]
    f1 = [0, 0, 0, 0, 2, 2, 2, 2]
    f2 = [1, 0, 1, 0, 1, 0, 1, 0]
    long_rows = [(i, "f1", float(v)) for i, v in zip(ids, f1) if v] + [(i, "f2", float(v)) for i, v in zip(ids, f2) if v]
    long_df = spark.createDataFrame(long_rows, "id long, feature string, value double")
    lab = spark.createDataFrame(list(zip(ids, labels)), "id long, label int")
    got = {r.feature: r.mi for r in mutual_information(long_df, lab).collect()}
    assert got["f1"] == pytest.approx(_mi(f1, labels))
    assert got["f2"] == pytest.approx(_mi(f2, labels), abs=1e-12)
    assert got["f1"] == pytest.approx(math.log(2))


def test_chi2_matches_formula(spark):
    X = np.array([[1.0, 0.0], [2.0, 1.0], [0.0, 3.0], [1.0, 1.0]])
    y = np.array([0, 0, 1, 1])
    rows = [(i, j, float(X[i, j])) for i in range(4) for j in range(2) if X[i, j]]
    long_df = spark.createDataFrame(rows, "id long, feature int, value double")
    lab = spark.createDataFrame([(i, int(y[i])) for i in range(4)], "id long, label int")
    got = {r.feature: r.chi2 for r in chi2_scores(long_df, lab).collect()}
    obs = np.array([X[y == c].sum(0) for c in (0, 1)])
    exp = np.outer([0.5, 0.5], X.sum(0))
    want = ((obs - exp) ** 2 / exp).sum(0)
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])


def test_top_k_tie_prefers_higher_index(spark):
    sc = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.0), (3, 0.5)], "feature_idx int, score double")
    assert [r.feature_idx for r in top_k(sc, "score", 2).orderBy("rank").collect()] == [1, 2]


def test_population_scaler_ddof0_and_constant_column(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 5.0]),), (Vectors.dense([3.0, 5.0]),)], ["features"])
    m = PopulationScaler(featuresCol="features", outputCol="scaled").fit(df)
    out = [r.scaled.toArray().tolist() for r in m.transform(df).collect()]
    assert out == [[1.0, 5.0], [3.0, 5.0]]  # std_pop of column 0 is 1; constant column unchanged


def test_one_hot_unknown_level_is_all_zero(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "cat string, x double")
    test = spark.createDataFrame([("zz", 4.0), ("b", 5.0)], "cat string, x double")
    model = Pipeline(stages=one_hot_stages(["cat"], ["x"])).fit(train)
    rows = {r.x: r.features.toArray().tolist() for r in model.transform(test).collect()}
    assert rows[4.0] == [0.0, 0.0, 0.0, 4.0]
    assert rows[5.0] == [0.0, 1.0, 0.0, 5.0]


def test_selector_pipeline_save_load_roundtrip(spark, tmp_path):
    rows = [(Vectors.dense([float(i % 2), float(i % 3), 1.0]), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, ["features", "label"])
    pipe = Pipeline(stages=[TopKSelector(k=1, outputCol="sel"), PopulationScaler(featuresCol="sel", outputCol="scaled")])
    m = pipe.fit(df)
    assert m.stages[0].getOrDefault("indices") == [0]
    path = str(tmp_path / "pipe")
    m.write().overwrite().save(path)
    back = PipelineModel.load(path)
    a = [r.scaled for r in m.transform(df).orderBy(F.monotonically_increasing_id()).collect()]
    b = [r.scaled for r in back.transform(df).orderBy(F.monotonically_increasing_id()).collect()]
    assert a == b


def test_selector_takes_sparse_vectors_and_checks_k(spark):
    rows = [(i, i % 2, Vectors.sparse(6, {0: 1.0, 2: float(i % 2)} if i % 2 else {0: 1.0})) for i in range(20)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    assert TopKSelector(k=1).fit(df).getOrDefault("indices") == [2]
    assert sorted(TopKSelector(k=4).fit(df).getOrDefault("indices")) == [0, 2, 4, 5]      # all-zero features: ties at 0
    with pytest.raises(ValueError, match="k = 7"):
        TopKSelector(k=7).fit(df)


def test_long_form_of_sparse_dense_and_empty(spark):
    from binlens.operators.features import to_long
    df = spark.createDataFrame([(1, Vectors.sparse(5, {1: 2.0, 4: 0.0})), (2, Vectors.dense([0.0, 3.0])), (3, Vectors.sparse(4, {}))], ["id", "features"])
    assert sorted((r.id, r.feature_idx, r.value) for r in to_long(df, "id").collect()) == [(1, 1, 2.0), (2, 1, 3.0)]
