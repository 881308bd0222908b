"""Nearest-neighbour mutual information: brute force, ties, small classes, implied zeros, block borders."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from binlens.operators.continuous_mi import digamma, mutual_information_knn
from binlens.operators.features import TopKSelector

EULER = 0.5772156649015329


def psi(n):
    return sum(1.0 / i for i in range(1, int(n))) - EULER


def brute(column, y, k=3):
    sizes = {c: y.count(c) for c in set(y)}
    keep = [i for i, c in enumerate(y) if c is not None and sizes[c] > 1]
    if not keep:
        return 0.0
    terms = []
    for i in keep:
        same = sorted(abs(column[j] - column[i]) for j in keep if j != i and y[j] == y[i])
        kk = min(k, len(same))
        r = same[kk - 1]
        m = sum(1 for j in keep if (abs(column[j] - column[i]) < r if r > 0 else column[j] == column[i]))
        terms.append(psi(kk) - psi(sizes[y[i]]) - psi(m))
    return max(0.0, psi(len(keep)) + sum(terms) / len(terms))


def frames(spark, columns, y):
    labels = spark.createDataFrame(list(enumerate(y)), "id int, label string")
    cells = [(i, f, float(v)) for f, col in columns.items() for i, v in enumerate(col) if v != 0]
    return spark.createDataFrame(cells, "id int, feature string, value double"), labels


def test_digamma(spark):
    got = spark.range(1, 400).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r["p"] - psi(r["id"])) < 1e-11 for r in got)


@pytest.mark.parametrize("block", [3, 8, 65_536])
def test_brute_force(spark, block):
    rnd = random.Random(4)
    y = [rnd.choice("aabbbc") for _ in range(150)] + ["alone", None, "d", "d"]
    n = len(y)
    columns = {
        "continuous": [rnd.gauss(0 if c == "a" else 1, 0.5) for c in y],
        "noise": [rnd.random() for _ in range(n)],
        "few_values": [rnd.randrange(4) + (c == "b") for c in y],
        "mostly_zero": [rnd.random() if rnd.random() < 0.2 else 0 for _ in range(n)],
        "constant": [7.5] * n,
        "negative": [-float(i % 17) for i in range(n)],
        "telling": [{"a": 0.0, "b": 10.0}.get(c, 20.0) + rnd.random() for c in y],
    }
    long_df, labels = frames(spark, columns, y)
    got = {r["feature"]: r["mi"] for r in mutual_information_knn(long_df, labels, block=block).collect()}
    assert set(got) == set(columns)
    for f, col in columns.items():
        assert math.isclose(got[f], brute(col, y), abs_tol=1e-9), f
    assert got["telling"] > got["continuous"] > got["noise"]
    assert got["constant"] == 0


def test_edges(spark):
    long_df, labels = frames(spark, {"x": [1, 2, 3]}, ["a", "b", None])
    assert [tuple(r) for r in mutual_information_knn(long_df, labels).collect()] == [("x", 0.0)]
    assert mutual_information_knn(long_df.limit(0), labels).count() == 0
    assert mutual_information_knn(long_df.limit(0), labels.limit(0)).count() == 0
    two = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "id int, label string")
    for bad in (float("nan"), float("inf"), None):
        cells = spark.createDataFrame([(0, "x", 1.0), (1, "x", bad)], "id int, feature string, value double")
        with pytest.raises(PySparkException):
            mutual_information_knn(cells, two).collect()
    explicit = spark.createDataFrame([(0, "x", 0.0), (1, "x", -0.0), (2, "x", 1.0), (3, "x", 1.0)], "id int, feature string, value double")
    assert math.isclose(mutual_information_knn(explicit, two).first()["mi"], brute([0, 0, 1, 1], list("aabb")), abs_tol=1e-9)


def test_selector_keeps_the_telling_columns(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    x = np.stack([rng.normal(size=200), y + rng.normal(0, 0.2, 200), rng.normal(size=200), 3.0 * y + rng.normal(size=200)], 1)
    df = spark.createDataFrame([(int(c), Vectors.dense(v)) for c, v in zip(y, x)], ["label", "features"])
    model = TopKSelector(k=2, scoreFunc="mi_knn").fit(df)
    assert sorted(model.getOrDefault("indices")) == [1, 3]
