"""Kernel SVM: kernels separate what they can, C and gamma matter, wrong settings are errors."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from binlens.operators.kernel_svm import fit_kernel_svm
from binlens.plans.q_models import KERNEL_SETTINGS, q_kernels

from conftest import SF001


@pytest.fixture(scope="module")
def rings(spark):
    """Class 1 inside a circle, class 0 around it: no line separates them."""
    rng = np.random.default_rng(3)
    angle, radius = rng.uniform(0, 2 * np.pi, 300), np.where(np.arange(300) % 2, 0.5, 2.0) + rng.normal(0, 0.1, 300)
    rows = [(i, int(i % 2), Vectors.dense([r * np.cos(a), r * np.sin(a)])) for i, (a, r) in enumerate(zip(angle, radius))]
    return spark.createDataFrame(rows, ["id", "label", "features"]).coalesce(1).cache()


def accuracy(model, df):
    return model.transform(df).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


def test_kernels_bend_the_border(rings):
    assert accuracy(fit_kernel_svm(rings, "linear"), rings) < 0.75
    assert accuracy(fit_kernel_svm(rings, "rbf", gamma=1.0), rings) > 0.97
    assert accuracy(fit_kernel_svm(rings, "poly", gamma=1.0, degree=2, coef0=1.0), rings) > 0.97


def test_parameters_matter(rings):
    def norm(C):
        return float(np.linalg.norm(fit_kernel_svm(rings, "rbf", C=C, gamma=1.0, n_components=40, max_iter=25).machine.coefficients.toArray()))
    assert norm(0.01) < norm(1.0) < norm(20.0)
    # a vanishing gamma makes all rows alike
    assert accuracy(fit_kernel_svm(rings, "rbf", gamma=1e-7, n_components=40, max_iter=25), rings) < accuracy(fit_kernel_svm(rings, "rbf", gamma=1.0, n_components=40, max_iter=25), rings)


def test_wrong_settings(rings):
    for bad in ({"kernel": "cubic"}, {"C": 0.0}):
        with pytest.raises(ValueError):
            fit_kernel_svm(rings, **bad)
    with pytest.raises(ValueError):
        fit_kernel_svm(rings.limit(0))


def test_registered_kernels(spark):
    rows = q_kernels(spark, SF001).collect()
    assert {r["kernel"] for r in rows} == {k for k, *_ in KERNEL_SETTINGS}
    assert all(0.0 <= r["test_accuracy"] <= 1.0 and r["n_test"] > 0 for r in rows)
