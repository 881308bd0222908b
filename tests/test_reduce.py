"""SVD, NMF and the Nystroem map against numpy."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from binlens.operators import reduce


@pytest.fixture(scope="module")
def mat(spark):
    rng = np.random.RandomState(1)
    X = np.abs(rng.normal(size=(40, 6)))
    df = spark.createDataFrame([(i, Vectors.dense(X[i].tolist())) for i in range(40)], ["id", "features"])
    return X, df


def test_svd_singular_values_and_projection(spark, mat):
    X, df = mat
    proj, s, V = reduce.svd(df, 3)
    want = np.linalg.svd(X, compute_uv=False)[:3]
    assert np.allclose(s, want, rtol=1e-6)
    P = dict((r.id, np.asarray(r.components)) for r in proj.collect())
    Q = dict((r.id, np.asarray(r.components)) for r in reduce.svd_project(df, V).collect())
    for i in range(40):
        assert np.allclose(np.abs(P[i]), np.abs(Q[i]), atol=1e-6)


def test_nmf_nonnegative_and_fits(spark, mat):
    X, df = mat
    W, H, it = reduce.nmf(df, 3, max_iter=60, checkpoint_every=20)
    Wm = np.stack([np.asarray(r.w) for r in W.orderBy("id").collect()])
    assert (Wm >= 0).all() and (H >= 0).all()
    err = np.linalg.norm(X - Wm @ H) / np.linalg.norm(X)
    assert err < 0.5
    Wt = np.stack([np.asarray(r.w) for r in reduce.nmf_transform(df, H, n_iter=300).orderBy("id").collect()])
    assert np.linalg.norm(X - Wt @ H) / np.linalg.norm(X) < err + 0.05


def test_nystroem_with_all_landmarks_reproduces_kernel(spark, mat):
    X, df = mat
    m = reduce.fit_nystroem(df, n_components=40, kernel="rbf", gamma=0.2)
    Z = np.stack([r.kernel_features.toArray() for r in m.transform(df).orderBy("id").collect()])
    d2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(2)
    K = np.exp(-0.2 * d2)
    assert np.allclose(Z @ Z.T, K, atol=1e-6)


def test_nmf_of_a_small_table_takes_the_same_steps(spark):
    rng = np.random.default_rng(8)
    X = rng.random((40, 3)) @ rng.random((3, 7))
    df = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in enumerate(X)], ["id", "features"])
    near, far = (reduce.nmf(df, 3, max_iter=30, tol=1e-9, in_place=n) for n in (10**6, 0))
    assert near[2] == far[2] and np.allclose(near[1], far[1], rtol=1e-8)
    a, b = (np.array([r["w"] for r in w.orderBy("id").collect()]) for w in (near[0], far[0]))
    assert a.shape == (40, 3) and np.allclose(a, b, rtol=1e-8)
