"""Reducers compared inside folds."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from binlens.plans.q_select import reducer_scores


def frame(spark, flip):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(60, 4)))
    label = (x[:, 2] > 0.7).astype(int)
    fold = np.arange(60) % 3
    label = np.where((fold == 0) & flip, 1 - label, label)
    return spark.createDataFrame([(i, int(y), int(f), Vectors.dense(v.round(1))) for i, (y, f, v) in enumerate(zip(label, fold, x))],
                                 ["id", "label", "cv_fold", "features"])


def test_a_fold_is_never_fitted_on(spark):
    """With the labels of a fold turned round, its accuracy is turned round: neither reducer nor tree has seen them."""
    a, b = ({(r["reducer"], r["n_components"], r["max_depth"]): r["accuracy"] for r in
             reducer_scores(frame(spark, flip), [1, 2], [1, 3], ("svd", "nmf", "gini", "chi2"), folds=[0], nmf_steps=20).collect()} for flip in (False, True))
    assert len(a) == 16 and all(b[k] == pytest.approx(1 - v) for k, v in a.items())
    assert a["gini", 1, 3] >= 0.85      # 20 rows; values rounded across the cut are lost
    with pytest.raises(ValueError, match="5 components"):
        reducer_scores(frame(spark, False), [5], [3])
