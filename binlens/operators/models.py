"""Classifier configurations (D1-D11, D17) on Spark ML, plus scoring helpers.

Each builder maps the reference's parameters onto the Spark estimator; gaps are noted where the
Spark estimator differs. Scores: class-1 probability when the model has one, otherwise the
logistic link of the margin.
"""

from __future__ import annotations

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Deepest tree that Spark's estimators fit.
MAX_DEPTH = 30


def _check_depth(depth: int) -> None:
    if depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is beyond {MAX_DEPTH}, the deepest tree that can be fitted")


def decision_tree(max_depth=5, min_leaf=1, impurity="gini", seed=0, features="features", label="label",
                  max_bins=256):
    """``min_samples_split`` has no Spark parameter; thresholds are binned (``maxBins``)."""
    _check_depth(max_depth)
    return DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=max_depth,
                                  minInstancesPerNode=min_leaf, impurity=impurity, seed=seed, maxBins=max_bins)


def random_forest(n_trees=10, max_depth=5, max_features="auto", seed=1, impurity="gini", min_leaf=1,
                  features="features", label="label", max_bins=256):
    """``max_features`` int n -> featureSubsetStrategy "n"; probabilities are tree averages."""
    _check_depth(max_depth)
    strategy = str(max_features) if not isinstance(max_features, str) else max_features
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=n_trees, maxDepth=max_depth,
                                  featureSubsetStrategy=strategy, seed=seed, impurity=impurity,
                                  minInstancesPerNode=min_leaf, maxBins=max_bins)


def boosted_trees(rounds=100, learning_rate=0.3, max_depth=11, colsample=0.8317, subsample=0.9099,
                  min_child_weight=3, gamma=0.292, n_rows=None, seed=0, features="features", label="label",
                  validation_col=None, tol=0.01):
    """Spark's own gradient boosting (first-order steps, no L2 leaf penalty, columns drawn per node); ``newton`` has the
    second-order kind with patience. ``gamma`` is a loss reduction summed over a node's rows, Spark's threshold one per row: it
    is divided by ``n_rows``, the rows of the largest node (without it no threshold is set). ``validation_col`` marks the evaluation
    rows; fitting ends in the first round whose error falls by less than a share ``tol``."""
    _check_depth(max_depth)
    kw = {}
    if validation_col:
        kw = {"validationIndicatorCol": validation_col, "validationTol": tol}
    return GBTClassifier(featuresCol=features, labelCol=label, maxIter=rounds, stepSize=learning_rate,
                         maxDepth=max_depth, subsamplingRate=subsample,
                         featureSubsetStrategy=str(colsample), minInstancesPerNode=int(min_child_weight),
                         minInfoGain=gamma / n_rows if n_rows else 0.0, seed=seed, **kw)


def linear_svm(alpha=1e-4, max_iter=100, tol=1e-3, features="features", label="label"):
    """Hinge-loss linear SVM; alpha is the L2 weight (l1_ratio is unused under L2)."""
    return LinearSVC(featuresCol=features, labelCol=label, regParam=alpha, maxIter=max_iter, tol=tol,
                     standardization=False)


def logistic(C=1.0, n_rows=None, max_iter=100, features="features", label="label"):
    """L2 logistic regression; scikit-learn's C maps to regParam = 1 / (C * n)."""
    reg = 1.0 / (C * n_rows) if n_rows else 1.0 / C
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=reg, maxIter=max_iter,
                              standardization=False)


def score_frame(pred: DataFrame, id_col: str = "id", label: str = "label", keep=()) -> DataFrame:
    """(id, label, prediction, score) from a transformed frame."""
    cols = pred.columns
    if "score" in cols:
        score = F.col("score").cast("double")
    elif "probability" in cols:
        score = vector_to_array(F.col("probability"))[1]
    elif "rawPrediction" in cols:
        m = vector_to_array(F.col("rawPrediction"))[1]
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-m))
    else:
        score = F.col("prediction").cast("double")
    return pred.select(id_col, *keep, F.col(label).cast("int").alias("label"),
                       F.col("prediction").cast("int").alias("prediction"), score.alias("score"))

