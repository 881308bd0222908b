"""A uniform fit / score interface over Spark ML estimators and the custom models.

``builders(...)[name](train)`` returns a ``Fitted`` whose ``score(df)`` yields
``(id, label, prediction, score)``; ``fit_roster`` fits several models concurrently from a
thread pool (Spark runs the jobs of different threads side by side, as ``CrossValidator``'s
``parallelism`` does), all reading the same prepared table.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binlens.operators import boosting, knn, models, network, newton, sgd
from binlens.operators.ensemble import vote_hard, vote_soft
from binlens.operators.models import score_frame


class Fitted:
    def __init__(self, name: str, scorer: Callable[[DataFrame], DataFrame], model=None):
        self.name, self._scorer, self.model = name, scorer, model

    def score(self, df: DataFrame) -> DataFrame:
        """(id, label, prediction int, score double) for every row of ``df``."""
        return self._scorer(df)


def fitted(name: str, model) -> Fitted:
    """Any fitted model with ``transform``."""
    return Fitted(name, lambda df: score_frame(model.transform(df)), model)


def _spark_ml(name, est):
    return lambda train: fitted(name, est.fit(train))


def _custom(name, fitter):
    return lambda train: fitted(name, fitter(train))


def knn_scores(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, label, prediction, score): majority label of the k nearest training rows (tie ->
    lowest label); score = share of neighbours in class 1."""
    vec = vector_to_array(F.col("features"))
    t = train.select("id", vec.alias("vec"), "label")
    q = queries.select("id", vec.alias("vec"))
    nb = knn.nearest_neighbours(t, q, k, id_col="id", vec_col="vec", label_col="label")
    pred = knn.knn_predict(nb)
    share = nb.groupBy("qid").agg(F.avg((F.col("label") == 1).cast("double")).alias("score"))
    return (queries.select("id", F.col("label").cast("int").alias("label"))
            .join(pred.join(share, "qid").withColumnRenamed("qid", "id"), "id")
            .select("id", "label", F.col("prediction").cast("int").alias("prediction"), "score"))


class KnnModel:
    """The training rows and k; ``transform`` gives (id, label, prediction, score)."""

    def __init__(self, rows: DataFrame, k: int):
        self.rows, self.k = rows.select("id", "label", "features"), k

    def transform(self, df: DataFrame) -> DataFrame:
        return knn_scores(self.rows, df, self.k)


def _knn(name, k):
    return lambda train: fitted(name, KnnModel(train, k))


def builders(n_features: int, n_rows: int | None = None, ensemble: bool = False) -> dict[str, Callable[[DataFrame], Fitted]]:
    """The roster with the settings of the model comparison, or of the ensembles' members (another forest and
    a narrower network). The iteration limits of the linear SVM and the network are Spark's solvers' own."""
    return {
        "knn": _knn("knn", 3),
        "linear_svm": _spark_ml("linear_svm", models.linear_svm(alpha=8.59067138335719e-05, max_iter=100, tol=1e-3)),
        "decision_tree": _spark_ml("decision_tree", models.decision_tree(max_depth=5, min_leaf=1, seed=0)),
        "random_forest": _spark_ml("random_forest", models.random_forest(n_trees=18, max_depth=5, max_features=3, seed=1) if ensemble
                                   else models.random_forest(n_trees=10, max_depth=3, max_features="auto", seed=1)),
        "boosting": _custom("boosting", lambda tr: newton.fit_boosted(tr, rounds=100)),
        "mlp": _custom("mlp", lambda tr: network.fit_network(tr, hidden=(21,) if ensemble else (100,), alpha=0.012 if ensemble else 1.0, max_iter=1000)),
        "adaboost": _custom("adaboost", lambda tr: boosting.fit_adaboost(tr, rounds=50)),
        "logistic": _spark_ml("logistic", models.logistic(C=1.0, n_rows=n_rows)),
        "sgd_modified_huber": _custom("sgd_modified_huber", lambda tr: sgd.fit_sgd(tr, loss="modified_huber", alpha=1e-4)),
        "sgd_perceptron": _custom("sgd_perceptron", lambda tr: sgd.fit_sgd(tr, loss="perceptron", alpha=1e-4)),
    }


def fit_roster(train: DataFrame, names: list[str], n_features: int, n_rows: int | None = None,
               parallelism: int = 8, ensemble: bool = False) -> dict[str, Fitted]:
    b = builders(n_features, n_rows, ensemble)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        futs = {n: pool.submit(b[n], train) for n in names}
        return {n: f.result() for n, f in futs.items()}


def scored_union(fitted: dict[str, Fitted], df: DataFrame, split: str | None = None) -> DataFrame:
    """Long table (model, [split,] id, label, prediction, score) of every fitted model on ``df``."""
    out = None
    for name, f in fitted.items():
        s = f.score(df).select(F.lit(name).alias("model"), "*")
        if split is not None:
            s = s.withColumn("split", F.lit(split))
        out = s if out is None else out.unionByName(s)
    return out


# ---------------------------------------------------------------- ensembles as models

class VoteModel:
    """Members' votes: the majority (tie -> lowest class; the score is the share of class 1), or the mean score."""

    def __init__(self, members: dict[str, Fitted], soft: bool):
        self.members, self.soft = members, soft

    def transform(self, df: DataFrame) -> DataFrame:
        long = scored_union(self.members, df)
        share = long.groupBy("id", "label").agg(F.avg("prediction").alias("score"))
        voted = vote_soft(long).select("id", "prediction", "score") if self.soft else vote_hard(long).select("id", "prediction")
        return voted.join(share.drop("score") if self.soft else share, "id").select("id", "label", "prediction", "score")


class StackModel:
    """Members whose scores, in the order of their names' list, are the features ``stack`` of the head."""

    def __init__(self, members: dict[str, Fitted], head):
        self.members, self.head = members, head

    def transform(self, df: DataFrame) -> DataFrame:
        return score_frame(self.head.transform(stack_features(scored_union(self.members, df), list(self.members))))


def stack_features(scores: DataFrame, bases: list[str]) -> DataFrame:
    """Long (model, id, label, score) -> (id, label, stack) with one slot per base model."""
    wide = scores.groupBy("id", "label").pivot("model", bases).agg(F.first("score"))
    return VectorAssembler(inputCols=bases, outputCol="stack").transform(wide)
