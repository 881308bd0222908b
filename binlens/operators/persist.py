"""Saving and loading of every model and ensemble (A9), on any file system that Spark writes to.

A model is a folder: ``state`` holds one JSON text (kind and numbers: the size of the model, not of the data), ``rows`` a table where the
model is one (nearest neighbours), ``spark`` a model of Spark's own in its own format, and ``members/<name>`` the parts of an
ensemble. ``load_model`` needs the folder alone, in any session.
"""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from binlens.operators import roster
from binlens.operators.boosting import AdaBoostModel
from binlens.operators.network import NetworkModel
from binlens.operators.newton import BoostedModel, Ensemble
from binlens.operators.reduce import NmfModel, NystroemModel
from binlens.operators.sgd import SGDLinearModel
from binlens.operators.trees import Forest, TreeModel


def _arrays(obj, names) -> dict:
    return {n: np.asarray(getattr(obj, n)).tolist() for n in names}


def _typed(blank, given: dict) -> dict:
    """Lists as arrays of the types that a blank object has."""
    return {n: np.asarray(v, getattr(blank, n).dtype) for n, v in given.items()}


_FOREST = ("feature", "cut", "left", "a", "b", "gain", "tree", "depth", "parent")
_ENSEMBLE = ("feature", "cut", "left", "values", "roots")


def _state(model) -> dict | None:
    if isinstance(model, AdaBoostModel):
        return {"kind": "adaboost", "stages": [list(s) for s in model.stages], "features_col": model.features_col,
                "learning_rate": model.learning_rate}
    if isinstance(model, SGDLinearModel):
        return {"kind": "sgd", "coef": model.coef, "intercept": model.intercept, "loss": model.loss,
                "features_col": model.features_col}
    if isinstance(model, NetworkModel):
        return {"kind": "network", "sizes": model.sizes, "weights": model.weights.tolist(), "features_col": model.features_col, "epochs": model.epochs}
    if isinstance(model, TreeModel):
        return {"kind": "trees", "trees": model.forest.trees, "forest": _arrays(model.forest, _FOREST), "thresholds": model.thresholds, "features_col": model.features_col}
    if isinstance(model, BoostedModel):
        return {"kind": "boosted", "ensemble": _arrays(model.ensemble, _ENSEMBLE), "levels": model.ensemble.levels, "thresholds": model.thresholds, "rounds": model.rounds,
                "trace": model.trace, "features_col": model.features_col}
    if isinstance(model, NystroemModel):
        return {"kind": "nystroem", **_arrays(model, ("landmarks", "normalization")),
                **{n: getattr(model, n) for n in ("kernel", "gamma", "degree", "coef0", "features_col", "output_col")}}
    if isinstance(model, NmfModel):
        return {"kind": "nmf", "H": model.H.tolist(), "features_col": model.features_col, "output_col": model.output_col}
    if isinstance(model, roster.KnnModel):
        return {"kind": "knn", "k": model.k}
    if isinstance(model, roster.VoteModel):
        return {"kind": "vote", "soft": model.soft, "members": list(model.members)}
    if isinstance(model, roster.StackModel):
        return {"kind": "stack", "members": list(model.members)}
    if hasattr(model, "write"):
        return {"kind": "spark"}
    raise TypeError(type(model).__name__)


def save_model(spark: SparkSession, model, path: str) -> None:
    state = _state(model)
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "state"))
    if state["kind"] == "spark":
        model.write().overwrite().save(os.path.join(path, "spark"))
    elif state["kind"] == "knn":
        model.rows.write.mode("overwrite").parquet(os.path.join(path, "rows"))
    elif state["kind"] in ("vote", "stack"):
        for name, member in model.members.items():
            save_model(spark, member.model, os.path.join(path, "members", name))
        if state["kind"] == "stack":
            save_model(spark, model.head, os.path.join(path, "head"))


def load_model(spark: SparkSession, path: str):
    s = json.loads(spark.read.text(os.path.join(path, "state")).first()[0])
    kind = s["kind"]
    if kind == "adaboost":
        return AdaBoostModel([tuple(x) for x in s["stages"]], s["features_col"], s["learning_rate"])
    if kind == "sgd":
        return SGDLinearModel(s["coef"], s["intercept"], s["loss"], s["features_col"])
    if kind == "network":
        return NetworkModel(s["sizes"], s["weights"], s["features_col"], s["epochs"])
    if kind == "trees":
        return TreeModel(Forest(s["trees"], **_typed(Forest(0), s["forest"])), s["thresholds"], s["features_col"])
    if kind == "boosted":
        e = _typed(Ensemble(), s["ensemble"])
        e["roots"] = e["roots"].reshape(-1, 3)
        return BoostedModel(Ensemble(**e, levels=s["levels"]), s["thresholds"], s["rounds"], [tuple(t) for t in s["trace"]], s["features_col"])
    if kind == "nystroem":
        return NystroemModel(np.array(s["landmarks"]), np.array(s["normalization"]), s["kernel"], s["gamma"], s["degree"], s["coef0"], s["features_col"], s["output_col"])
    if kind == "nmf":
        return NmfModel(np.array(s["H"]), s["features_col"], s["output_col"])
    if kind == "knn":
        return roster.KnnModel(spark.read.parquet(os.path.join(path, "rows")), s["k"])
    if kind == "spark":
        return DefaultParamsReader.loadParamsInstance(os.path.join(path, "spark"), spark.sparkContext)
    if kind in ("vote", "stack"):
        members = {n: roster.fitted(n, load_model(spark, os.path.join(path, "members", n))) for n in s["members"]}
        return roster.VoteModel(members, s["soft"]) if kind == "vote" else roster.StackModel(members, load_model(spark, os.path.join(path, "head")))
    raise ValueError(kind)
