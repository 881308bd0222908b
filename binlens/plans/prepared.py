"""The prepared training table (A10): labelled documents -> split and CV folds -> one-hot +
counts -> population scaling, fitted on the training rows only and written once as parquet to
the shared checkpoint folder. Every model query reads that table instead of recomputing the
encoding, and a lost executor re-reads files instead of replaying the lineage.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import MaxAbsScaler, SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binlens.functions.ranking import group_position, md5_key
from binlens.operators.features import PopulationScaler, feature_names, one_hot_stages
from binlens.plans.standins import doc_counts, labelled_docs
from binlens.session import scratch_path

CATEGORICAL = ["lang", "source"]
NUMERIC = ["n_chars", "n_lines", "n_words"]
TEST_EVERY = 5      # every 5th row of a class (md5 order) is held out
CV_FOLDS = 5        # stratified folds inside the training rows

_WRITTEN: dict[tuple[str, str], tuple[str, list[tuple[int, str]]]] = {}


def split_and_folds(df: DataFrame, id_col: str = "id", label_col: str = "label", test_every: int = TEST_EVERY,
                    k: int = CV_FOLDS) -> DataFrame:
    """One position pass per class (md5 order) gives both the holdout and the CV folds:
    split = test when p = pos - 1 is a multiple of ``test_every``; a training row's rank among the
    training rows of its class is p - (p div test_every) - 1, and cv_fold = that rank % k (-1 on
    test rows). Class counts per fold differ by at most one."""
    pos = group_position(df.withColumn("_h", md5_key(id_col)), [label_col], ["_h", id_col], name="_pos")
    p = F.col("_pos") - 1
    is_test = (p % test_every) == 0
    return (pos.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
               .withColumn("cv_fold", F.when(is_test, F.lit(-1)).otherwise((p - F.floor(p / test_every) - 1) % k).cast("int"))
               .drop("_h", "_pos"))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    df = doc_counts(labelled_docs(spark, sf)).select(
        F.col("doc_id").alias("id"), F.col("label").cast("int").alias("label"), *CATEGORICAL,
        *[F.col(c).cast("double").alias(c) for c in NUMERIC])
    return split_and_folds(df)


def feature_pipeline(scaler: str | None = "population") -> Pipeline:
    """One-hot + counts -> ``raw``; then ``features`` = population scaling (default), max-abs
    scaling (the commented-out alternative, C23) or ``raw`` unchanged."""
    stages = one_hot_stages(CATEGORICAL, NUMERIC, output="raw")
    if scaler == "population":
        stages.append(PopulationScaler(featuresCol="raw", outputCol="features"))
    elif scaler == "maxabs":
        stages.append(MaxAbsScaler(inputCol="raw", outputCol="features"))
    elif scaler is None:
        stages.append(SQLTransformer(statement="SELECT *, raw AS features FROM __THIS__"))
    else:
        raise ValueError(scaler)
    return Pipeline(stages=stages)


def prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, list[tuple[int, str]]]:
    """(id, label, split, cv_fold, features) read from the materialised table, plus the
    (index, name) list of the feature slots. Built once per session and scale factor."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        base = _base(spark, sf)
        model = feature_pipeline().fit(base.filter(F.col("split") == "train"))
        out = model.transform(base)
        names = [tuple(r) for r in feature_names(out, "raw").collect()]
        path = scratch_path(spark, f"prepared-{uuid.uuid4().hex}")
        (out.select("id", "label", "split", "cv_fold", "features")
            .write.mode("overwrite").parquet(path))
        _WRITTEN[key] = (path, names)
    path, names = _WRITTEN[key]
    return spark.read.parquet(path), names


def train_test(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[tuple[int, str]]]:
    df, names = prepared(spark, sf)
    return df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test"), names


def names_frame(spark: SparkSession, names: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(names, "feature_idx int, feature string")
