"""The flagship slice: documents x labels -> stratified split -> one-hot + counts -> decision
tree -> scored -> classification report."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binlens.functions.ranking import stratified_holdout
from binlens.operators.evaluate import classification_report
from binlens.operators.features import one_hot_stages
from binlens.operators.models import decision_tree, score_frame
from binlens.plans.standins import doc_counts, labelled_docs

CATEGORICAL = ["lang", "source"]
NUMERIC = ["n_chars", "n_lines", "n_words"]


def prepared_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, label, lang, source, counts..., split) with a deterministic per-class holdout."""
    df = doc_counts(labelled_docs(spark, sf)).select(
        F.col("doc_id").alias("id"), "label", *CATEGORICAL, *[F.col(c).cast("double").alias(c) for c in NUMERIC])
    return stratified_holdout(df, "id", "label", test_every=5)


def feature_pipeline(extra_stages=()) -> Pipeline:
    return Pipeline(stages=one_hot_stages(CATEGORICAL, NUMERIC) + list(extra_stages))


def flagship_scored(spark: SparkSession, sf: str) -> DataFrame:
    df = prepared_docs(spark, sf)
    train, test = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")
    model = feature_pipeline([decision_tree(max_depth=5, min_leaf=1, seed=0)]).fit(train)
    return score_frame(model.transform(test))


def flagship_report(spark: SparkSession, sf: str) -> DataFrame:
    return classification_report(flagship_scored(spark, sf), classes=[0, 1])
