"""Fitted trees as a table of nodes (D19), read from the saved model's own files: nothing passes through the driver.

Columns: tree, node, feature_idx (null in a leaf), threshold (``x <= threshold`` goes left), left, right, gain, impurity, n, prediction and
weights (the classes' weights).
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binlens.session import scratch_path


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a decision tree or an ensemble saved by Spark's writer. Splits on categories have no threshold."""
    raw = spark.read.parquet(os.path.join(path, "data"))
    if "nodeData" in raw.columns:
        raw = raw.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        raw = raw.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0

    def where_inner(c):
        return F.when(inner, c)

    return raw.select("tree", F.col("id").alias("node"), where_inner(F.col("split.featureIndex")).alias("feature_idx"),
                      where_inner(F.when(F.col("split.numCategories") < 0, F.element_at("split.leftCategoriesOrThreshold", 1))).alias("threshold"),
                      where_inner(F.col("leftChild")).alias("left"), where_inner(F.col("rightChild")).alias("right"), where_inner(F.col("gain")).alias("gain"),
                      "impurity", F.col("rawCount").alias("n"), F.col("prediction").cast("int").alias("prediction"), F.col("impurityStats").alias("weights"))


def tree_nodes(spark: SparkSession, model) -> DataFrame:
    path = scratch_path(spark, f"trees-{uuid.uuid4().hex}")
    model.write().save(path)
    return read_nodes(spark, path)


def walk(df: DataFrame, nodes: DataFrame, depth: int, id_col: str = "id", features_col: str = "features") -> DataFrame:
    """(id, tree, node, prediction, weights) of the leaf that each row reaches in each tree: one join with the node table for each level."""
    value = F.element_at(F.col("x"), F.col("feature_idx") + 1)
    keep = [id_col, "x", "tree", "node"]
    trees = nodes.where(F.col("node") == 0).agg(F.max("tree")).first()[0] or 0
    at = df.select(id_col, vector_to_array(F.col(features_col)).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(trees))).alias("tree")).withColumn("node", F.lit(0))
    steps = nodes.select("tree", "node", "feature_idx", "threshold", "left", "right")
    for _ in range(depth):
        go = F.when(F.col("feature_idx").isNull(), F.col("node")).when(value <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(steps, ["tree", "node"]).withColumn("node", go).select(*keep)
    return at.join(nodes.select("tree", "node", "prediction", "weights"), ["tree", "node"]).select(id_col, "tree", "node", "prediction", "weights")


#: Share of each feature in the impurity decrease of a tree, over the view ``nodes``.
GAINS_SQL = """
SELECT feature_idx, count(*) AS splits, sum(gain * n) / sum(sum(gain * n)) OVER () AS importance
FROM nodes WHERE feature_idx IS NOT NULL GROUP BY feature_idx"""


def split_gains(nodes: DataFrame) -> DataFrame:
    return nodes.sparkSession.sql(GAINS_SQL.replace("FROM nodes", "FROM {nodes}"), nodes=nodes)
