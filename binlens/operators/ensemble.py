"""Voting and family combination (D13, D14, D16) over long prediction tables
``(model, id, prediction, score)``; grouped aggregates only (order-free)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vote_hard(preds: DataFrame, id_col: str = "id") -> DataFrame:
    """Majority class per id; a tie goes to the lowest class."""
    votes = preds.groupBy(id_col, "prediction").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(id_col).agg(F.max_by("prediction", F.struct(F.col("votes"), -F.col("prediction"))).alias("prediction"),
                                     F.sum("votes").alias("n_models"))
    return best


def vote_soft(preds: DataFrame, id_col: str = "id") -> DataFrame:
    """Mean positive-class probability; class 1 only when it is strictly above one half
    (argmax picks the lower class on a tie)."""
    m = preds.groupBy(id_col).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_models"))
    return m.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def vote_families(*families: DataFrame, id_col: str = "id") -> DataFrame:
    """Full outer join of per-family score tables (id, score_<family>) on id; the combined
    score is the mean of the non-null family scores."""
    out = families[0]
    for f in families[1:]:
        out = out.join(f, id_col, "full_outer")
    cols = [c for c in out.columns if c != id_col]
    present = sum(F.col(c).isNotNull().cast("int") for c in cols)
    total = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in cols)
    return out.select(id_col, present.alias("n_families"), (total / present).alias("score"))
