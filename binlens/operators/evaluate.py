"""Evaluation tables (E1-E18). Every function takes a scored DataFrame with columns
``label``, ``prediction`` and/or ``score`` and returns a small DataFrame.

Curves aggregate by distinct score first (a map-side combined ``groupBy``), so the only global
window runs over the distinct scores, not over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binlens.functions.ranking import running_sums


def _d(x) -> Column:
    return F.lit(float(x))


def accuracy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.groupBy(*by).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def _classes(df: DataFrame) -> list:
    """Distinct class values (a handful): labels and predictions."""
    vals = df.select(F.col("label").alias("c")).union(df.select(F.col("prediction").alias("c"))).distinct()
    return sorted(r["c"] for r in vals.collect() if r["c"] is not None)


def confusion_matrix(df: DataFrame, classes: list | None = None) -> DataFrame:
    """(label, prediction, n) with every cell of the class grid present (zeros included)."""
    classes = classes if classes is not None else _classes(df)
    spark: SparkSession = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], "label int, prediction int")
    counts = df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(grid).join(counts, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def confusion_normalized(df: DataFrame, classes: list | None = None) -> DataFrame:
    """Confusion cells divided by their true-label row total (0 for an empty row)."""
    cm = confusion_matrix(df, classes)
    tot = F.sum("n").over(Window.partitionBy("label"))
    return cm.withColumn("rate", F.when(tot > 0, F.col("n") / tot).otherwise(_d(0)))


def classification_report(df: DataFrame, classes: list | None = None) -> DataFrame:
    """Per-class precision / recall / f1 / support, then accuracy, macro and weighted averages.

    0/0 is reported as 0. Columns: ``row, precision, recall, f1_score, support``.
    """
    cm = confusion_matrix(df, classes)
    per = cm.groupBy().agg(F.sum("n").alias("total"))
    tp = cm.filter(F.col("label") == F.col("prediction")).select(F.col("label").alias("c"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"))
    pred = cm.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("npred"))
    stats = tp.join(sup, "c").join(pred, "c")
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(_d(0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(_d(0))
    stats = stats.select(F.col("c"), F.col("tp"), F.col("support"), prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                _d(2) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(_d(0))
    stats = stats.withColumn("f1_score", f1)
    rows = stats.select(F.col("c").cast("string").alias("row"), "precision", "recall", "f1_score",
                        F.col("support").cast("bigint").alias("support"))
    agg = stats.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"),
                    F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                    F.sum(F.col("precision") * F.col("support")).alias("wp"),
                    F.sum(F.col("recall") * F.col("support")).alias("wr"),
                    F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    safe = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(_d(0))
    acc = agg.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), safe("tp").alias("f1_score"),
                     F.col("n").cast("bigint").alias("support"))
    macro = agg.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1_score"), F.col("n").cast("bigint").alias("support"))
    weighted = agg.select(F.lit("weighted avg").alias("row"), safe("wp").alias("precision"), safe("wr").alias("recall"),
                          safe("wf").alias("f1_score"), F.col("n").cast("bigint").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def _score_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per (group, distinct score): positives p and negatives n (partial aggregation)."""
    return df.groupBy(*by, "score").agg(
        F.sum(F.col("label").cast("bigint")).alias("p"),
        F.sum((F.lit(1) - F.col("label")).cast("bigint")).alias("n"))


def _cumulative(df: DataFrame, by: list[str]) -> DataFrame:
    """Per (group, distinct score, descending): p, n, running tp / fp and the group totals.

    The running sums use a range-partitioned plan (``running_sums``), so unrounded scores - one
    distinct value per row - are never sorted in a single task; totals are a grouped aggregate
    joined back on the group key, or two numbers when there is no group."""
    sc = _score_counts(df, by)
    if by:
        c = running_sums(sc, by, [F.col("score").desc()], ["p", "n"])
        tot = sc.groupBy(*by).agg(F.sum("p").alias("tot_p"), F.sum("n").alias("tot_n"))
        c = c.join(tot, by)
    else:
        c = running_sums(sc.withColumn("_g", F.lit(0)), ["_g"], [F.col("score").desc()], ["p", "n"]).drop("_g")
        tot = sc.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
        c = c.withColumns({f"tot_{k}": F.lit(tot[k]).cast(sc.schema[k].dataType) for k in ("p", "n")})
    return c.withColumnRenamed("cum_p", "tp").withColumnRenamed("cum_n", "fp")


def roc_curve(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score, descending, plus the origin point
    whose threshold is the top score + 1. Null rates when a class is absent."""
    by = by or []
    c = _cumulative(df, by)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    pts = c.select(*by, F.col("score").alias("threshold"), rate("fp", "tot_n").alias("fpr"), rate("tp", "tot_p").alias("tpr"))
    origin = c.groupBy(*by).agg(F.max("score").alias("s"), F.max("tot_p").alias("tot_p"), F.max("tot_n").alias("tot_n")).select(
        *by, (F.col("s") + _d(1)).alias("threshold"),
        F.when(F.col("tot_n") > 0, _d(0)).alias("fpr"), F.when(F.col("tot_p") > 0, _d(0)).alias("tpr"))
    return origin.unionByName(pts)


def roc_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trapezoid area under the ROC curve (ties count half): sum(n*(tp_before + p/2)) / (P*N).
    Null when either class is absent."""
    by = by or []
    c = _cumulative(df, by)
    part = c.groupBy(*by).agg(
        F.sum(F.col("n") * (F.col("tp") - F.col("p") / _d(2))).alias("s"),
        F.max("tot_p").alias("tot_p"), F.max("tot_n").alias("tot_n"))
    return part.select(*by, F.when((F.col("tot_p") > 0) & (F.col("tot_n") > 0),
                                   F.col("s") / (F.col("tot_p") * F.col("tot_n"))).alias("auc"))


def pr_curve(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(threshold, precision, recall) per distinct score, descending, stopping at the first
    threshold that reaches full recall; then the end point (precision 1, recall 0, no threshold)."""
    by = by or []
    c = _cumulative(df, by).filter(F.col("tot_p") > 0).filter(F.col("tp") - F.col("p") < F.col("tot_p"))
    pts = c.select(*by, F.col("score").alias("threshold"),
                   (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                   (F.col("tp") / F.col("tot_p")).alias("recall"))
    end = c.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                          _d(1).alias("precision"), _d(0).alias("recall"))
    return pts.unionByName(end)


def relabel(df: DataFrame, t: float) -> DataFrame:
    """prediction = 1 when score >= t."""
    return df.withColumn("prediction", (F.col("score") >= F.lit(float(t))).cast("int"))


def threshold_confusion(df: DataFrame, t: float, classes=(0, 1)) -> DataFrame:
    return confusion_matrix(relabel(df, t), list(classes))


def nearest_threshold(df: DataFrame, t: float) -> DataFrame:
    """The PR-curve point whose threshold is closest to ``t`` (lower threshold on a tie)."""
    pr = pr_curve(df).filter(F.col("threshold").isNotNull())
    return pr.orderBy(F.abs(F.col("threshold") - F.lit(float(t))), F.col("threshold")).limit(1)


def calibration_curve(df: DataFrame, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Uniform bins on [0, 1] (edges i*(1+1e-8)/n, so 1.0 falls in the last bin); per non-empty
    bin: mean score, fraction of positives, count."""
    by = by or []
    b = F.least(F.floor(F.col("score") * F.lit(float(n_bins)) / F.lit(1.0 + 1e-8)).cast("int"), F.lit(n_bins - 1))
    return (df.withColumn("bin", b).groupBy(*by, "bin")
            .agg(F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("fraction_positive"),
                 F.count(F.lit(1)).alias("n")))


def score_histogram(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Counts over uniform bins [i/n, (i+1)/n) on [0, 1], the last bin closed; empty bins kept."""
    edges = [F.lit(i * (1.0 / n_bins)) for i in range(1, n_bins)]
    b = sum((F.col("score") >= e).cast("int") for e in edges)
    counts = df.filter((F.col("score") >= 0) & (F.col("score") <= 1)).withColumn("bin", b).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return F.broadcast(grid).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def misclassified(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.filter(F.col("label") != F.col("prediction")).select(id_col, "label", "prediction")


def confidence_table(df: DataFrame, id_col: str = "id") -> DataFrame:
    """id, prediction, P(positive), P(negative) from a probability score."""
    return df.select(id_col, F.col("prediction"), F.col("score").alias("p_positive"),
                     (_d(1) - F.col("score")).alias("p_negative"))
