"""Encoding, statistics and selection.

Statistics are computed in long form ``(id, feature, value)``: one aggregate over all features
instead of one job per column. Estimators subclass ``pyspark.ml`` classes with default params
persistence, so they chain in a ``Pipeline`` and save/load with it.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- encoding

def one_hot_stages(categorical: list[str], numeric: list[str], output: str = "features") -> list:
    """Sorted-level one-hot with unknown levels ignored (all-zero block), then the numeric
    columns passed through after the encoded blocks."""
    idx = [f"{c}__idx" for c in categorical]
    ohe = [f"{c}__ohe" for c in categorical]
    stages = []
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=idx, stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        # the indexer maps unknown levels to an extra last index; dropLast removes exactly that slot,
        # so an unknown level encodes as all zeros and every known level keeps its own slot
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
    stages.append(VectorAssembler(inputCols=ohe + list(numeric), outputCol=output, handleInvalid="keep"))
    return stages


def feature_names(df: DataFrame, features_col: str = "features") -> DataFrame:
    """(feature_idx, feature) from the vector column's ML attribute metadata."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    pairs = []
    for group in meta.get("attrs", {}).values():
        for a in group:
            pairs.append((int(a["idx"]), str(a.get("name", f"f{a['idx']}"))))
    if not pairs:
        n = int(meta.get("num_attrs", 0))
        pairs = [(i, f"f{i}") for i in range(n)]
    return df.sparkSession.createDataFrame(sorted(pairs), "feature_idx int, feature string")


def to_long(df: DataFrame, id_col: str, features_col: str = "features", keep=()) -> DataFrame:
    """Non-zero vector entries as rows (id, feature_idx, value) (+ kept columns). A sparse vector gives
    its stored entries only; it is never made dense."""
    v = F.unwrap_udt(F.col(features_col))
    stored = F.transform(F.sequence(F.lit(0), F.size(v["values"]) - 1), lambda i: F.struct(
        F.when(v["type"] == 0, v["indices"][i]).otherwise(i).alias("feature_idx"), v["values"][i].alias("value")))
    entries = F.filter(F.when(F.size(v["values"]) > 0, stored), lambda e: e["value"] != 0)
    return df.select(id_col, *keep, F.explode(entries).alias("_e")).select(
        id_col, *keep, F.col("_e.feature_idx").alias("feature_idx"), F.col("_e.value").alias("value"))


# ---------------------------------------------------------------- statistics

def _class_counts(labels: DataFrame, label: str):
    """Per-class counts (one row per class reaches the driver) as literals."""
    rows = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n_y")).collect()
    counts = {r[label]: int(r["n_y"]) for r in rows}
    n_all = sum(counts.values())
    n_y = F.create_map(*[x for c, v in sorted(counts.items()) for x in (F.lit(c), F.lit(v))])
    classes = F.array(*[F.lit(c) for c in sorted(counts)])
    return counts, n_all, n_y, classes


def mutual_information(long_df: DataFrame, labels: DataFrame, feature: str = "feature", id_col: str = "id",
                       label: str = "label") -> DataFrame:
    """Discrete MI (natural log) between each feature's value and the label.

    ``long_df`` holds the non-zero cells ``(id, feature, value)``, and the label where it was carried
    along (then nothing is joined); the zero cells are implied: for each class, zeros = class count - non-zero count. Result: (feature, mi).
    """
    lab = labels.select(id_col, label)
    _, n_all, n_y, classes = _class_counts(lab, label)
    cells = ((long_df if label in long_df.columns else long_df.join(lab, id_col))
             .groupBy(feature, "value", label).agg(F.count(F.lit(1)).alias("c")))
    nz = cells.groupBy(feature, label).agg(F.sum("c").alias("c_nz"))
    feats = cells.select(feature).distinct().select(feature, F.explode(classes).alias(label))
    zeros = (feats.join(nz, [feature, label], "left")
             .select(feature, F.lit(0.0).alias("value"), label,
                     (n_y[F.col(label)] - F.coalesce(F.col("c_nz"), F.lit(0))).alias("c"))
             .filter(F.col("c") > 0))
    allc = cells.unionByName(zeros)
    w = Window.partitionBy(feature, "value")
    t = allc.withColumn("c_x", F.sum("c").over(w))
    n = F.lit(float(n_all))
    term = (F.col("c") / n) * F.log(F.col("c") * n / (F.col("c_x") * n_y[F.col(label)]))
    return t.groupBy(feature).agg(F.sum(term).alias("mi"))


def chi2_scores(long_df: DataFrame, labels: DataFrame, feature: str = "feature", id_col: str = "id",
                label: str = "label") -> DataFrame:
    """Chi-squared score of non-negative features against the label (scikit-learn's formula):
    O = sum of values per class, E = class share x feature total, sum((O - E)^2 / E)."""
    lab = labels.select(id_col, label)
    _, n_all, n_y, classes = _class_counts(lab, label)
    obs = (long_df if label in long_df.columns else long_df.join(lab, id_col)).groupBy(feature, label).agg(F.sum("value").alias("o"))
    tot = obs.groupBy(feature).agg(F.sum("o").alias("t"))
    grid = tot.select(feature, "t", F.explode(classes).alias(label))
    e = F.col("t") * n_y[F.col(label)] / F.lit(float(n_all))
    full = grid.join(obs, [feature, label], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    return full.groupBy(feature).agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("chi2"))


def top_k(scores: DataFrame, score_col: str, k: int, feature: str = "feature_idx") -> DataFrame:
    """Best ``k`` features by score; on a tie the higher index wins (as SelectKBest).

    Distributed top-k (``orderBy().limit(k)``); only the k kept rows are numbered."""
    order = [F.col(score_col).desc(), F.col(feature).desc()]
    return scores.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def population_std(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """stddev_pop per column in one pass; 0 becomes 1 (a constant column is left unchanged)."""
    row = df.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first()
    return {c: (float(row[c]) if row[c] not in (None, 0.0) else 1.0) for c in cols}


def scale_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Divide by population deviation, no centring."""
    std = population_std(df, cols)
    return df.select(*[(F.col(c) / F.lit(std[c])).alias(c) if c in std else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- estimators

class _HasK(Params):
    k = Param(Params._dummy(), "k", "number of features to keep", typeConverter=TypeConverters.toInt)
    scoreFunc = Param(Params._dummy(), "scoreFunc", "mi or chi2", typeConverter=TypeConverters.toString)


class TopKSelectorModel(Model, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    indices = Param(Params._dummy(), "indices", "kept feature indices", typeConverter=TypeConverters.toListInt)
    scores = Param(Params._dummy(), "scores", "score per kept index", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, featuresCol="features", outputCol="selected", indices=None, scores=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        return VectorSlicer(inputCol=self.getFeaturesCol(), outputCol=self.getOutputCol(),
                            indices=sorted(self.getOrDefault("indices"))).transform(df)


class TopKSelector(Estimator, HasFeaturesCol, HasLabelCol, HasOutputCol, _HasK, DefaultParamsReadable,
                   DefaultParamsWritable):
    """Keep the ``k`` features with the highest mutual information (``mi``, of discrete values; ``mi_knn``, of
    continuous ones by nearest neighbours) or chi-squared score (``chi2``) against the label. Scores come from long-form aggregates; only ``k`` indices reach
    the driver. More than there are features is an error."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", outputCol="selected", k=300, scoreFunc="mi"):
        super().__init__()
        self._setDefault(k=300, scoreFunc="mi", outputCol="selected")
        self._set(**self._input_kwargs)

    def _fit(self, df):
        # the label rides along with every entry, so rows need no key and nothing is joined
        tagged = df.select(F.lit(0).alias("id"), self.getFeaturesCol(), F.col(self.getLabelCol()).alias("label"))
        long_df = to_long(tagged, "id", self.getFeaturesCol(), keep=("label",))
        labels = tagged.select("id", "label")
        k = self.getOrDefault("k")
        if self.getOrDefault("scoreFunc") == "chi2":
            sc = chi2_scores(long_df, labels, feature="feature_idx").withColumnRenamed("chi2", "score")
        elif self.getOrDefault("scoreFunc") == "mi_knn":
            from binlens.operators.continuous_mi import mutual_information_knn
            sc = mutual_information_knn(long_df, labels, feature="feature_idx").withColumnRenamed("mi", "score")
        else:
            sc = mutual_information(long_df, labels, feature="feature_idx").withColumnRenamed("mi", "score")
        best = top_k(sc, "score", k).orderBy("rank").collect()
        picked = [(int(r["feature_idx"]), float(r["score"])) for r in best]
        if len(picked) < k:     # all-zero features score 0; on a tie the higher index wins
            width = len(df.select(self.getFeaturesCol()).first()[0])
            if k > width:
                raise ValueError(f"k = {k}, but there are {width} features")
            have = {i for i, _ in picked}
            picked += [(i, 0.0) for i in range(width - 1, -1, -1) if i not in have][:k - len(picked)]
        return TopKSelectorModel(featuresCol=self.getFeaturesCol(), outputCol=self.getOutputCol(),
                                 indices=[i for i, _ in picked], scores=[s for _, s in picked])


class PopulationScalerModel(Model, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    scale = Param(Params._dummy(), "scale", "1 / population std per slot", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, featuresCol="features", outputCol="scaled", scale=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        from pyspark.ml.feature import ElementwiseProduct
        from pyspark.ml.linalg import Vectors

        return ElementwiseProduct(scalingVec=Vectors.dense(self.getOrDefault("scale")),
                                  inputCol=self.getFeaturesCol(), outputCol=self.getOutputCol()).transform(df)


class PopulationScaler(Estimator, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Divide each slot by its population standard deviation (ddof 0), no centring; a constant
    slot is left unchanged. Spark's StandardScaler uses ddof 1 and zeroes constant slots."""

    @keyword_only
    def __init__(self, featuresCol="features", outputCol="scaled"):
        super().__init__()
        self._setDefault(outputCol="scaled")
        self._set(**self._input_kwargs)

    def _fit(self, df):
        from pyspark.ml.stat import Summarizer

        s = df.select(Summarizer.metrics("variance", "count").summary(F.col(self.getFeaturesCol())).alias("s")).first()["s"]
        n = float(s["count"])
        scale = []
        for v in s["variance"].toArray():
            pop = v * (n - 1) / n if n > 0 else 0.0
            scale.append(1.0 / pop ** 0.5 if pop > 0 else 1.0)
        return PopulationScalerModel(featuresCol=self.getFeaturesCol(), outputCol=self.getOutputCol(), scale=scale)
