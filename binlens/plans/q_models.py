"""Model queries (D1-D19, C13, C19-C22, E15, E16) over the prepared table.

Fits are not SQL-expressible, so these queries carry no oracle; their behaviour is pinned by
``tests/test_models.py`` (separable data, seeds, save/load). Every query reads the whole
labelled document set; model settings are the reference's, except where a search budget is
named in the query's doc string.
"""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce as reduce_frames

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binlens.operators import kernel_svm, models, network, newton, reduce, roster, sparse_svd, tree_table
from binlens.operators.persist import load_model, save_model
from binlens.operators.evaluate import classification_report
from binlens.operators.models import score_frame
from binlens.plans.prepared import CV_FOLDS, names_frame, prepared, train_test
from binlens.plans.registry import query
from binlens.session import cut_lineage, scratch_path
from binlens.sources.tables import table

R = 6


def _model_rows(name: str, fitted: roster.Fitted, test: DataFrame) -> DataFrame:
    return fitted.score(test).select(F.lit(name).alias("model"), "id", "label", "prediction",
                                     F.round("score", R).alias("score"))


def _fit_one(spark, sf, name):
    train, test, names = train_test(spark, sf)
    n = train.count()
    f = roster.builders(len(names), n)[name](train)
    return _model_rows(name, f, test)


# ---------------------------------------------------------------- prepared data

@query("prepared_features")
def q_prepared(spark: SparkSession, sf: str) -> DataFrame:
    df, _ = prepared(spark, sf)
    return df.select("id", "label", "split", "cv_fold", vector_to_array("features").alias("features"))


# Oracle for the prepared table: the same split (md5 position per class), the same sorted
# levels taken from the training rows, one-hot slots then the counts, each slot divided by its
# population deviation over the training rows (1 when constant).
PREPARED_SQL = """
WITH lab AS (
  SELECT d.doc_id AS id, l.quality AS label, d.lang, d.source, cast(d.n_chars AS DOUBLE) AS n_chars,
         cast(len(string_split(d.text, chr(10))) AS DOUBLE) AS n_lines,
         cast(len(string_split(d.text, ' ')) AS DOUBLE) AS n_words
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(cast(id AS VARCHAR)), id) - 1 AS p FROM lab),
s AS (SELECT *, CASE WHEN p % 5 = 0 THEN 'test' ELSE 'train' END AS split,
             cast(CASE WHEN p % 5 = 0 THEN -1 ELSE (p - p // 5 - 1) % 5 END AS INTEGER) AS cv_fold FROM p),
tr AS (SELECT * FROM s WHERE split = 'train'),
ntr AS (SELECT count(*) * 1.0e0 AS n FROM tr),
langs AS (SELECT lang AS lvl, row_number() OVER (ORDER BY lang) - 1 AS idx, count(*) AS c FROM tr GROUP BY lang),
nl AS (SELECT count(*) AS k FROM langs),
srcs AS (SELECT source AS lvl, row_number() OVER (ORDER BY source) - 1 AS idx, count(*) AS c FROM tr GROUP BY source),
ns AS (SELECT count(*) AS k FROM srcs),
slots AS (
  SELECT 'lang' AS col, lvl, idx, c FROM langs
  UNION ALL SELECT 'source', lvl, (SELECT k FROM nl) + idx, c FROM srcs),
sc AS (SELECT col, lvl, idx, CASE WHEN c < n THEN 1.0e0 / sqrt((c / n) * (1.0e0 - c / n)) ELSE 1.0e0 END AS scale
       FROM slots, ntr),
base AS (SELECT (SELECT k FROM nl) + (SELECT k FROM ns) AS b),
num AS (SELECT CASE WHEN stddev_pop(n_chars) > 0 THEN 1.0e0 / stddev_pop(n_chars) ELSE 1.0e0 END AS s_chars,
               CASE WHEN stddev_pop(n_lines) > 0 THEN 1.0e0 / stddev_pop(n_lines) ELSE 1.0e0 END AS s_lines,
               CASE WHEN stddev_pop(n_words) > 0 THEN 1.0e0 / stddev_pop(n_words) ELSE 1.0e0 END AS s_words FROM tr),
e AS (
  SELECT s.id, s.split, s.cv_fold, sc.idx AS feature_idx, sc.scale AS value FROM s JOIN sc ON sc.col = 'lang' AND s.lang = sc.lvl
  UNION ALL SELECT s.id, s.split, s.cv_fold, sc.idx, sc.scale FROM s JOIN sc ON sc.col = 'source' AND s.source = sc.lvl
  UNION ALL SELECT id, split, cv_fold, b, n_chars * s_chars FROM s, base, num
  UNION ALL SELECT id, split, cv_fold, b + 1, n_lines * s_lines FROM s, base, num
  UNION ALL SELECT id, split, cv_fold, b + 2, n_words * s_words FROM s, base, num)
"""


@query("prepared_features_long", PREPARED_SQL + """
SELECT id, split, cv_fold, cast(feature_idx AS INTEGER) AS feature_idx, round(value, 6) AS value FROM e WHERE value <> 0""")
def q_prepared_long(spark: SparkSession, sf: str) -> DataFrame:
    """A10 / C10-C12 / C16 / C18 as the long twin of the matrix: non-zero slots only."""
    df, _ = prepared(spark, sf)
    return (df.select("id", "split", "cv_fold", F.posexplode(vector_to_array("features")).alias("feature_idx", "value"))
              .filter(F.col("value") != 0)
              .select("id", "split", "cv_fold", F.col("feature_idx").cast("int").alias("feature_idx"),
                      F.round("value", 6).alias("value")))


@query("feature_names", PREPARED_SQL + """
SELECT cast(idx AS INTEGER) AS feature_idx, col || '__ohe_' || lvl AS feature FROM sc
UNION ALL SELECT cast(b + i AS INTEGER), nm FROM base, (VALUES (0, 'n_chars'), (1, 'n_lines'), (2, 'n_words')) t(i, nm)""")
def q_feature_names(spark: SparkSession, sf: str) -> DataFrame:
    _, names = prepared(spark, sf)
    return names_frame(spark, names)


# ---------------------------------------------------------------- single fits

@query("fit_decision_tree")
def q_dt(spark, sf):
    return _fit_one(spark, sf, "decision_tree")


@query("fit_random_forest")
def q_rf(spark, sf):
    return _fit_one(spark, sf, "random_forest")


@query("fit_gbt")
def q_gbt(spark, sf):
    return _fit_one(spark, sf, "boosting")


_STOPPED: dict[tuple, newton.BoostedModel] = {}


def early_stopped(spark: SparkSession, sf: str) -> newton.BoostedModel:
    """Up to 1,000 rounds, 10 rounds' patience on the rmse of CV fold 0 of the training rows (not the test rows); the trees of the best
    round are kept. Fitted once per session and scale factor."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STOPPED:
        _STOPPED[key] = newton.fit_boosted(train_test(spark, sf)[0], rounds=1000, held_fold=0, fold_col="cv_fold", patience=10)
    return _STOPPED[key]


@query("fit_gbt_early_stop")
def q_gbt_es(spark, sf):
    """The scores of the early-stopped booster on the test rows, and the rounds it kept."""
    test, m = train_test(spark, sf)[1], early_stopped(spark, sf)
    return m.transform(test).select(F.lit("boosting_early_stop").alias("model"), "id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
                                    F.round("score", R).alias("score"), F.lit(m.rounds).alias("rounds"))


@query("boosting_trace")
def q_boosting_trace(spark, sf):
    """The error of every round on the fitted and the held-out rows, and whether its trees were kept."""
    m = early_stopped(spark, sf)
    rows = [(r, round(a, R), round(b, R), r <= m.rounds) for r, a, b in m.trace]
    return spark.createDataFrame(rows, "round int, train_rmse double, validation_rmse double, kept boolean")


@query("fit_linear_svm")
def q_svm(spark, sf):
    return _fit_one(spark, sf, "linear_svm")


@query("fit_logistic")
def q_lr(spark, sf):
    return _fit_one(spark, sf, "logistic")


@query("fit_mlp")
def q_mlp(spark, sf):
    return _fit_one(spark, sf, "mlp")


@query("fit_adaboost")
def q_ada(spark, sf):
    return _fit_one(spark, sf, "adaboost")


@query("fit_sgd_losses")
def q_sgd(spark, sf):
    """The two losses Spark lacks, by distributed full-batch sub-gradient steps."""
    train, test, names = train_test(spark, sf)
    fitted = roster.fit_roster(train, ["sgd_modified_huber", "sgd_perceptron"], len(names), parallelism=2)
    return roster.scored_union(fitted, test).select("model", "id", "label", "prediction", F.round("score", R).alias("score"))


@query("fit_knn")
def q_knn(spark, sf):
    """D8 on the prepared matrix: k = 3, euclidean, exact."""
    return _fit_one(spark, sf, "knn")


# ---------------------------------------------------------------- kernel map and reductions

@query("nystroem_map")
def q_nystroem(spark, sf):
    """RBF (gamma 0.2) Nystroem map with 250 landmarks, applied to every row."""
    df, _ = prepared(spark, sf)
    m = reduce.fit_nystroem(df.filter(F.col("split") == "train"), n_components=250, kernel="rbf", gamma=0.2)
    return m.transform(df).select("id", "split", vector_to_array("kernel_features").alias("kernel_features"))


@query("fit_kernel_svm_approx")
def q_kernel_svm(spark, sf):
    """Nystroem RBF features + linear hinge SVM, regParam = 1 / (C n) with C = 1."""
    train, test, _ = train_test(spark, sf)
    n = train.count()
    ny = reduce.fit_nystroem(train, n_components=250, kernel="rbf", gamma=0.2)
    svm = LinearSVC(featuresCol="kernel_features", labelCol="label", regParam=1.0 / n, maxIter=100,
                    standardization=False).fit(ny.transform(train))
    return score_frame(svm.transform(ny.transform(test))).select(
        F.lit("kernel_svm").alias("model"), "id", "label", "prediction", F.round("score", R).alias("score"))


#: (kernel, C, gamma, coef0) of ``kernel_svm_kernels``.
KERNEL_SETTINGS = [("linear", 1.0, 0.2, 0.0), ("poly", 1.0, 0.2, 1.0), ("rbf", 1.0, 0.2, 0.0), ("rbf", 10.0, 1.0, 0.0), ("sigmoid", 1.0, 0.2, 0.0)]


@query("kernel_svm_kernels")
def q_kernels(spark, sf):
    """Every kernel, fitted on the training rows; accuracy on the test rows."""
    train, test, _ = train_test(spark, sf)

    def one(setting):
        kernel, C, gamma, coef0 = setting
        scored = kernel_svm.fit_kernel_svm(train, kernel, C, gamma, coef0=coef0).transform(test)
        return scored.agg(F.count(F.lit(1)).alias("n_test"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).select(
            F.lit(kernel).alias("kernel"), F.lit(C).alias("C"), F.lit(gamma).alias("gamma"), "n_test", F.round("a", R).alias("test_accuracy"))

    with ThreadPoolExecutor(max_workers=len(KERNEL_SETTINGS)) as pool:
        return reduce_frames(DataFrame.unionByName, list(pool.map(one, KERNEL_SETTINGS)))


@query("svd_project")
def q_svd(spark, sf):
    """Uncentred truncated SVD with 10 components of the whole prepared matrix."""
    df, _ = prepared(spark, sf)
    proj, s, _ = reduce.svd(df, 10, "id", "features")
    return proj.select("id", F.transform("components", lambda c: F.round(c, R)).alias("components"))


TOKEN_COLUMNS = 20_000
#: Documents whose words one task counts: its memory grows neither with the table nor with the texts.
DOCS_OF_A_TASK = 2_000
#: Characters of their texts.
TEXT_OF_A_TASK = 8_000_000


@query("svd_tokens")
def q_svd_tokens(spark, sf):
    """C19 on a wide sparse matrix: counts of all documents' words in 20,000 hashed columns, 10 components by 10 power iterations."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    n, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / DOCS_OF_A_TASK), math.ceil((chars or 0) / TEXT_OF_A_TASK))
    words = docs.repartition(parts, "doc_id").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), 0)).alias("word"))
    cells = words.select("doc_id", F.pmod(F.xxhash64("word"), F.lit(TOKEN_COLUMNS)).cast("int").alias("feature_idx")).groupBy("doc_id", "feature_idx").agg(F.count(F.lit(1)).alias("value"))
    proj, _, _ = sparse_svd.randomised_svd(cut_lineage(sparse_svd.sparse_rows(cells, "doc_id")), TOKEN_COLUMNS, 10, n_iter=10)
    return proj.select("id", F.transform("components", lambda c: F.round(c, 3)).alias("components"))


@query("nmf_factorize")
def q_nmf(spark, sf):
    """C20: NMF with 10 components, NNDSVD start, multiplicative updates (tol 1e-4, at most
    200 steps)."""
    df, _ = prepared(spark, sf)
    W, H, _ = reduce.nmf(df, 10, "id", "features", max_iter=200, tol=1e-4)
    return W.select("id", F.transform("w", lambda c: F.round(c, R)).alias("w"))


# ---------------------------------------------------------------- importances

def _importances(spark, model, names) -> DataFrame:
    imp = model.featureImportances.toArray().tolist()
    rows = [(i, nm, float(imp[i]) if i < len(imp) else 0.0) for i, nm in names]
    return spark.createDataFrame(rows, "feature_idx int, feature string, importance double")


@query("select_from_tree")
def q_select_tree(spark, sf):
    """The 10 features with the largest depth-5 tree importances (stable: lower index
    first on a tie)."""
    train, _, names = train_test(spark, sf)
    m = models.decision_tree(max_depth=5, min_leaf=1, seed=0).fit(train)
    imp = _importances(spark, m, names)
    return (imp.orderBy(F.col("importance").desc(), F.col("feature_idx")).limit(10)
            .select("feature_idx", "feature", F.round("importance", R).alias("importance")))


@query("feature_importances")
def q_importances(spark, sf):
    """Forest (18 trees, depth 5, 3 features per split) importances above 0.01, descending."""
    train, _, names = train_test(spark, sf)
    m = models.random_forest(n_trees=18, max_depth=5, max_features=3, seed=1).fit(train)
    imp = _importances(spark, m, names)
    return (imp.filter(F.col("importance") > 0.01)
            .select("feature_idx", "feature", F.round("importance", R).alias("importance")))


def _tree(spark, sf):
    train, test, names = train_test(spark, sf)
    return models.decision_tree(max_depth=5, min_leaf=1, seed=0).fit(train), test, names


@query("tree_nodes")
def q_tree_nodes(spark, sf):
    """The fitted tree's nodes, read from its saved files."""
    m, _, names = _tree(spark, sf)
    return (tree_table.tree_nodes(spark, m).join(F.broadcast(names_frame(spark, names)), "feature_idx", "left")
            .select("tree", "node", "feature_idx", "feature", F.round("threshold", R).alias("threshold"), "left", "right", F.round("gain", R).alias("gain"),
                    F.round("impurity", R).alias("impurity"), "n", "prediction"))


@query("tree_walk")
def q_tree_walk(spark, sf):
    """The test rows walked down the node table, a join for each level; the model's own predictions."""
    m, test, _ = _tree(spark, sf)
    return tree_table.walk(test, tree_table.tree_nodes(spark, m), m.depth).select("id", "node", "prediction")


@query("tree_split_gains")
def q_tree_split_gains(spark, sf):
    """D19 in SQL: splits and share of the impurity decrease of each feature."""
    m, _, names = _tree(spark, sf)
    return (tree_table.split_gains(tree_table.tree_nodes(spark, m)).join(F.broadcast(names_frame(spark, names)), "feature_idx")
            .select("feature_idx", "feature", "splits", F.round("importance", R).alias("importance")))


# ---------------------------------------------------------------- roster and ensembles

ROSTER = ["knn", "linear_svm", "decision_tree", "random_forest", "boosting", "mlp", "adaboost"]


@query("model_leaderboard")
def q_leaderboard(spark, sf):
    """The seven-model roster fitted on the training rows; accuracy on train and
    test, and the class-1 precision / recall / f1 on test."""
    train, test, names = train_test(spark, sf)
    fitted = roster.fit_roster(train, ROSTER, len(names), n_rows=train.count())
    long = roster.scored_union(fitted, train, "train").unionByName(roster.scored_union(fitted, test, "test"))
    hit = (F.col("label") == F.col("prediction")).cast("double")
    tp = F.sum(((F.col("label") == 1) & (F.col("prediction") == 1)).cast("double"))
    pp = F.sum((F.col("prediction") == 1).cast("double"))
    ap = F.sum((F.col("label") == 1).cast("double"))
    agg = long.groupBy("model", "split").agg(F.avg(hit).alias("acc"), tp.alias("tp"), pp.alias("pp"), ap.alias("ap"))
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(F.lit(0.0))
    rec = F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")).otherwise(F.lit(0.0))
    wide = agg.groupBy("model").pivot("split", ["train", "test"]).agg(
        F.first("acc").alias("acc"), F.first(prec).alias("prec"), F.first(rec).alias("rec"))
    p, r = F.col("test_prec"), F.col("test_rec")
    return wide.select("model", F.round("train_acc", R).alias("train_accuracy"), F.round("test_acc", R).alias("test_accuracy"),
                       F.round(p, R).alias("test_precision"), F.round(r, R).alias("test_recall"),
                       F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), R).alias("test_f1"))


_STACKED: dict[tuple, tuple[str, str]] = {}
#: Models that one task fits for long: they start first.
LONG_FITS = ("boosting", "mlp", "adaboost")


def out_of_fold_scores(train: DataFrame, bases: list[str], n_features: int, k: int = CV_FOLDS, parallelism: int = 8) -> DataFrame:
    """Long (model, id, label, score) of every training row, scored by the base model fitted on the other
    folds (column ``cv_fold``)."""
    b = roster.builders(n_features, train.count(), ensemble=True)

    def fit(job):
        model, fold = job
        fitted = b[model](train.filter(F.col("cv_fold") != fold))
        return fitted.score(train.filter(F.col("cv_fold") == fold)).select(F.lit(model).alias("model"), "id", "label", "score")

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = list(pool.map(fit, [(m, f) for m in sorted(bases, key=lambda m: m not in LONG_FITS) for f in range(k)]))
    return reduce_frames(DataFrame.unionByName, parts)


def stack_head(oof: DataFrame, bases: list[str], head: str = "logistic"):
    """The head fitted on out-of-fold scores: ``logistic``, or ``mlp`` (a network)."""
    x = roster.stack_features(oof, bases)
    if head == "logistic":
        est = LogisticRegression(featuresCol="stack", labelCol="label", regParam=1.0 / max(1, x.count()), standardization=False)
    elif head == "mlp":
        return network.fit_network(x, hidden=(100,), alpha=1.0, max_iter=1000, features_col="stack")
    else:
        raise ValueError(head)
    return est.fit(x)


def stacking(oof: DataFrame, test_scores: DataFrame, bases: list[str], head: str = "logistic") -> DataFrame:
    """The head trained on out-of-fold base scores, applied to the scores that the bases, refitted on all
    training rows, give the test rows."""
    return score_frame(stack_head(oof, bases, head).transform(roster.stack_features(test_scores, bases)))


def stack_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold scores, test predictions) of the seven bases, written to the checkpoint folder once per
    session and scale factor; both heads and both votes read them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STACKED:
        train, test, names = train_test(spark, sf)
        paths = tuple(scratch_path(spark, f"{part}-{uuid.uuid4().hex}") for part in ("oof", "bases"))
        with ThreadPoolExecutor(max_workers=1) as pool:      # the refits on all rows run beside those of the folds
            full = pool.submit(roster.fit_roster, train, ROSTER, len(names), n_rows=train.count(), ensemble=True)
            oof = out_of_fold_scores(train, ROSTER, len(names), parallelism=16)
            roster.scored_union(full.result(), test).select("model", "id", "label", "prediction", "score").write.parquet(paths[1])
            oof.write.parquet(paths[0])
        _STACKED[key] = paths
    return tuple(spark.read.parquet(p) for p in _STACKED[key])


def _stacked(spark, sf, head):
    oof, bases = stack_tables(spark, sf)
    return stacking(oof, bases, ROSTER, head)


@query("stacking_oof")
def q_stacking(spark, sf):
    """D12 with both heads over seven bases."""
    both = [_stacked(spark, sf, head).withColumn("model", F.lit(f"stacking_{head}")) for head in ("logistic", "mlp")]
    return both[0].unionByName(both[1]).select("model", "id", "label", "prediction", F.round("score", R).alias("score"))


@query("stacking_report")
def q_stacking_report(spark, sf):
    """E4 over the stacked model's test predictions."""
    return classification_report(_stacked(spark, sf, "logistic"), classes=[0, 1])


@query("vote_roster")
def q_vote_roster(spark, sf):
    """D13 + D14 over fitted models: hard (majority, tie -> lowest) and soft (mean class-1
    score, margins through the logistic link) votes of all seven models on the test rows."""
    from binlens.operators.ensemble import vote_hard, vote_soft

    long = stack_tables(spark, sf)[1]
    test = train_test(spark, sf)[1]
    hard = vote_hard(long).select("id", F.col("prediction").alias("hard_prediction"))
    soft = vote_soft(long).select("id", F.round("score", R).alias("soft_score"), F.col("prediction").alias("soft_prediction"))
    return test.select("id", "label").join(hard, "id").join(soft, "id")


@query("ensembles_reloaded")
def q_ensembles_reloaded(spark, sf):
    """A9 with D12 and D14: a soft vote and a stack of three fitted models, saved, loaded again and applied to the test rows."""
    train, test, names = train_test(spark, sf)
    bases = ["decision_tree", "logistic", "linear_svm"]
    members = roster.fit_roster(train, bases, len(names), n_rows=train.count())
    head = stack_head(cut_lineage(roster.scored_union(members, train)), bases)
    out = None
    for name, model in (("vote", roster.VoteModel(members, soft=True)), ("stack", roster.StackModel(members, head))):
        path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
        save_model(spark, model, path)
        part = _model_rows(name, roster.fitted(name, load_model(spark, path)), test)
        out = part if out is None else out.unionByName(part)
    return out
