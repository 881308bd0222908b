"""Model-selection queries (F2, F3, F5, F6, F9-F12) on stratified folds of the training rows.

Searches are fit loops, so these queries carry no oracle (rows-only in the driver check); the engines behind them are checked in
``tests/test_trees.py`` and ``tests/test_ensemble_selection.py``. Spaces, budgets and numbers of folds are the reference's, except where a query's
doc string says otherwise.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binlens.functions.ranking import group_position, md5_key, stratified_folds
from binlens.operators import knn, models, newton, reduce, roster, sgd, trees
from binlens.operators import selection as S
from binlens.operators.features import TopKSelector
from binlens.plans.prepared import CV_FOLDS, train_test
from binlens.plans.registry import query
from binlens.session import cut_lineage

R = 6
FOLDS = list(range(CV_FOLDS))


def _dt(max_depth=5, min_leaf=1, features="features"):
    return roster._spark_ml("decision_tree", models.decision_tree(max_depth=max_depth, min_leaf=min_leaf, seed=0,
                                                                   features=features))


def folded(train: DataFrame, k: int) -> DataFrame:
    """The training rows with ``search_fold``: k stratified folds."""
    return stratified_folds(train, "id", "label", k, "search_fold")


def _round_all(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(c, R).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- F2 cross-validated score

@query("cv_scores")
def q_cv_scores(spark, sf):
    """5-fold accuracy of the depth-5 tree; mean and population std over folds."""
    train, _, _ = train_test(spark, sf)
    scored = S.run_folds(train, [(0, {}, _dt())], FOLDS)
    per = S.fold_metrics(scored, ["accuracy"]).select("fold", "accuracy")
    w = Window.partitionBy()
    return _round_all(per.withColumn("mean_accuracy", F.avg("accuracy").over(w))
                      .withColumn("std_accuracy", F.stddev_pop("accuracy").over(w)),
                      {"accuracy", "mean_accuracy", "std_accuracy"})


# ---------------------------------------------------------------- F3 grid search, several metrics

# Fixed values of the forest grid: 1,680 points.
FOREST_GRID = {"min_samples_split": [0.1, 0.2, 0.3, 4, 5, 10, 15], "n_estimators": [3, 5, 10, 20, 40], "max_depth": [2, 5, 10, 20],
               "max_features": [3, 5, 10, 20], "min_samples_leaf": [0.2, 2, 10]}


def grid_search(train: DataFrame, space: dict, metrics: list[str], refit: str, k: int = 10, score_train: bool = True) -> DataFrame:
    """Every point of a forest grid x every fold; (candidate, params, split, metric, mean, std, rank) with
    rank 1 = best mean ``refit`` metric on the validation folds (ties -> lower candidate)."""
    cands = [(i, p, None) for i, p in enumerate(S.grid(space))]
    per = trees.search_forests(folded(train, k), [p for _, p, _ in cands], list(range(k)), metrics, "search_fold", score_train=score_train)
    summary = S.summarise(per, metrics, S.params_frame(train.sparkSession, cands))
    best = (summary.filter((F.col("split") == "test") & (F.col("metric") == refit))
            .select("candidate", F.row_number().over(Window.orderBy(F.col("mean").desc(), "candidate")).alias("rank")))
    return summary.join(best, "candidate")


@query("grid_search")
def q_grid_search(spark, sf):
    """the whole forest grid (1,680 points) x 10 folds, precision / recall / accuracy on training and validation rows, refit
    metric = accuracy. Points that differ in size, depth or smallest split share their trees."""
    train, _, _ = train_test(spark, sf)
    return _round_all(grid_search(train, FOREST_GRID, ["precision", "recall", "accuracy"], refit="accuracy"), {"mean", "std"})


# ---------------------------------------------------------------- F5 randomised search

# Fixed values of the three spaces: 80, 20 and 6 points.
TREE_SPACE = {"max_depth": [5], "min_samples_split": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 1.0, 2],
              "min_samples_leaf": [0.1, 0.2, 0.3, 0.4, 0.5, 1, 2, 5, 10, 20]}
SGD_SPACE = {"loss": ["hinge", "log", "modified_huber", "perceptron"], "alpha": [0.1, 1, 10, 100, 1000]}
KNN_SPACE = {"n_neighbors": [3, 4, 5], "p": [1, 2]}


def knn_counts(train: DataFrame, candidates: list[dict], folds: list[int], fold_col: str) -> DataFrame:
    """(candidate, fold, split, counts) of nearest-neighbour candidates {n_neighbors[, p]}: one neighbour join for each fold and metric,
    with the largest k, serves every candidate."""
    vec = vector_to_array(F.col("features"))
    rows = train.select("id", vec.alias("vec"), "label", fold_col)
    spark = train.sparkSession

    def one(job):
        fold, p = job
        held = rows.filter(F.col(fold_col) == fold)
        mine = [(i, int(c["n_neighbors"])) for i, c in enumerate(candidates) if c.get("p", 2) == p]
        nb = knn.nearest_neighbours(rows.filter(F.col(fold_col) != fold), held.select("id", "vec"), max(k for _, k in mine), p=p)
        ks = spark.createDataFrame(mine, "candidate int, k int")
        votes = (nb.join(F.broadcast(ks), F.col("rank") <= F.col("k")).groupBy("candidate", "qid", "label").agg(F.count(F.lit(1)).alias("votes"))
                 .groupBy("candidate", "qid").agg(F.max_by("label", F.struct(F.col("votes"), -F.col("label"))).alias("prediction")))
        one_, pred = (F.col("label") == 1).cast("long"), (F.col("prediction") == 1).cast("long")
        got = (votes.join(held.select(F.col("id").alias("qid"), F.col("label").cast("int").alias("label")), "qid").groupBy("candidate")
               .agg(F.count(F.lit(1)), F.sum(one_), F.sum(pred), F.sum(one_ * pred), F.sum((F.col("label") == F.col("prediction")).cast("long"))).collect())
        return [(r[0], fold, "test", *r[1:]) for r in got]

    jobs = [(f, p) for f in folds for p in sorted({c.get("p", 2) for c in candidates})]
    with ThreadPoolExecutor(max_workers=8) as pool:
        return spark.createDataFrame([r for rs in pool.map(one, jobs) for r in rs], S.COUNTED)


def random_search(train: DataFrame, draws: int = 50, k: int = 7, seed: int = 0) -> DataFrame:
    """(model, candidate, params, metric, mean, two_std) for ``draws`` points of each space, or the whole space where it is smaller."""
    spark, folds = train.sparkSession, list(range(k))
    rows = cut_lineage(folded(train, k))
    out = None
    for model, space, metrics in (("decision_tree", TREE_SPACE, ["recall_macro", "f1_macro"]), ("sgd", SGD_SPACE, ["recall_macro"]), ("knn", KNN_SPACE, ["recall_macro"])):
        points = S.sample_grid(space, draws, seed)
        if model == "decision_tree":
            per = trees.search_forests(rows, points, folds, metrics, "search_fold", bootstrap_rows=False, score_train=False)
        else:
            counts = sgd.search_sgd(rows, points, folds, "search_fold") if model == "sgd" else knn_counts(rows, points, folds, "search_fold")
            per = S.fold_metrics(counts, metrics)
        s = S.summarise(per, metrics, S.params_frame(spark, [(i, p, None) for i, p in enumerate(points)]))
        s = s.select(F.lit(model).alias("model"), "candidate", "params", "metric", "mean", (F.col("std") * 2).alias("two_std"))
        out = s if out is None else out.unionByName(s)
    return out


@query("random_search")
def q_random_search(spark, sf):
    """50 draws (seed 0) without replacement from the 80-point tree space, all 20 linear and all 6 neighbour candidates, 7 folds,
    macro recall (and macro f1 for the trees); the line reported per candidate is mean +/- 2 std."""
    return _round_all(random_search(train_test(spark, sf)[0]), {"mean", "two_std"})


# ---------------------------------------------------------------- F6 / F7 / F8 search over spaces

# Fixed values of the spaces and of their numbers of trials.
FOREST_TRIALS = 300, {"max_depth": ("choice", list(range(1, 20))), "max_features": ("choice", list(range(1, 5))), "n_estimators": ("choice", list(range(1, 20))),
                      "criterion": ("choice", ["gini", "entropy"])}
KNN_TRIALS = 5, {"n_neighbors": ("quniform", 2, 10, 1)}
BOOST_TRIALS = 20, {"max_depth": ("quniform", 4, 16, 1), "min_child_weight": ("quniform", 1, 10, 1), "subsample": ("uniform", 0.7, 1), "gamma": ("uniform", 0.1, 0.5),
                    "colsample": ("uniform", 0.7, 1), "reg_lambda": ("uniform", 0, 1)}


def _means(counts: DataFrame, size: int) -> list[float]:
    got = {r["candidate"]: r["m"] for r in S.fold_metrics(counts, ["accuracy"]).groupBy("candidate").agg(F.avg("accuracy").alias("m")).collect()}
    return [got[i] for i in range(size)]


def search_spaces(train: DataFrame, models: tuple[str, ...] = ("forest", "knn", "boosting"), fold_col: str = "cv_fold", folds=FOLDS, seed: int = 0) -> list[tuple]:
    """(model, trial, params, accuracy): adaptive trials of each model's space.

    Forests and neighbours are scored by cross-validation. Every point of the forest space is cut from the trees of its (criterion, features)
    family, which are grown once for all trials. Boosted candidates run up to 1,000 rounds with 10 rounds' patience on fold 0 of the training rows, a batch side by side, and are scored there.
    """
    out = []
    if "forest" in models:
        trials, space = FOREST_TRIALS
        names = sorted(space)
        points = S.grid({n: space[n][1] for n in names})
        per = trees.search_forests(train, points, list(folds), ["accuracy"], fold_col, score_train=False)
        table = {r["candidate"]: r["m"] for r in per.groupBy("candidate").agg(F.avg("accuracy").alias("m")).collect()}      # one number a point of the space
        where = {tuple(p[n] for n in names): i for i, p in enumerate(points)}
        got = S.adaptive_rounds(space, lambda ps: [table[where[tuple(p[n] for n in names)]] for p in ps], trials, batch=10, seed=seed)
        out += [("forest", i, *t) for i, t in enumerate(got, 1)]
    if "knn" in models:
        trials, space = KNN_TRIALS
        ks = [{"n_neighbors": k} for k in range(2, 11)]
        at = dict(zip(range(2, 11), _means(knn_counts(train, ks, list(folds), fold_col), len(ks))))
        out += [("knn", i, *t) for i, t in enumerate(S.adaptive_rounds(space, lambda ps: [at[int(p["n_neighbors"])] for p in ps], trials, batch=2, seed=seed), 1)]
    if "boosting" in models:
        trials, space = BOOST_TRIALS
        held = train.filter(F.col(fold_col) == 0)

        def score(points):
            fits = newton.fit_many(train, [p | {"max_depth": int(p["max_depth"])} for p in points], 1000, [0] * len(points), fold_col, patience=10)
            hits = [F.avg((F.col(f"p{i}") == F.col("label")).cast("double")) for i in range(len(fits))]
            scored = held.select("label", *[(m.score() > 0.5).cast("int").alias(f"p{i}") for i, m in enumerate(fits)])
            return [float(v) for v in scored.agg(*hits).first()]

        out += [("boosting", i, *t) for i, t in enumerate(S.adaptive_rounds(space, score, trials, batch=5, seed=seed), 1)]
    return out


@query("space_search")
def q_space_search(spark, sf):
    """F6 with F8 and F7: 300 forest, 5 nearest-neighbour and 20 boosting trials, each batch proposed from the densities of the good
    and the other trials so far; loss = -accuracy, and the best so far per trial."""
    rows = [(m, i, json.dumps(p, sort_keys=True), a) for m, i, p, a in search_spaces(train_test(spark, sf)[0])]
    out = spark.createDataFrame(rows, "model string, trial int, params string, accuracy double")
    w = Window.partitionBy("model").orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return _round_all(out.withColumn("loss", -F.col("accuracy")).withColumn("best_so_far", F.max("accuracy").over(w)), {"accuracy", "loss", "best_so_far"})


# ---------------------------------------------------------------- F9 validation curves

_SPLITS = [*range(2, 20), *[round(0.1 * i, 1) for i in range(1, 10)]]
_LEAVES = [*range(2, 20), *[round(0.1 * i, 1) for i in range(1, 5)]]
# The parameter's range and the other settings of each curve.
TREE_CURVES = {"max_depth": (list(range(1, 40)), {"min_samples_split": 4, "min_samples_leaf": 2}),
               "min_samples_split": (_SPLITS, {"min_samples_leaf": 2, "max_depth": 10}), "min_samples_leaf": (_LEAVES, {"min_samples_split": 4, "max_depth": 10})}
FOREST_CURVES = {"max_depth": (list(range(1, 40)), {"max_features": 10, "min_samples_split": 5, "n_estimators": 5}),
                 "min_samples_split": (_SPLITS, {"max_depth": 5, "max_features": 10, "n_estimators": 5}),
                 "max_features": (list(range(2, 20)), {"max_depth": 5, "min_samples_split": 5, "n_estimators": 5}),
                 "min_samples_leaf": (_LEAVES, {"max_depth": 5, "min_samples_split": 5, "n_estimators": 5}),
                 "n_estimators": (list(range(3, 300)), {"max_depth": 5, "min_samples_split": 5, "max_features": 10})}


def validation_curves(train: DataFrame, curves: dict, forest: bool, k: int = 10) -> DataFrame:
    """(parameter, value, train_mean, train_std, test_mean, test_std) of accuracy over k folds; trees look at all features, forests at the root of their number unless
    a curve says otherwise."""
    spark, rows, out = train.sparkSession, cut_lineage(folded(train, k)), None
    for name, (values, rest) in curves.items():
        points = [({"max_features": "auto"} if forest else {}) | rest | {name: v} for v in values]
        per = trees.search_forests(rows, points, list(range(k)), ["accuracy"], "search_fold", bootstrap_rows=forest)
        s = S.summarise(per, ["accuracy"]).join(F.broadcast(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "candidate int, value double")), "candidate")
        wide = s.groupBy(F.lit(name).alias("parameter"), "value").pivot("split", ["train", "test"]).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
        out = wide if out is None else out.unionByName(wide)
    return _round_all(out, {"train_mean", "train_std", "test_mean", "test_std"})


@query("validation_curve")
def q_validation_curve(spark, sf):
    """tree depths 1 to 39 x 10 folds; train and validation accuracy mean and std per value."""
    out = validation_curves(train_test(spark, sf)[0], {"max_depth": TREE_CURVES["max_depth"]}, forest=False)
    return out.select(F.col("value").cast("int").alias("max_depth"), "train_mean", "train_std", "test_mean", "test_std")


@query("validation_curves_tree")
def q_validation_curves_tree(spark, sf):
    """the tree's smallest split and leaf, as rows and as shares, x 10 folds."""
    return validation_curves(train_test(spark, sf)[0], {k: v for k, v in TREE_CURVES.items() if k != "max_depth"}, forest=False)


@query("validation_curves_forest")
def q_validation_curves_forest(spark, sf):
    """all five curves of the forest (39, 27, 18, 22 and 297 values) x 10 folds."""
    return validation_curves(train_test(spark, sf)[0], FOREST_CURVES, forest=True)


# ---------------------------------------------------------------- F10 learning curve

FRACS = [round(0.1 * i, 1) for i in range(1, 11)]


def fold_prefixes(train: DataFrame, folds=FOLDS) -> DataFrame:
    """(fold, id, pos, n_train): position of each row in md5 order within the training set of
    every fold (each row appears once per fold it trains)."""
    slim = train.select("id", "cv_fold", F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold")) \
                .filter(F.col("fold") != F.col("cv_fold")).withColumn("_h", md5_key("id"))
    pos = group_position(slim, ["fold"], ["_h", "id"], name="pos")
    n = pos.groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"))
    return pos.join(F.broadcast(n), "fold").select("fold", "id", "pos", "n_train")


@query("learning_curve")
def q_learning_curve(spark, sf):
    """training sizes 10 %..100 % of each fold's training rows (md5 prefix), 5 folds, tree
    depth 5; train and validation accuracy mean / std per size."""
    train, _, _ = train_test(spark, sf)
    pre = cut_lineage(fold_prefixes(train))     # one numbering pass, read by all 50 fits

    def subset(tr, f, params):
        keep = pre.filter((F.col("fold") == f) & (F.col("pos") <= F.floor(F.col("n_train") * F.lit(params["frac"]))))
        return tr.join(keep.select("id"), "id", "left_semi")

    cands = [(i, {"frac": fr}, _dt()) for i, fr in enumerate(FRACS)]
    scored = S.run_folds(train, cands, FOLDS, score_train=True, subset=subset)
    s = S.summarise(S.fold_metrics(scored, ["accuracy"]), ["accuracy"])
    fr = spark.createDataFrame([(i, fr) for i, fr in enumerate(FRACS)], "candidate int, frac double")
    wide = s.join(F.broadcast(fr), "candidate").groupBy("frac").pivot("split", ["train", "test"]).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"))
    return _round_all(wide, {"train_mean", "train_std", "test_mean", "test_std"})


# ---------------------------------------------------------------- F11 feature-count curve

KS = [5, 10, 15, 20, 25]


@query("feature_count_curve")
def q_feature_count_curve(spark, sf):
    """mutual-information selection refitted inside each fold, k in 5..25, tree depth 5,
    min leaf 2. The MI ranking of a fold does not depend on k, so it is computed once per fold
    and sliced for every k."""
    train, _, _ = train_test(spark, sf)
    ranks = {}
    for f in FOLDS:
        m = TopKSelector(k=max(KS), scoreFunc="mi").fit(train.filter(F.col("cv_fold") != f))
        ranks[f] = m.getOrDefault("indices")

    def sliced(k):
        def build(tr, f):
            slicer = VectorSlicer(inputCol="features", outputCol="sel", indices=sorted(ranks[f][:k]))
            fitted = _dt(max_depth=5, min_leaf=2, features="sel")(slicer.transform(tr))
            return roster.Fitted(fitted.name, lambda df: fitted.score(slicer.transform(df)), fitted.model)
        return build

    cands = [(k, {"k": k}, sliced(k)) for k in KS]
    scored = S.run_folds(train, cands, FOLDS, fold_aware=True)
    s = S.summarise(S.fold_metrics(scored, ["accuracy"]), ["accuracy"]).filter(F.col("split") == "test")
    return _round_all(s.select(F.col("candidate").alias("k"), "mean", "std"), {"mean", "std"})


# ---------------------------------------------------------------- F12 reducer comparison

REDUCERS = ("svd", "nmf", "gini", "chi2", "mi")


def reducer_fits(fit: DataFrame, reducer: str, sizes: list[int], nmf_steps: int = 500, keep: tuple[str, ...] = ("label",)):
    """[(size, function)]: each function gives a frame the vector column ``reduced`` of that many slots, fitted on ``fit``.

    Only the non-negative factors depend on the size; the other reducers are fitted once, with the largest, and sliced.
    """
    most = max(sizes)

    def vectors(project):
        return lambda df: project(df).withColumn("reduced", array_to_vector("r")).drop("r")

    if reducer == "svd":
        _, _, V = reduce.svd(fit, most, "id", "features")
        return [(n, vectors(lambda df, n=n: reduce.svd_project(df, V[:, :n], keep=keep, output_col="r"))) for n in sizes]
    if reducer == "nmf":
        def parts(n):
            _, H, _ = reduce.nmf(fit, n, "id", "features", max_iter=nmf_steps, tol=1e-4)
            return n, vectors(lambda df: reduce.nmf_transform(df, H, keep=keep, output_col="r"))
        return [parts(n) for n in sizes]
    if reducer == "gini":
        importances = models.decision_tree(max_depth=5, seed=0).fit(fit).featureImportances.toArray()
        ranked = sorted(range(len(importances)), key=lambda i: (-importances[i], i))
    else:
        ranked = TopKSelector(k=most, scoreFunc=reducer).fit(fit).getOrDefault("indices")
    return [(n, VectorSlicer(inputCol="features", outputCol="reduced", indices=sorted(ranked[:n])).transform) for n in sizes]


def reducer_scores(train: DataFrame, sizes: list[int], depths: list[int], reducers: tuple[str, ...] = REDUCERS, folds=FOLDS, fold_col: str = "cv_fold",
                   nmf_steps: int = 500) -> DataFrame:
    """(reducer, n_components, max_depth, fold, accuracy): every reducer is fitted on the rows outside a fold, and trees of all depths
    grown on those rows in one pass are scored on the fold. A size beyond the number of features is an error."""
    width = len(train.select("features").first()[0])
    if max(sizes) > width:
        raise ValueError(f"{max(sizes)} components, but there are {width} features")

    def one(job):
        reducer, f = job
        out = []
        for n, transform in reducer_fits(train.filter(F.col(fold_col) != f), reducer, sizes, nmf_steps, ("label", fold_col)):
            rows = cut_lineage(transform(train).select("id", "label", fold_col, "reduced"))
            per = trees.search_forests(rows, [{"max_depth": d} for d in depths], [f], ["accuracy"], fold_col, bootstrap_rows=False, score_train=False,
                                       features_col="reduced")
            out += [(reducer, n, depths[r["candidate"]], f, float(r["accuracy"])) for r in per.collect()]      # one row a depth
        return out

    jobs = [(r, f) for r in sorted(reducers, key=lambda r: r != "nmf") for f in folds]      # the longest first
    with ThreadPoolExecutor(max_workers=8) as pool:
        got = [r for rs in pool.map(one, jobs) for r in rs]
    return train.sparkSession.createDataFrame(got, "reducer string, n_components int, max_depth int, fold int, accuracy double")


@query("reducer_comparison")
def q_reducer_comparison(spark, sf):
    """{SVD, NMF (500 steps at most), tree importance, chi2, MI} x {5, 10} components x tree depth {3, 5} x 5 folds, the reducer
    refitted on the rows outside each fold; the mean accuracy over folds of the better depth."""
    scores = reducer_scores(train_test(spark, sf)[0], [5, 10], [3, 5])
    acc = scores.groupBy("reducer", "n_components", "max_depth").agg(F.avg("accuracy").alias("accuracy"))
    best = acc.groupBy("reducer", "n_components").agg(
        F.max("accuracy").alias("accuracy"), F.max_by("max_depth", F.struct("accuracy", -F.col("max_depth"))).alias("best_depth"))
    return _round_all(best, {"accuracy"})
