"""Preparation, statistics, selection and neighbour/vote queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binlens.functions.ranking import stratified_folds
from binlens.functions.sizing import maybe_broadcast
from binlens.operators import ensemble as EN
from binlens.operators import features as FE
from binlens.operators import graph as G
from binlens.operators import prepare as PR
from binlens.operators.continuous_mi import mutual_information_knn
from binlens.operators.knn import approx_neighbours, knn_predict, nearest_neighbours
from binlens.operators.pivot_knn import pivot_neighbours
from binlens.plans import standins as si
from binlens.plans.q_evaluate import SCORED
from binlens.plans.q_extract import DICT_VALUES
from binlens.plans.registry import query
from binlens.sources.lookups import WORD_CATEGORIES, dictionary_frame
from binlens.sources.tables import table

R = 6


def _r(c, digits=R):
    return F.round(F.col(c), digits).alias(c)


# ---------------------------------------------------------------- ragged sources

def _customers(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return c.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                    F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
                    F.col("c_mktsegment").alias("mktsegment"))


def _suppliers(spark, sf):
    s = table(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return s.select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                    F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))


CONCAT = """
WITH cc AS (
  SELECT 'customer' AS source, c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal,
         c_mktsegment AS mktsegment FROM customer
  UNION ALL BY NAME
  SELECT 'supplier' AS source, s_suppkey AS key, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier)
"""


@query("concat_by_name", CONCAT + "SELECT * FROM cc")
def q_concat(spark, sf):
    return PR.concat_by_name([_customers(spark, sf), _suppliers(spark, sf)])


@query("drop_null_columns", CONCAT + "SELECT source, key, name, nationkey, acctbal FROM cc")
def q_drop_null(spark, sf):
    return PR.drop_null_columns(q_concat(spark, sf), also_drop=["e_res", "e_res2"])


# the test side decides the columns: suppliers with their region, nation key widened to bigint
TEST_SCHEMA = T.StructType([T.StructField("source", T.StringType()), T.StructField("key", T.LongType()),
                            T.StructField("name", T.StringType()), T.StructField("nationkey", T.LongType()),
                            T.StructField("acctbal", T.DoubleType()), T.StructField("regionkey", T.IntegerType())])


@query("align_columns", """
SELECT 'customer' AS source, c_custkey AS key, c_name AS name, cast(c_nationkey AS BIGINT) AS nationkey,
       c_acctbal AS acctbal, cast(NULL AS INTEGER) AS regionkey FROM customer""")
def q_align(spark, sf):
    return PR.align_columns(_customers(spark, sf), TEST_SCHEMA)


@query("typed_fill", CONCAT + "SELECT source, key, name, nationkey, acctbal, coalesce(mktsegment, 'null') AS mktsegment FROM cc")
def q_typed_fill(spark, sf):
    return PR.typed_fill(q_concat(spark, sf))


@query("shape_report", CONCAT + """
SELECT 'concat' AS step, count(*) AS n_rows, cast(6 AS BIGINT) AS n_cols FROM cc
UNION ALL SELECT 'drop_null_columns', count(*), 5 FROM cc
UNION ALL SELECT 'align_columns', count(*), 6 FROM customer""")
def q_shape(spark, sf):
    c = q_concat(spark, sf)
    d = PR.drop_null_columns(c)
    a = PR.align_columns(_customers(spark, sf), TEST_SCHEMA)
    return PR.shape(c, "concat").unionByName(PR.shape(d, "drop_null_columns")).unionByName(PR.shape(a, "align_columns"))


# ---------------------------------------------------------------- one-hot

def encoded_names(model, categorical, numeric) -> list[str]:
    """Output names of the encoded matrix: ``col=level`` per known level, then numeric names."""
    from pyspark.ml.feature import StringIndexerModel

    names = []
    for st in model.stages:
        if isinstance(st, StringIndexerModel):
            for c, labels in zip(categorical, st.labelsArray):
                names += [f"{c}={lab}" for lab in labels]
    return names + list(numeric)


@query("one_hot", """
WITH b AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS ib, 'p_brand=' || p_brand AS fb,
                  dense_rank() OVER (ORDER BY p_type) - 1 AS it, 'p_type=' || p_type AS ft FROM part),
nb AS (SELECT count(DISTINCT p_brand) AS n FROM part)
SELECT p_partkey, cast(ib AS INTEGER) AS feature_idx, fb AS feature FROM b
UNION ALL SELECT p_partkey, cast(it + nb.n AS INTEGER), ft FROM b, nb""")
def q_one_hot(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_brand", "p_type")
    cat = ["p_brand", "p_type"]
    model = Pipeline(stages=FE.one_hot_stages(cat, [])).fit(part)
    names = encoded_names(model, cat, [])
    lookup = spark.createDataFrame(list(enumerate(names)), "feature_idx int, feature string")
    long_df = FE.to_long(model.transform(part), "p_partkey").withColumn("feature_idx", F.col("feature_idx").cast("int"))
    return long_df.join(maybe_broadcast(lookup, known_rows=len(names)), "feature_idx").select(
        "p_partkey", "feature_idx", "feature")


# ---------------------------------------------------------------- statistics (C14-C17)

FEATS = f"""
WITH lab AS (SELECT d.doc_id AS id, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IN (SELECT id FROM lab)),
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(line), '[a-z]+')) AS opcode FROM lines),
dict AS (SELECT DISTINCT * FROM (VALUES {DICT_VALUES}) t(category, opcode)),
fl AS (
  SELECT d.doc_id AS id, 'lang=' || d.lang AS feature, 1.0e0 AS value FROM documents d JOIN lab ON d.doc_id = lab.id
  UNION ALL SELECT d.doc_id, 'source=' || d.source, 1.0e0 FROM documents d JOIN lab ON d.doc_id = lab.id
  UNION ALL SELECT t.doc_id, 'cat_' || k.category, cast(count(*) AS DOUBLE) FROM toks t JOIN dict k ON t.opcode = k.opcode GROUP BY ALL),
cls AS (SELECT label, count(*) AS n_y FROM lab GROUP BY label),
nall AS (SELECT count(*) AS n FROM lab)
"""


def _features_long(spark, sf):
    """(id, feature, value) for labelled documents: language and source indicators plus the
    per-document count of dictionary words in each category."""
    docs = si.labelled_docs(spark, sf).select(F.col("doc_id").alias("id"), "lang", "source", "label")
    ind = docs.select("id", F.inline(F.array(
        F.struct(F.concat(F.lit("lang="), F.col("lang")).alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.concat(F.lit("source="), F.col("source")).alias("feature"), F.lit(1.0).alias("value")))))
    toks = G.mnemonic_tokens(si.instructions(spark, sf)).join(docs.select(F.col("id").alias("binary_id")), "binary_id", "left_semi")
    cats = (toks.join(F.broadcast(dictionary_frame(spark, WORD_CATEGORIES)), "opcode")
            .groupBy(F.col("binary_id").alias("id"), F.concat(F.lit("cat_"), F.col("category")).alias("feature"))
            .agg(F.count(F.lit(1)).cast("double").alias("value")))
    return ind.unionByName(cats), docs.select("id", "label")


MI_SQL = FEATS + """
, cells AS (SELECT f.feature, f.value, l.label, count(*) AS c FROM fl f JOIN lab l ON f.id = l.id GROUP BY ALL),
nz AS (SELECT feature, label, sum(c) AS c_nz FROM cells GROUP BY ALL),
zeros AS (SELECT fe.feature, 0.0e0 AS value, cls.label, cls.n_y - coalesce(nz.c_nz, 0) AS c
          FROM (SELECT DISTINCT feature FROM cells) fe CROSS JOIN cls
          LEFT JOIN nz ON nz.feature = fe.feature AND nz.label = cls.label),
allc AS (SELECT * FROM cells UNION ALL SELECT * FROM zeros WHERE c > 0),
t AS (SELECT allc.*, sum(c) OVER (PARTITION BY feature, value) AS c_x, cls.n_y FROM allc JOIN cls ON allc.label = cls.label),
mi AS (SELECT feature, sum(c / nall.n * ln(c * nall.n / (c_x * n_y))) AS mi FROM t, nall GROUP BY feature)
"""


@query("mutual_information", MI_SQL + f"SELECT feature, round(mi, {R}) AS mi FROM mi")
def q_mi(spark, sf):
    fl, lab = _features_long(spark, sf)
    return FE.mutual_information(fl, lab).select("feature", _r("mi"))


@query("select_k_best_mi", MI_SQL + f"""
SELECT feature, round(mi, {R}) AS mi, rank FROM (
  SELECT feature, mi, row_number() OVER (ORDER BY round(mi, 12) DESC, feature DESC) AS rank FROM mi) WHERE rank <= 10""")
def q_kbest(spark, sf):
    fl, lab = _features_long(spark, sf)
    mi = FE.mutual_information(fl, lab).withColumn("mi", F.round("mi", 12))
    return FE.top_k(mi, "mi", 10, feature="feature").select("feature", _r("mi"), "rank")


# continuous columns as whole hundredths, so that distances and ties are exact in both engines
CONTINUOUS = {"discount": "l_discount", "extendedprice": "l_extendedprice", "quantity": "l_quantity", "tax": "l_tax"}
KNN_MI_SQL = """
WITH f AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, l_returnflag AS y, cast(round({c} * 100) AS BIGINT) AS v FROM lineitem" for f, c in CONTINUOUS.items()) + """),
s AS (SELECT l_returnflag AS y, count(*) AS ny FROM lineitem GROUP BY l_returnflag HAVING count(*) > 1),
d AS (SELECT feature, y, v, [v - lag(v, 1) OVER w, v - lag(v, 2) OVER w, v - lag(v, 3) OVER w,
                             lead(v, 1) OVER w - v, lead(v, 2) OVER w - v, lead(v, 3) OVER w - v] AS gaps
      FROM f JOIN s USING (y) WINDOW w AS (PARTITION BY feature, y ORDER BY v)),
r AS (SELECT feature, v, ny, least(3, ny - 1) AS k,
             greatest(list_sort(list_filter(gaps, lambda g: g IS NOT NULL))[least(3, ny - 1)] - 1, 0) AS reach FROM d JOIN s USING (y)),
m AS (SELECT feature, k, ny, count(*) OVER (PARTITION BY feature ORDER BY v RANGE BETWEEN reach PRECEDING AND reach FOLLOWING) AS m FROM r),
h AS (SELECT i, sum(1e0 / i) OVER (ORDER BY i) - 1e0 / i AS psi FROM generate_series(1, (SELECT count(*) FROM lineitem)) t(i)),
mi AS (SELECT feature, greatest(0e0, (SELECT psi FROM h WHERE i = (SELECT sum(ny) FROM s)) + avg(hk.psi - hn.psi - hm.psi)) AS mi
       FROM m JOIN h hk ON hk.i = k JOIN h hn ON hn.i = ny JOIN h hm ON hm.i = m GROUP BY feature)
"""


@query("mutual_information_knn", KNN_MI_SQL + f"SELECT feature, round(mi, {R}) AS mi, row_number() OVER (ORDER BY round(mi, {R}) DESC, feature DESC) AS rank FROM mi")
def q_mi_knn(spark, sf):
    items = table(spark, sf, "lineitem", "l_returnflag", *CONTINUOUS.values()).withColumn("id", F.lit(0)).withColumnRenamed("l_returnflag", "label")
    cells = items.select("id", "label", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.round(F.col(c) * 100).cast("double").alias("value")) for f, c in CONTINUOUS.items()])))
    mi = mutual_information_knn(cells, items.select("id", "label")).withColumn("mi", F.round("mi", R))
    return FE.top_k(mi, "mi", len(CONTINUOUS), feature="feature")


@query("chi2_scores", FEATS + f"""
, obs AS (SELECT f.feature, l.label, sum(f.value) AS o FROM fl f JOIN lab l ON f.id = l.id GROUP BY ALL),
tot AS (SELECT feature, sum(o) AS t FROM obs GROUP BY feature),
g AS (SELECT tot.feature, tot.t, cls.label, cls.n_y FROM tot CROSS JOIN cls),
full_ AS (SELECT g.*, coalesce(obs.o, 0.0e0) AS o, g.t * g.n_y / nall.n AS e FROM g
          LEFT JOIN obs ON obs.feature = g.feature AND obs.label = g.label, nall)
SELECT feature, round(sum((o - e) * (o - e) / e), {R}) AS chi2 FROM full_ GROUP BY feature""")
def q_chi2(spark, sf):
    fl, lab = _features_long(spark, sf)
    return FE.chi2_scores(fl, lab).select("feature", _r("chi2"))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SCALE_SQL = """
WITH s AS (SELECT """ + ", ".join(f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0e0 ELSE stddev_pop({c}) END AS s_{c}" for c in NUM) + """ FROM lineitem)
"""


@query("scale_no_center", SCALE_SQL + "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({c} / s_{c}, {R}) AS {c}" for c in NUM) + " FROM lineitem, s")
def q_scale(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", *NUM)
    return FE.scale_columns(li, NUM).select("l_orderkey", "l_linenumber", *[_r(c) for c in NUM])


@query("truncate_features", SCALE_SQL + "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"cast(trunc({c} / s_{c}) AS BIGINT) AS {c}" for c in NUM) + " FROM lineitem, s")
def q_truncate(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", *NUM)
    return PR.truncate(FE.scale_columns(li, NUM), NUM)


# ---------------------------------------------------------------- splits and folds

LAB = """
WITH lab AS (SELECT d.doc_id AS id, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT id, label, cast((row_number() OVER (PARTITION BY label ORDER BY md5(cast(id AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM lab)
"""


def _lab(spark, sf):
    return si.labelled_docs(spark, sf).select(F.col("doc_id").alias("id"), "label")


@query("stratified_split", LAB + "SELECT id, label, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split FROM f")
def q_split(spark, sf):
    return PR.stratified_holdout(_lab(spark, sf), "id", "label", 5)


@query("stratified_folds", LAB + "SELECT id, label, fold FROM f")
def q_folds(spark, sf):
    return stratified_folds(_lab(spark, sf), "id", "label", 5)


FRACS = [round(0.1 * i, 1) for i in range(1, 11)]


@query("learning_curve_sizes", LAB + """
, nt AS (SELECT g.fold, count(*) AS n_train FROM (SELECT DISTINCT fold FROM f) g JOIN f ON f.fold <> g.fold GROUP BY g.fold)
SELECT nt.fold, fr.frac, cast(floor(fr.frac * nt.n_train) AS BIGINT) AS n_rows
FROM nt, (VALUES """ + ", ".join(f"({x}e0)" for x in FRACS) + """) fr(frac)""")
def q_lc_sizes(spark, sf):
    f = stratified_folds(_lab(spark, sf), "id", "label", 5)
    per = f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_fold"))
    total = f.agg(F.count(F.lit(1)).alias("n_all"))
    nt = per.join(F.broadcast(total), how="inner", on=F.lit(True)).select("fold", (F.col("n_all") - F.col("n_fold")).alias("n_train"))
    fr = F.explode(F.array(*[F.lit(x) for x in FRACS])).alias("frac")
    return nt.select("fold", fr, "n_train").select(
        "fold", "frac", F.floor(F.col("frac") * F.col("n_train")).cast("bigint").alias("n_rows"))


# ---------------------------------------------------------------- threshold CV table

THRESHOLDS = [round(0.1 * i, 1) for i in range(1, 10)]

CV_SQL = SCORED + """
, f AS (SELECT id, label, score, cast((row_number() OVER (PARTITION BY label ORDER BY md5(cast(id AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM sc),
cv AS (SELECT t.threshold, f.fold, avg(CASE WHEN (CASE WHEN f.score >= t.threshold THEN 1 ELSE 0 END) = f.label THEN 1.0e0 ELSE 0.0e0 END) AS acc
       FROM f, (VALUES """ + ", ".join(f"({x}e0)" for x in THRESHOLDS) + """) t(threshold) GROUP BY ALL),
res AS (SELECT threshold, avg(acc) AS mean_accuracy, stddev_pop(acc) AS std_accuracy FROM cv GROUP BY threshold)
"""


def _cv_table(spark, sf):
    s = stratified_folds(si.scored(spark, sf), "id", "label", 5)
    t = F.explode(F.array(*[F.lit(x) for x in THRESHOLDS])).alias("threshold")
    per = (s.select("fold", "label", "score", t)
           .withColumn("hit", ((F.col("score") >= F.col("threshold")).cast("int") == F.col("label")).cast("double"))
           .groupBy("threshold", "fold").agg(F.avg("hit").alias("acc")))
    return per.groupBy("threshold").agg(F.avg("acc").alias("mean_accuracy"), F.stddev_pop("acc").alias("std_accuracy"))


@query("cv_results_topk", CV_SQL + """
SELECT threshold, round(mean_accuracy, 3) AS mean_accuracy, round(std_accuracy, 3) AS std_accuracy, rank FROM (
  SELECT *, row_number() OVER (ORDER BY round(mean_accuracy, 9) DESC, threshold) AS rank FROM res) WHERE rank <= 5""")
def q_cv_topk(spark, sf):
    res = _cv_table(spark, sf)
    w = Window.orderBy(F.round("mean_accuracy", 9).desc(), F.col("threshold"))
    return (res.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)
            .select("threshold", _r("mean_accuracy", 3), _r("std_accuracy", 3), "rank"))


@query("running_best", CV_SQL + f"""
SELECT cast(round(threshold * 10) AS INTEGER) AS trial, threshold, round(mean_accuracy, {R}) AS mean_accuracy,
       round(max(mean_accuracy) OVER (ORDER BY threshold ROWS UNBOUNDED PRECEDING), {R}) AS best_so_far FROM res""")
def q_running_best(spark, sf):
    res = _cv_table(spark, sf)
    w = Window.orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    return res.select(F.round(F.col("threshold") * 10).cast("int").alias("trial"), "threshold", _r("mean_accuracy"),
                      F.round(F.max("mean_accuracy").over(w), R).alias("best_so_far"))


# ---------------------------------------------------------------- neighbours and votes

KNN_SQL = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v,
                  (row_number() OVER (PARTITION BY label ORDER BY md5(cast(vec_id AS VARCHAR))) - 1) % 5 AS fold FROM embeddings),
q AS (SELECT * FROM e WHERE fold = 0), t AS (SELECT * FROM e WHERE fold <> 0),
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, round(list_distance(q.v, t.v) * list_distance(q.v, t.v), 9) AS d2 FROM q, t),
nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS r FROM d),
v AS (SELECT qid, label, count(*) AS votes FROM nn WHERE r <= 3 GROUP BY ALL)
SELECT qid AS vec_id, label AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS rr FROM v) WHERE rr = 1"""


@query("knn_exact", KNN_SQL)
def q_knn_exact(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    f = stratified_folds(e, "vec_id", "label", 5)
    q, t = f.filter(F.col("fold") == 0), f.filter(F.col("fold") != 0)
    nb = nearest_neighbours(t, q, 3, id_col="vec_id", vec_col="embedding", label_col="label")
    return knn_predict(nb).select(F.col("qid").alias("vec_id"), "prediction")


@query("knn_pivot", KNN_SQL)
def q_knn_pivot(spark, sf):
    """D8 by pivots: ``knn_exact``'s answers from the cells that can hold them."""
    f = stratified_folds(table(spark, sf, "embeddings", "vec_id", "embedding", "label"), "vec_id", "label", 5)
    nb = pivot_neighbours(f.filter(F.col("fold") != 0), f.filter(F.col("fold") == 0), 3, id_col="vec_id", vec_col="embedding", label_col="label")
    return knn_predict(nb).select(F.col("qid").alias("vec_id"), "prediction")


@query("knn_lsh")
def q_knn_lsh(spark, sf):
    """D8, approximate: same queries and k as ``knn_exact``, candidates from 4 random-projection
    hash tables (bucket length 0.25 on the unit-norm embeddings)."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    f = stratified_folds(e, "vec_id", "label", 5)
    q, t = f.filter(F.col("fold") == 0), f.filter(F.col("fold") != 0)
    nb = approx_neighbours(t, q, 3, id_col="vec_id", vec_col="embedding", label_col="label", bucket_length=0.25,
                           num_tables=4)
    return knn_predict(nb).select(F.col("qid").alias("vec_id"), "prediction")


@query("vote_hard", SCORED + """
, v AS (SELECT id, prediction, count(*) AS votes FROM sms GROUP BY ALL)
SELECT id, prediction, cast(n_models AS BIGINT) AS n_models FROM (
  SELECT id, prediction, sum(votes) OVER (PARTITION BY id) AS n_models,
         row_number() OVER (PARTITION BY id ORDER BY votes DESC, prediction) AS r FROM v) WHERE r = 1""")
def q_vote_hard(spark, sf):
    return EN.vote_hard(si.scored_models(spark, sf))


@query("vote_soft", SCORED + f"""
SELECT id, round(avg(score), {R}) AS score, count(*) AS n_models, CASE WHEN avg(score) > 0.5e0 THEN 1 ELSE 0 END AS prediction
FROM sms GROUP BY id""")
def q_vote_soft(spark, sf):
    return EN.vote_soft(si.scored_models(spark, sf)).select("id", _r("score"), "n_models", "prediction")


@query("vote_families", SCORED + f"""
, a AS (SELECT doc_id AS id, round(least(1.0e0, n_chars / 5000.0e0), 4) AS s FROM documents),
b AS (SELECT id, score AS s FROM sms WHERE model = 'words'),
j AS (SELECT coalesce(a.id, b.id) AS id, a.s AS sa, b.s AS sb FROM a FULL OUTER JOIN b ON a.id = b.id)
SELECT id, (CASE WHEN sa IS NULL THEN 0 ELSE 1 END) + (CASE WHEN sb IS NULL THEN 0 ELSE 1 END) AS n_families,
       round((coalesce(sa, 0.0e0) + coalesce(sb, 0.0e0)) /
             ((CASE WHEN sa IS NULL THEN 0 ELSE 1 END) + (CASE WHEN sb IS NULL THEN 0 ELSE 1 END)), {R}) AS score FROM j""")
def q_vote_families(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "n_chars")
    text_family = d.select(F.col("doc_id").alias("id"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 4).alias("score_text"))
    word_family = si.scored(spark, sf, "words").select("id", F.col("score").alias("score_words"))
    return EN.vote_families(text_family, word_family).select("id", F.col("n_families").cast("int").alias("n_families"), _r("score"))
