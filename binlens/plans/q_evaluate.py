"""Evaluation queries (E1-E18) on the fixed scored stand-in (documents x labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from binlens.operators import evaluate as ev
from binlens.plans import standins as si
from binlens.plans.registry import query

R = 6  # digits kept for doubles on both engines


def r(c):
    return F.round(F.col(c), R).alias(c)


# Shared oracle fragments (same fixed expressions as binlens.plans.standins).
SCORED = """
WITH base AS (
  SELECT d.doc_id AS id, l.quality AS label, d.n_chars,
         cast(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
         cast(len(string_split(d.text, ' ')) AS BIGINT) AS n_words
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
sm AS (
  SELECT 'chars' AS model, id, label, round(least(1.0e0, n_chars / 5000.0e0), 4) AS score FROM base
  UNION ALL SELECT 'lines', id, label, round(least(1.0e0, n_lines / 40.0e0), 4) FROM base
  UNION ALL SELECT 'words', id, label, round(least(1.0e0, n_words / 1000.0e0), 4) FROM base),
sms AS (SELECT *, CASE WHEN score >= 0.30e0 THEN 1 ELSE 0 END AS prediction FROM sm),
sc AS (SELECT id, label, score, prediction FROM sms WHERE model = 'chars')
"""

CUM = """
, pn AS (SELECT model, score, sum(label) AS p, sum(1 - label) AS n FROM sms GROUP BY model, score),
cum AS (SELECT model, score, p, n,
          sum(p) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
          sum(n) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
          sum(p) OVER (PARTITION BY model) AS tot_p, sum(n) OVER (PARTITION BY model) AS tot_n FROM pn)
"""

CM = """
, grid AS (SELECT a.c AS label, b.c AS prediction FROM (VALUES (0), (1)) a(c), (VALUES (0), (1)) b(c)),
cnt AS (SELECT label, prediction, count(*) AS n FROM sc GROUP BY label, prediction),
cm AS (SELECT g.label, g.prediction, cast(coalesce(c.n, 0) AS BIGINT) AS n
       FROM grid g LEFT JOIN cnt c ON g.label = c.label AND g.prediction = c.prediction)
"""


@query("accuracy", SCORED + f"SELECT round(avg(CASE WHEN label = prediction THEN 1.0e0 ELSE 0.0e0 END), {R}) AS accuracy, count(*) AS n FROM sc")
def q_accuracy(spark, sf):
    return ev.accuracy(si.scored(spark, sf)).select(r("accuracy"), "n")


@query("confusion_matrix", SCORED + CM + "SELECT label, prediction, n FROM cm")
def q_confusion(spark, sf):
    return ev.confusion_matrix(si.scored(spark, sf), [0, 1])


@query("confusion_normalized", SCORED + CM + f"""
SELECT label, prediction, n,
  round(CASE WHEN sum(n) OVER (PARTITION BY label) > 0 THEN n / sum(n) OVER (PARTITION BY label) ELSE 0.0e0 END, {R}) AS rate
FROM cm""")
def q_confusion_norm(spark, sf):
    return ev.confusion_normalized(si.scored(spark, sf), [0, 1]).select("label", "prediction", "n", r("rate"))


@query("classification_report", SCORED + CM + f"""
, st AS (
  SELECT c.c, c.tp, s.support, p.npred,
         CASE WHEN p.npred > 0 THEN c.tp / p.npred ELSE 0.0e0 END AS precision,
         CASE WHEN s.support > 0 THEN c.tp / s.support ELSE 0.0e0 END AS recall
  FROM (SELECT label AS c, n AS tp FROM cm WHERE label = prediction) c
  JOIN (SELECT label AS c, sum(n) AS support FROM cm GROUP BY label) s ON c.c = s.c
  JOIN (SELECT prediction AS c, sum(n) AS npred FROM cm GROUP BY prediction) p ON c.c = p.c),
st2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0e0 * precision * recall / (precision + recall) ELSE 0.0e0 END AS f1 FROM st),
ag AS (SELECT sum(tp) AS tp, sum(support) AS n, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
              sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM st2)
SELECT cast(c AS VARCHAR) AS "row", round(precision, {R}) AS precision, round(recall, {R}) AS recall,
       round(f1, {R}) AS f1_score, cast(support AS BIGINT) AS support FROM st2
UNION ALL SELECT 'accuracy', NULL, NULL, round(tp / n, {R}), cast(n AS BIGINT) FROM ag
UNION ALL SELECT 'macro avg', round(mp, {R}), round(mr, {R}), round(mf, {R}), cast(n AS BIGINT) FROM ag
UNION ALL SELECT 'weighted avg', round(wp / n, {R}), round(wr / n, {R}), round(wf / n, {R}), cast(n AS BIGINT) FROM ag
""")
def q_report(spark, sf):
    return ev.classification_report(si.scored(spark, sf), [0, 1]).select(
        "row", r("precision"), r("recall"), r("f1_score"), "support")


@query("roc_curve", SCORED + CUM + f"""
SELECT round(max(score) + 1.0e0, {R}) AS threshold, 0.0e0 AS fpr, 0.0e0 AS tpr FROM cum WHERE model = 'chars'
UNION ALL
SELECT round(score, {R}), round(fp / tot_n, {R}), round(tp / tot_p, {R}) FROM cum WHERE model = 'chars'""")
def q_roc(spark, sf):
    return ev.roc_curve(si.scored(spark, sf)).select(r("threshold"), r("fpr"), r("tpr"))


@query("roc_auc", SCORED + CUM + f"""
SELECT model, round(sum(n * (tp - p / 2.0e0)) / (max(tot_p) * max(tot_n)), {R}) AS auc FROM cum GROUP BY model""")
def q_auc(spark, sf):
    return ev.roc_auc(si.scored_models(spark, sf), by=["model"]).select("model", r("auc"))


@query("roc_by_model", SCORED + CUM + f"""
, pts AS (
  SELECT model, max(score) + 1.0e0 AS threshold, 0.0e0 AS fpr, 0.0e0 AS tpr FROM cum GROUP BY model
  UNION ALL SELECT model, score, fp / tot_n, tp / tot_p FROM cum)
SELECT model, round(threshold, {R}) AS threshold, round(fpr, {R}) AS fpr, round(tpr, {R}) AS tpr
FROM pts""")
def q_roc_by_model(spark, sf):
    roc = ev.roc_curve(si.scored_models(spark, sf), by=["model"])
    return roc.select("model", r("threshold"), r("fpr"), r("tpr"))


@query("pr_curve", SCORED + CUM + f"""
, c AS (SELECT * FROM cum WHERE model = 'chars' AND tot_p > 0 AND tp - p < tot_p)
SELECT round(score, {R}) AS threshold, round(tp / (tp + fp), {R}) AS precision, round(tp / tot_p, {R}) AS recall FROM c
UNION ALL SELECT NULL, 1.0e0, 0.0e0""")
def q_pr(spark, sf):
    return ev.pr_curve(si.scored(spark, sf)).select(r("threshold"), r("precision"), r("recall"))


@query("threshold_confusion", SCORED + """
, rl AS (SELECT label, CASE WHEN score >= 0.5e0 THEN 1 ELSE 0 END AS prediction FROM sc),
grid AS (SELECT a.c AS label, b.c AS prediction FROM (VALUES (0), (1)) a(c), (VALUES (0), (1)) b(c)),
cnt AS (SELECT label, prediction, count(*) AS n FROM rl GROUP BY label, prediction)
SELECT g.label, g.prediction, cast(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt c ON g.label = c.label AND g.prediction = c.prediction""")
def q_threshold_confusion(spark, sf):
    return ev.threshold_confusion(si.scored(spark, sf), 0.5)


@query("nearest_threshold", SCORED + CUM + f"""
, c AS (SELECT * FROM cum WHERE model = 'chars' AND tot_p > 0 AND tp - p < tot_p)
SELECT round(score, {R}) AS threshold, round(tp / (tp + fp), {R}) AS precision, round(tp / tot_p, {R}) AS recall
FROM c ORDER BY abs(score - 0.3e0), score LIMIT 1""")
def q_nearest_threshold(spark, sf):
    return ev.nearest_threshold(si.scored(spark, sf), 0.30).select(r("threshold"), r("precision"), r("recall"))


@query("calibration_curve", SCORED + f"""
SELECT model, least(cast(floor(score * 10.0e0 / (1.0e0 + 1.0e-8)) AS INTEGER), 9) AS bin,
       round(avg(score), {R}) AS mean_score, round(avg(cast(label AS DOUBLE)), {R}) AS fraction_positive, count(*) AS n
FROM sms GROUP BY ALL""")
def q_calibration(spark, sf):
    return ev.calibration_curve(si.scored_models(spark, sf), by=["model"]).select(
        "model", "bin", r("mean_score"), r("fraction_positive"), "n")


@query("score_histogram", SCORED + """
, b AS (SELECT (CASE WHEN score >= 0.1e0 THEN 1 ELSE 0 END) + (CASE WHEN score >= 0.2e0 THEN 1 ELSE 0 END)
   + (CASE WHEN score >= 0.30000000000000004e0 THEN 1 ELSE 0 END) + (CASE WHEN score >= 0.4e0 THEN 1 ELSE 0 END)
   + (CASE WHEN score >= 0.5e0 THEN 1 ELSE 0 END) + (CASE WHEN score >= 0.6000000000000001e0 THEN 1 ELSE 0 END)
   + (CASE WHEN score >= 0.7000000000000001e0 THEN 1 ELSE 0 END) + (CASE WHEN score >= 0.8e0 THEN 1 ELSE 0 END)
   + (CASE WHEN score >= 0.9e0 THEN 1 ELSE 0 END) AS bin FROM sc WHERE score >= 0 AND score <= 1),
g AS (SELECT cast(range AS INTEGER) AS bin FROM range(10))
SELECT g.bin, cast(count(b.bin) AS BIGINT) AS n FROM g LEFT JOIN b ON g.bin = b.bin GROUP BY g.bin""")
def q_histogram(spark, sf):
    return ev.score_histogram(si.scored(spark, sf))


@query("misclassified", SCORED + "SELECT id, label, prediction FROM sc WHERE label <> prediction")
def q_misclassified(spark, sf):
    return ev.misclassified(si.scored(spark, sf))


@query("confidence_table", SCORED + f"""
SELECT id, prediction, round(score, {R}) AS p_positive, round(1.0e0 - score, {R}) AS p_negative FROM sc""")
def q_confidence(spark, sf):
    return ev.confidence_table(si.scored(spark, sf)).select("id", "prediction", r("p_positive"), r("p_negative"))
