"""Evaluation tables on hand-made scored rows: zero cells, 0/0, ties, bins, AUC = rank statistic."""

import itertools
import random

import pytest

from binlens.operators import evaluate as ev


def scored(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, prediction int, score double")


def test_confusion_has_zero_cells(spark):
    df = scored(spark, [(1, 1, 1, .9), (2, 1, 1, .8), (3, 1, 1, .7)])
    cm = {(r.label, r.prediction): r.n for r in ev.confusion_matrix(df, [0, 1]).collect()}
    assert cm == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 3}


def test_normalized_rows_sum_to_one_or_zero(spark):
    df = scored(spark, [(1, 1, 0, .2), (2, 1, 1, .8), (3, 1, 1, .7), (4, 0, 1, .6)])
    rates = {(r.label, r.prediction): r.rate for r in ev.confusion_normalized(df, [0, 1]).collect()}
    assert rates[(1, 1)] == pytest.approx(2 / 3)
    assert rates[(0, 1)] == pytest.approx(1.0)


def test_report_zero_division_is_zero(spark):
    # class 0 is never predicted: its precision is 0/0 -> 0
    df = scored(spark, [(1, 0, 1, .9), (2, 1, 1, .8), (3, 1, 1, .7), (4, 1, 1, .6)])
    rep = {r.row: r for r in ev.classification_report(df, [0, 1]).collect()}
    assert rep["0"].precision == 0.0 and rep["0"].recall == 0.0 and rep["0"].f1_score == 0.0
    assert rep["1"].precision == pytest.approx(0.75) and rep["1"].recall == 1.0
    assert rep["accuracy"].f1_score == pytest.approx(0.75)
    assert rep["macro avg"].recall == pytest.approx(0.5)
    assert rep["weighted avg"].support == 4


def _rank_auc(rows):
    pos = [s for _, y, _, s in rows if y == 1]
    neg = [s for _, y, _, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_auc_equals_rank_statistic(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 1), 0, round(rnd.random(), 1)) for i in range(60)]   # many ties
    auc = ev.roc_auc(scored(spark, rows)).collect()[0]
    value = auc["auc"] if "auc" in auc.asDict() else auc[-1]
    assert value == pytest.approx(_rank_auc(rows), abs=1e-9)


def test_roc_starts_at_origin_and_ends_at_one(spark):
    rows = [(1, 1, 1, .9), (2, 0, 1, .8), (3, 1, 0, .4), (4, 0, 0, .1)]
    pts = ev.roc_curve(scored(spark, rows)).collect()
    fpr = sorted(r.fpr for r in pts)
    tpr = sorted(r.tpr for r in pts)
    assert fpr[0] == 0.0 and tpr[0] == 0.0 and fpr[-1] == 1.0 and tpr[-1] == 1.0


def test_calibration_top_score_in_last_bin_and_empty_bins_omitted(spark):
    rows = [(1, 1, 1, 1.0), (2, 0, 1, 0.95), (3, 0, 0, 0.05)]
    bins = ev.calibration_curve(scored(spark, rows)).collect()
    assert len(bins) == 2
    top = max(bins, key=lambda r: r.mean_score)
    assert top.fraction_positive == pytest.approx(0.5)


def test_threshold_relabel(spark):
    rows = [(1, 1, 0, .3), (2, 0, 0, .29), (3, 1, 0, .31)]
    out = {r.id: r.prediction for r in ev.relabel(scored(spark, rows), 0.30).collect()}
    assert out == {1: 1, 2: 0, 3: 1}


def test_misclassified(spark):
    rows = [(1, 1, 0, .3), (2, 0, 0, .29), (3, 1, 1, .31)]
    assert [r.id for r in ev.misclassified(scored(spark, rows)).collect()] == [1]
