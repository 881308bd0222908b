"""Property tests (hypothesis) and the edge cases of SURVEY §5: MI >= 0 and symmetric, concat
then align is idempotent, one class only, empty input, null label."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from binlens.operators import evaluate as ev
from binlens.operators.features import mutual_information
from binlens.operators.prepare import align_columns, concat_by_name, drop_null_columns

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _mi(spark, xs, ys):
    ids = list(range(len(xs)))
    long_df = spark.createDataFrame([(i, "f", float(x)) for i, x in zip(ids, xs) if x] or [(0, "f", 0.0)][:0],
                                    "id long, feature string, value double")
    lab = spark.createDataFrame(list(zip(ids, ys)), "id long, label int")
    got = {r.feature: r.mi for r in mutual_information(long_df, lab).collect()}
    return got.get("f", 0.0)


pairs = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1)), min_size=4, max_size=30)


@SETTINGS
@given(pairs)
def test_mi_nonnegative_and_symmetric(spark, data):
    xs, ys = [a for a, _ in data], [b for _, b in data]
    if not any(xs):
        return
    a = _mi(spark, xs, ys)
    b = _mi(spark, ys, xs) if any(ys) else None
    assert a >= -1e-12
    if b is not None:
        assert a == pytest.approx(b, abs=1e-9)
    assert a <= math.log(2) + 1e-9          # bounded by the label entropy (two classes)


@SETTINGS
@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), min_size=1, max_size=4, unique=True),
       st.lists(st.sampled_from(["a", "b", "c", "d"]), min_size=1, max_size=4, unique=True))
def test_concat_then_align_is_idempotent(spark, cols1, cols2):
    f1 = spark.createDataFrame([tuple(float(i) for i in range(len(cols1)))], ", ".join(f"{c} double" for c in cols1))
    f2 = spark.createDataFrame([tuple(float(i + 10) for i in range(len(cols2)))], ", ".join(f"{c} double" for c in cols2))
    cat = concat_by_name([f1, f2])
    assert cat.count() == 2 and set(cat.columns) == set(cols1) | set(cols2)
    ref = f1.schema
    once = align_columns(cat, ref)
    twice = align_columns(once, ref)
    assert once.columns == [f.name for f in ref.fields]
    key = lambda t: tuple((x is None, x or 0.0) for x in t)
    assert sorted(map(tuple, once.collect()), key=key) == sorted(map(tuple, twice.collect()), key=key)
    kept = drop_null_columns(cat)
    assert set(kept.columns) == set(cols1) & set(cols2)


def _scored(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, prediction int, score double")


def test_one_class_only(spark):
    df = _scored(spark, [(1, 1, 1, .9), (2, 1, 0, .2)])
    assert ev.roc_auc(df).first()["auc"] is None            # undefined without negatives
    rep = {r.row: r for r in ev.classification_report(df, [0, 1]).collect()}
    assert rep["0"].support == 0 and rep["0"].precision == 0.0
    assert rep["1"].recall == pytest.approx(0.5)


def test_empty_input(spark):
    df = _scored(spark, [])
    cm = ev.confusion_matrix(df, [0, 1]).collect()
    assert len(cm) == 4 and all(r.n == 0 for r in cm)
    assert ev.calibration_curve(df).count() == 0


def test_null_label_rows_are_rejected(spark):
    from binlens.sources.binary import split_label_rejects

    s = spark.createDataFrame([("x", "/c/benign/a", 0), ("y", "/c/other/b", None)],
                              "sample_id string, path string, label int")
    good, bad = split_label_rejects(s)
    assert [r.sample_id for r in good.collect()] == ["x"]
    assert [(r.sample_id, r.reason) for r in bad.collect()] == [("y", "no_label_folder")]
