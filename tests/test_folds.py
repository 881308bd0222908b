"""Fold and position properties (F1, C18): disjoint, covering, balanced, equal to row_number."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from binlens.functions.ranking import group_position, stratified_folds
from binlens.plans.prepared import split_and_folds


def _frame(spark, n=203):
    return spark.createDataFrame([(i, 1 if i % 7 else 0) for i in range(n)], "id long, label int")


def test_group_position_equals_row_number(spark):
    df = _frame(spark).withColumn("h", F.md5(F.col("id").cast("string")))
    got = group_position(df, ["label"], ["h", "id"], num_partitions=5).select("id", "pos")
    want = df.select("id", F.row_number().over(Window.partitionBy("label").orderBy("h", "id")).alias("pos"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_folds_balanced_and_cover(spark):
    k = 5
    f = stratified_folds(_frame(spark), "id", "label", k).collect()
    assert len(f) == 203 and len({r.id for r in f}) == 203
    for lab in (0, 1):
        sizes = [sum(1 for r in f if r.label == lab and r.fold == i) for i in range(k)]
        assert max(sizes) - min(sizes) <= 1


def test_split_and_cv_folds(spark):
    rows = split_and_folds(_frame(spark)).collect()
    test = [r for r in rows if r.split == "test"]
    train = [r for r in rows if r.split == "train"]
    assert all(r.cv_fold == -1 for r in test)
    assert {r.cv_fold for r in train} == set(range(5))
    for lab in (0, 1):
        sizes = [sum(1 for r in train if r.label == lab and r.cv_fold == i) for i in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_running_sums_equal_window_on_a_hot_group(spark):
    from binlens.functions.ranking import running_sums

    # group "a" holds most rows; the range split spreads it over several partitions
    rows = [("a" if i % 10 else "b", float(i * 7 % 101), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, s double, v long").dropDuplicates(["g", "s"])
    got = running_sums(df, ["g"], [F.col("s").desc()], ["v"], num_partitions=6).select("g", "s", "cum_v")
    w = Window.partitionBy("g").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("g", "s", F.sum("v").over(w).alias("cum_v"))
    assert sorted(got.collect()) == sorted(want.collect())
