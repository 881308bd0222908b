"""Scoring in a stream equals batch scoring; keyed state holds across batches, triggers and replays."""

import os
import tempfile

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from binlens.plans.q_stream import q_stream_scores
from binlens.plans.prepared import train_test
from binlens.operators import roster
from binlens.streaming.ingest import ingest_stream
from binlens.streaming.score import _PROVIDER, confusion_stream, finish, first_seen, follow, score_stream

from conftest import SF001
from test_pe_decode import make_pe
from test_streaming import _write


def _rows(spark, lo, hi):
    return spark.range(lo, hi, 1, 2).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                            (F.col("id") % 7 > 3).cast("int").alias("label"))


@pytest.fixture(scope="module")
def model(spark):
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="features"), DecisionTreeClassifier(maxDepth=2)]
    return Pipeline(stages=stages).fit(_rows(spark, 0, 50))


def test_stream_scores_equal_batch_scores(spark, model):
    work = tempfile.mkdtemp(prefix="binlens-score-")
    rows = _rows(spark, 0, 200)
    columns = ["id", "label", "prediction"]

    def run():
        finish(score_stream(follow(spark, work + "/in", rows.schema, 1), model, work + "/scores", ["id"], columns, work + "/log"))
        scores = follow(spark, work + "/scores", model.transform(rows).select(*columns).schema)
        finish(confusion_stream(scores, work + "/counts", checkpoint=work + "/log2"))

    rows.write.parquet(work + "/in")
    before = spark.conf.get(_PROVIDER)
    run()
    assert spark.conf.get(_PROVIDER) == before
    want = model.transform(rows).select(*columns)
    assert sorted(spark.read.parquet(work + "/scores").collect()) == sorted(want.collect())

    # a replay upstream writes old rows again under new names, beside new ones
    _rows(spark, 150, 260).write.mode("append").parquet(work + "/in")
    run()
    want = model.transform(_rows(spark, 0, 260)).select(*columns)
    assert sorted(spark.read.parquet(work + "/scores").collect()) == sorted(want.collect())
    counts = want.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(spark.read.parquet(work + "/counts").collect()) == sorted(counts.collect())


def test_null_keys_and_labels(spark, model):
    work = tempfile.mkdtemp(prefix="binlens-score-null-")
    rows = spark.createDataFrame([(None, 1.0, 1.0, None), (None, 2.0, 2.0, 1), (3, 6.0, 1.0, None)], "id long, a double, b double, label int")
    rows.write.parquet(work + "/in")
    finish(score_stream(follow(spark, work + "/in", rows.schema), model, work + "/scores", ["id"], ["id", "label", "prediction"], work + "/log"))
    scores = spark.read.parquet(work + "/scores")
    assert sorted(r["id"] or 0 for r in scores.collect()) == [0, 3]
    finish(confusion_stream(follow(spark, work + "/scores", scores.schema), work + "/counts", checkpoint=work + "/log2"))
    assert spark.read.parquet(work + "/counts").agg(F.sum("n")).first()[0] == 2


def test_empty_folder(spark, model):
    work = tempfile.mkdtemp(prefix="binlens-score-empty-")
    rows = _rows(spark, 0, 1).limit(0)
    rows.write.parquet(work + "/in")
    finish(score_stream(follow(spark, work + "/in", rows.schema), model, work + "/scores", ["id"], ["id", "prediction"], work + "/log"))
    schema = model.transform(rows).select("id", "prediction").schema
    assert not os.path.exists(work + "/scores") or spark.read.schema(schema).parquet(work + "/scores").count() == 0


@pytest.mark.parametrize("dedup", ["state", "table"])
def test_copies_over_many_batches(spark, dedup):
    work = tempfile.mkdtemp(prefix="binlens-copies-")
    root, out, rej = (os.path.join(work, d) for d in ("corpus", "table", "rejects"))
    kinds = [make_pe(1595927012 + i, [(b".text", 100 + i)]) for i in range(3)]
    for i in range(9):
        _write(root, f"benign/{i}.exe", kinds[i % 3])
    _write(root, "malware/junk0.exe", b"junk")
    _write(root, "malware/junk1.exe", b"junk")
    for _ in range(2):
        ingest_stream(spark, root, out, rej, checkpoint=work + "/log", max_files_per_trigger=2, dedup=dedup).awaitTermination(240)
    got = spark.read.parquet(out)
    assert got.count() == 3 == got.select("sample_id").distinct().count()
    if dedup == "state":        # rejects are remembered too
        assert spark.read.parquet(rej).count() == 1
    with pytest.raises(ValueError):
        ingest_stream(spark, root, out, rej, dedup="memory")


def test_registered_scores_are_the_batch_scores(spark):
    got = {r["id"]: r["prediction"] for r in q_stream_scores(spark, SF001).collect()}
    train, test, names = train_test(spark, SF001)
    want = roster.builders(len(names), train.count())["random_forest"](train).model.transform(test)
    assert got == {r["id"]: r["prediction"] for r in want.select("id", "prediction").collect()} and got
