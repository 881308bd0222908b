"""Streaming queries: the driver tables arrive as files over several micro-batches."""

from __future__ import annotations

import math
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binlens.operators import roster
from binlens.plans import standins as si
from binlens.plans.prepared import train_test
from binlens.plans.q_evaluate import SCORED
from binlens.plans.q_extract import SAMPLES
from binlens.plans.registry import query
from binlens.session import scratch_path
from binlens.streaming.score import confusion_stream, disk_state, finish, first_seen, follow, score_stream

#: Micro-batches that a table is dealt over.
BATCHES = 3


def _folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _arriving(spark: SparkSession, df: DataFrame, key: str, folder: str) -> DataFrame:
    """``df`` as a stream: its rows land in files, a third of which arrive in each micro-batch."""
    files = max(BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(files, key).write.parquet(folder + "/in")
    return follow(spark, folder + "/in", df.schema, math.ceil(files / BATCHES))


@query("stream_first_seen", SAMPLES + "SELECT DISTINCT sha256(text) AS sample_id, cast(strlen(text) AS BIGINT) AS length FROM samples")
def q_first_seen(spark, sf):
    folder = _folder(spark, "stream-seen")
    keyed = si.samples(spark, sf).select("doc_id", F.sha2("content", 256).alias("sample_id"), F.octet_length("content").cast("long").alias("length"))
    new = first_seen(_arriving(spark, keyed, "doc_id", folder), ["sample_id"]).select("sample_id", "length")
    with disk_state(spark):
        q = new.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/log").trigger(availableNow=True).start()
    finish(q)
    return spark.read.schema(new.schema).parquet(folder + "/out")


@query("stream_confusion", SCORED + "SELECT label, prediction, count(*) AS n FROM sc GROUP BY label, prediction")
def q_stream_confusion(spark, sf):
    """A pipeline model scores the labelled documents as they arrive; a second stream counts its results."""
    folder = _folder(spark, "stream-confusion")
    column, scale = si.MODEL_SCORES["chars"]
    model = PipelineModel([
        SQLTransformer(statement=f"SELECT *, round(least(1.0D, {column} / {scale}D), 4) AS score FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, CASE WHEN score >= {si.THRESHOLD}D THEN 1 ELSE 0 END AS prediction FROM __THIS__")])
    docs = si.labelled_docs(spark, sf).select("doc_id", "label", column)
    columns = ["doc_id", "label", "score", "prediction"]
    finish(score_stream(_arriving(spark, docs, "doc_id", folder), model, folder + "/scores", ["doc_id"], columns, folder + "/log"))
    schema = model.transform(docs).select(*columns).schema
    finish(confusion_stream(follow(spark, folder + "/scores", schema), folder + "/counts", checkpoint=folder + "/log2"))
    return spark.read.parquet(folder + "/counts")


@query("stream_scores")
def q_stream_scores(spark, sf):
    """The roster's forest, fitted on the training rows, scores the test rows as they arrive."""
    train, test, names = train_test(spark, sf)
    model = roster.builders(len(names), train.count())["random_forest"](train).model
    folder = _folder(spark, "stream-scores")
    columns = ["id", "label", "prediction"]
    finish(score_stream(_arriving(spark, test.select("id", "label", "features"), "id", folder), model, folder + "/scores", ["id"], columns, folder + "/log"))
    return spark.read.parquet(folder + "/scores")
