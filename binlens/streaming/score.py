"""Scoring in a stream: fitted models applied to rows as they arrive, with keyed state across batches.

``score_stream`` reads a growing Parquet folder, keeps the first row of each key (state, so a row that an
upstream replay writes twice is scored once), applies a fitted model and appends the scores through the file
sink, whose log makes every batch appear once. ``confusion_stream`` follows the scores and keeps a running
confusion table: the state is one count for each (label, prediction), whatever the length of the stream.

State lives in RocksDB on the executors' disks and in the checkpoint folder, from which a lost executor's
part is restored; memory does not grow with the keys seen.
"""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from binlens.session import checkpoint_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def disk_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's setting is put back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, in this batch or any before; null keys are a key of their own.

    The state holds the keys alone. They are never forgotten: a copy is recognised however late it comes."""
    return stream.dropDuplicates(keys)


def follow(spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder as a stream of the rows that are added to it."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def _start(spark: SparkSession, writer, checkpoint: str | None, name: str, available_now: bool, processing_time: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint or os.path.join(checkpoint_dir(spark).rstrip("/"), "streams", name))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    with disk_state(spark):
        return writer.start()


def score_stream(rows: DataFrame, model, out_path: str, keys: list[str], columns: list[str], checkpoint: str | None = None,
                 available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Score a stream of ``rows`` and append ``columns`` of the result to ``out_path``; returns the stream's handle.

    ``model`` is anything whose ``transform`` works row by row (a ``PipelineModel``, a forest, a network); neighbours and
    other models that join tables belong into a batch. Rows are scored once for each value of ``keys``.
    """
    scored = model.transform(first_seen(rows, keys)).select(*columns)
    writer = scored.writeStream.format("parquet").option("path", out_path).outputMode("append")
    return _start(rows.sparkSession, writer, checkpoint, "score", available_now, processing_time)


def confusion_stream(scores: DataFrame, out_path: str, label: str = "label", prediction: str = "prediction", checkpoint: str | None = None,
                     available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Follow a stream of scores and keep (label, prediction, n) in ``out_path``, rewritten whole after each batch: as
    many rows as there are classes squared. Rows without a label count under a null label."""
    counts = scores.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(out_path)

    writer = counts.writeStream.outputMode("complete").foreachBatch(replace)
    return _start(scores.sparkSession, writer, checkpoint, "confusion", available_now, processing_time)


def finish(query: StreamingQuery) -> None:
    """Wait for a bounded stream; its error, if any, is raised."""
    query.awaitTermination()
