"""Incremental corpus ingestion with Structured Streaming.

New binaries dropped into the corpus folder are picked up by a ``binaryFile`` stream; each
micro-batch runs the batch extraction (header decode, section flatten, last-wins merge, pivot,
fill, label) and appends the rows to the raw feature table, rejects to their own table. The
stream's checkpoint (in the shared checkpoint folder unless given) records which files were
processed, so a restarted or re-triggered query only reads new files, and a lost executor
replays the micro-batch. ``trigger(availableNow=True)`` turns the same code into a bounded
catch-up job, which is how a periodic batch ("best done in batches") is expressed.

Exact duplicates are removed within and across micro-batches. By default the content hashes seen so far are
keyed state of the stream (``first_seen``): a batch looks up its own hashes and nothing else, and only parsed
headers meet in the shuffle, never contents. ``dedup="table"`` instead compares each batch with the hashes of
the whole table (a left-anti join), for a table that other jobs write to as well.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from binlens.operators.pe import parse, parsed_feature_table, raw_feature_table
from binlens.session import checkpoint_dir
from binlens.sources.binary import DEFAULT_SKIP, samples_from_files
from binlens.streaming.score import disk_state, first_seen


# The binaryFile source's fixed schema (a stream must be given its schema up front).
BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False), T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False), T.StructField("content", T.BinaryType(), True)])


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before its first batch; other read errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _process(out_path: str, rejects_path: str, fields: list[str] | None):
    """Each batch owns one folder of either table and overwrites it, so a replayed batch changes nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        samples = batch.dropDuplicates(["sample_id"])
        seen = _table(batch.sparkSession, out_path)
        if seen is not None:
            earlier = seen.where(F.col("batch_id") != batch_id).select("sample_id")
            samples = samples.join(earlier, "sample_id", "left_anti")
        _write(raw_feature_table(samples, fields=fields), out_path, rejects_path, batch_id)
    return run


def _write(frames: tuple[DataFrame, DataFrame], out_path: str, rejects_path: str, batch_id: int) -> None:
    for df, path in zip(frames, (out_path, rejects_path)):
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def _process_parsed(out_path: str, rejects_path: str, fields: list[str] | None):
    """As ``_process``, for parsed rows that are new already."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()     # read several times below; the state is asked once
        try:
            _write(parsed_feature_table(batch, fields=fields), out_path, rejects_path, batch_id)
        finally:
            batch.unpersist()
    return run


def ingest_stream(spark: SparkSession, root: str, out_path: str, rejects_path: str, checkpoint: str | None = None,
                  glob: str | None = None, fields: list[str] | None = None, available_now: bool = True,
                  processing_time: str | None = None, max_files_per_trigger: int | None = None,
                  dedup: str = "state") -> StreamingQuery:
    """Start the ingestion stream and return its handle. Of equal contents one is kept, from the earliest batch.

    ``dedup`` (``state`` or ``table``) belongs to the stream's checkpoint: a stream goes on with the kind it began with.
    """
    if dedup not in ("state", "table"):
        raise ValueError(dedup)
    r = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    samples = samples_from_files(r.load(root), DEFAULT_SKIP)
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark).rstrip("/"), "streams", "ingest")
    if dedup == "state":
        source = first_seen(parse(samples, keep=("sample_name", "label")), ["sample_id"])
        process = _process_parsed(out_path, rejects_path, fields)
    else:
        source, process = samples, _process(out_path, rejects_path, fields)
    w = source.writeStream.foreachBatch(process).option("checkpointLocation", ckpt)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    with disk_state(spark):
        return w.start()
