"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

All stages but the last return the columns of ``documents``; the last adds ``shard`` and ``slot``. Each
stage works on whatever its predecessor kept, whole.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from binlens.llm.decontaminate import drop_leaks
from binlens.llm.mixing import mix_documents
from binlens.llm.quality import keep_good
from binlens.llm.sharding import shard_documents
from binlens.llm.simhash import drop_near_copies
from binlens.session import scratch_path
from binlens.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the limits and are no robust outlier of their language and source."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 2 bits)."""
    return drop_near_copies(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document's blocks are used, with the words used."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and its place in it."""
    return shard_documents(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_copies), ("decontaminate", decontaminate),
          ("mix", mix_sources), ("shard", shard)]

#: Fingerprints, robust estimates, alignments and hypergeometric draws have no SQL form; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
