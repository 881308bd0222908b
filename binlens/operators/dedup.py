"""Exact duplicate removal (B1).

Copies are found by (SHA-256, length). The keeper is the smallest path, chosen with a grouped
``min_by`` (partial aggregation on the map side), not a window: a group holding a third of the
corpus is combined in every task before the shuffle instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_groups(samples: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(sample_id, length, keep_path, n_copies) per distinct content."""
    keyed = samples.select(F.sha2(F.col(content), 256).alias("sample_id"),
                           F.octet_length(F.col(content)).cast("bigint").alias("length"), F.col(path))
    return keyed.groupBy("sample_id", "length").agg(F.min(path).alias("keep_path"),
                                                    F.count(F.lit(1)).alias("n_copies"))


def dedup_exact(samples: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """One row per distinct content: the copy with the smallest path, with all its columns."""
    keyed = samples.withColumn("sample_id", F.sha2(F.col(content), 256)) \
                   .withColumn("length", F.octet_length(F.col(content)).cast("bigint"))
    others = [c for c in keyed.columns if c not in ("sample_id", "length")]
    best = keyed.groupBy("sample_id", "length").agg(F.min_by(F.struct(*others), F.col(path)).alias("r"),
                                                    F.count(F.lit(1)).alias("n_copies"))
    return best.select("sample_id", "length", "r.*", "n_copies")


def duplicate_groups(samples: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Report of contents seen more than once."""
    return content_groups(samples, content, path).filter(F.col("n_copies") > 1)
