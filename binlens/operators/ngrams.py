"""Byte n-grams (B12): counts per sample, document-frequency vocabulary, hashed vectors.

Grams are cut from the binary column with ``substring`` over a ``sequence`` of offsets and
rendered as hex; counting is a grouped aggregate (map-side combined), so a sample of any size is
split across the rows of its partition rather than held as one Python object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def byte_ngrams(samples: DataFrame, id_col: str = "sample_id", content: str = "content", n: int = 2) -> DataFrame:
    """(id, gram) for every byte offset; gram = upper-case hex of n bytes."""
    length = F.octet_length(F.col(content))
    offs = F.when(length >= n, F.sequence(F.lit(1), length - n + 1)).otherwise(F.array().cast("array<int>"))
    exploded = samples.select(id_col, content, F.explode(offs).alias("off"))
    return exploded.select(id_col, F.hex(F.col(content).substr(F.col("off"), F.lit(n))).alias("gram"))


def ngram_counts(samples: DataFrame, id_col: str = "sample_id", content: str = "content", n: int = 2) -> DataFrame:
    """(id, gram, n) counts."""
    return byte_ngrams(samples, id_col, content, n).groupBy(id_col, "gram").agg(F.count(F.lit(1)).alias("n"))


def ngram_vocabulary(counts: DataFrame, k: int, id_col: str = "sample_id") -> DataFrame:
    """Top-k grams by document frequency (ties: smaller gram first) -> (gram, df, rank).

    ``counts`` has one row per (id, gram), so the document frequency is a plain count. The
    top-k is a distributed ``orderBy().limit(k)`` (each partition keeps its own k best, then one
    merge), so the up to 256**n distinct grams are never sorted in a single task; only the k
    survivors are numbered."""
    dfreq = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    best = dfreq.orderBy(F.col("df").desc(), F.col("gram")).limit(k)
    w = Window.orderBy(F.col("df").desc(), F.col("gram"))
    return best.withColumn("rank", F.row_number().over(w))
