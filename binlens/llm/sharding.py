"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into blocks by a hash of their content. The number of rows that block ``i`` sends to
shard ``j`` is drawn from the multivariate hypergeometric law whose margins are the block counts and the
wanted shard sizes, so every shard size is exact. Each block permutes its rows and sends the first
``A[i,0]`` to shard 0, the next ``A[i,1]`` to shard 1 and so on; each shard permutes what it received.
Together these make every assignment equally likely.

Both permutations are sorts by a keyed hash. A shard is sorted in slices of its hash range, so no task
holds a shard: a slice has about ``block_rows`` rows. Only the block counts (``max_blocks`` at most)
reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
#: numpy's exact hypergeometric sampler takes populations below this.
EXACT_BELOW = 10**9


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < EXACT_BELOW:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad      # beyond 10^9 rows the law is normal to about 1e-5 of its width
    mean, share = n * good / total, good / total
    width = math.sqrt(n * share * (1 - share) * (total - n) / (total - 1))
    return min(max(round(rng.normal(mean, width)), n - bad, 0), good, n)


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Counts with these row and column sums, drawn as a uniform random deal would give them."""
    rng = np.random.default_rng(seed)
    left = list(shard_rows)
    out = np.zeros((len(block_rows), len(shard_rows)), np.int64)
    for i, m in enumerate(block_rows):
        rest = sum(left)
        for j, good in enumerate(left):
            rest -= good
            out[i, j] = _draw(rng, good, rest, m)
            m -= out[i, j]
        left = [a - int(b) for a, b in zip(left, out[i])]
    return out


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
               seed: int = 17, block_rows: int = 10_000, max_blocks: int = 4096, carry: bool = True) -> DataFrame:
    """``docs`` with ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard), in struct
    ``row`` (when ``carry``) beside ``id``, ``size`` (UTF-8 bytes plus 8) and ``text_crc32``.

    Shard sizes differ by one at most. The result depends on the rows and ``seed`` only, not on how they
    are partitioned. Null texts have no bytes (crc32 of the empty text); null ids hash like a value;
    repeated rows are dealt one by one; an empty table gives no rows. Extra columns only travel in
    ``row``, so their names can't clash.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(*([F.struct("*").alias("row")] if carry else []), F.col(id_col).alias("id"),
                        (F.octet_length(text).cast("long") + 8).alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    tag = [F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("text_crc32")]
    keyed = keyed.withColumns({"h0": F.xxhash64(F.lit(seed), *tag), "h1": F.xxhash64(F.lit(seed + 1), *tag),
                               "h2": F.xxhash64(F.lit(seed + 2), *tag)})
    total = docs.count()
    n = min(max_blocks, max(8, -(-total // block_rows)))
    keyed = keyed.withColumn("block", F.pmod("h0", F.lit(n)).cast("int"))
    found = {r["block"]: r["rows"] for r in keyed.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).collect()}
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([found.get(i, 0) for i in range(n)], sizes, seed)
    bounds = spark.createDataFrame([(i, [int(x) for x in np.cumsum(matrix[i])]) for i in range(n)],
                                   "block int, bounds array<long>")
    inside = Window.partitionBy("block").orderBy("h1", "id", "text_crc32", "size")
    dealt = (keyed.withColumn("pos", F.row_number().over(inside))
             .join(F.broadcast(bounds), "block")     # at most max_blocks rows
             .withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("pos"))))
             .drop("bounds", "pos", "block", "h0"))
    bits = max(1, math.ceil(math.log2(max(1, total / shards / block_rows))))
    dealt = dealt.withColumn("slice", F.shiftrightunsigned("h2", 64 - bits))
    counts = dealt.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    again = Window.partitionBy("shard", "slice").orderBy("h2", "h1", "id", "text_crc32", "size")
    return (dealt.withColumn("n", F.row_number().over(again)).join(offsets, ["shard", "slice"])
            .withColumn("slot", (F.col("offset") + F.col("n") - 1).cast("long"))
            .select(*(["row"] if carry else []), "id", "size", "text_crc32", "shard", "slot"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    seed: int = 17) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot`` beside them (named ``shard_1``, ... if taken)."""
    out = shard_rows(docs, id_col, text_col, shards, seed)
    taken = {c.lower() for c in docs.columns}

    def free(name):
        return next(c for c in (name, *(f"{name}_{i}" for i in range(1, 1000))) if c not in taken)

    return out.select("row.*", F.col("shard").alias(free("shard")), F.col("slot").alias(free("slot")))
