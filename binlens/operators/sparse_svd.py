"""Truncated SVD of a wide sparse matrix in long form (C19): a randomised range finder with power iterations.

With A the (rows x d) matrix and Z a (d x l) basis, l = k + ``oversample``, one pass over the rows gives A'(A Z): a task computes its rows of
A Z and adds up their share, which meets the other tasks' by feature. The basis is made orthonormal after every pass. The last
pass gives (A Z)'(A Z), l x l, whose eigenvectors turn the basis into singular vectors. No d x d matrix exists; the driver holds the d x l basis.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binlens.functions.sums import vector_sum


def sparse_rows(long: DataFrame, id_col: str = "id", feature_col: str = "feature_idx", value_col: str = "value") -> DataFrame:
    """(id, places, values): one row per id; a repeated (id, feature) adds up."""
    cells = long.groupBy(id_col, feature_col).agg(F.sum(F.col(value_col).cast("double")).alias("_v"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(feature_col).cast("int").alias("i"), F.col("_v").alias("v"))))      # at most d of them
    return cells.groupBy(id_col).agg(pairs.alias("_p")).select(F.col(id_col).alias("id"), F.col("_p.i").alias("places"), F.col("_p.v").alias("values"))


def _csr(b: pa.RecordBatch):
    places, values = b.column(b.schema.get_field_index("places")), b.column(b.schema.get_field_index("values"))
    size = places.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(b.num_rows), size), places.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)


def _times(row, col, val, rows: int, z: np.ndarray) -> np.ndarray:
    """A Z for rows in order: one weighted count for each column of Z."""
    return np.stack([np.bincount(row, val * z[col, j], rows) for j in range(z.shape[1])], 1)


def randomised_svd(rows: DataFrame, d: int, k: int, n_iter: int = 10, oversample: int = 10, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((id, components = U s), singular values, V) of ``sparse_rows``; each component's largest entry in V is positive."""
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    width = min(k + oversample, d)
    z = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    spark = rows.sparkSession
    for _ in range(n_iter):
        sent = spark.sparkContext.broadcast(z)

        def share(batches, sent=sent):
            z, total, seen = sent.value, np.zeros((d, width)), np.zeros(d, bool)
            for b in batches:
                row, col, val = _csr(b)
                y = _times(row, col, val, b.num_rows, z)
                for j in range(width):
                    total[:, j] += np.bincount(col, val * y[row, j], d)
                seen[col] = True
            at = np.flatnonzero(seen)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(total[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), flat], names=["i", "v"])

        sums = held.mapInArrow(share, "i int, v array<double>").groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width)]).toArrow()     # d rows at most
        new = np.zeros((d, width))
        if sums.num_rows:
            new[sums.column("i").to_numpy()] = np.stack([sums.column(f"v{j}").to_numpy() for j in range(width)], 1)
        z = np.linalg.qr(new)[0]
        sent.unpersist()
    sent = spark.sparkContext.broadcast(z)

    def gram(batches):
        total = np.zeros((width, width))
        for b in batches:
            y = _times(*_csr(b), b.num_rows, sent.value)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    values, turn = np.linalg.eigh(vector_sum(held.mapInArrow(gram, "v array<double>"), width * width).reshape(width, width))
    order = np.argsort(-values, kind="stable")[:k]
    s, v = np.sqrt(np.maximum(values[order], 0.0)), z @ turn[:, order]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    held.unpersist()
    return project(rows, v), s, v


def project(rows: DataFrame, v: np.ndarray) -> DataFrame:
    """(id, components) of sparse rows: A V."""
    sent, kind = rows.sparkSession.sparkContext.broadcast(v), rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            y = _times(*_csr(b), b.num_rows, sent.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), flat], names=["id", "components"])

    return rows.mapInArrow(run, f"id {kind}, components array<double>")
