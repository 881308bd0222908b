"""Whitening of embeddings from covariances recovered by polarisation.

Vectors become whole numbers (a fixed grid), so every statistic is exact. Over the distinct vectors, shifted by
their rounded mean, each task adds up the squares of every dimension and of every sum of two dimensions:

    cov(i, j) = (var(z_i + z_j) - var(z_i) - var(z_j)) / 2

The sums are integers (64-bit where they provably fit, else unbounded), added in Spark as ``decimal(38,0)``, and the
covariances come from exact integers by one division each. One d x d matrix reaches the driver for its eigenvectors;
nothing else there grows with the input.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binlens.llm.common import materialise

#: Grid values beyond this magnitude are set to it, so that all sums of squares stay exact.
LARGEST = float(1 << 50)
CHUNK = 4096
_FITS = 1 << 62


def on_grid(vector: Column, scale: int, shift: int) -> Column:
    """``floor(scale * c) + shift`` of every entry, as longs."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-LARGEST)), F.lit(LARGEST))).cast("bigint") + shift)


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact(z: np.ndarray, bound: int) -> np.ndarray:
    """``z`` as it is where results stay within ``bound`` < 2**62, else as unbounded integers."""
    return z if bound < _FITS else z.astype(object)


def pair_index(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions, then pairs i < j in row order: the places of the sums."""
    i, j = np.triu_indices(d, 1)
    return np.concatenate([np.arange(d), i]), np.concatenate([np.arange(d), j])


def polar_sums(z: np.ndarray) -> list[int]:
    """Sums over rows of z_i ** 2, then of (z_i + z_j) ** 2 for i < j."""
    rows, d = z.shape
    most = int(np.abs(z).max(initial=0))
    z = exact(z, 4 * most * most * max(rows, 1))
    squares = (z * z).sum(0).tolist()
    for i in range(d - 1):
        both = z[:, i + 1:] + z[:, i:i + 1]
        squares += (both * both).sum(0).tolist() if both.dtype == object else np.einsum("rj,rj->j", both, both).tolist()
    return squares


def plain_sums(x: np.ndarray) -> list[int]:
    most = int(np.abs(x).max(initial=0))
    return [len(x), *exact(x, most * max(len(x), 1)).sum(0).tolist()]


def summed(fit: DataFrame, d: int, width: int, step, shift: list[int]) -> list[int]:
    """``step`` of the shifted rows of every chunk, added over all rows: ``width`` exact integers."""
    def run(batches):
        total = [0] * width
        for b in batches:
            x = matrix(b.column(0), d) - np.array(shift, np.int64)
            for lo in range(0, len(x), CHUNK):
                total = [p + q for p, q in zip(total, step(x[lo:lo + CHUNK]))]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))], names=["i", "v"])

    parts = fit.where(F.col("d") == d).select("x").mapInArrow(run, "i int, v decimal(38,0)")
    out = [0] * width
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():       # width rows
        out[r["i"]] = int(r["v"])
    return out


def covariance(n: int, sums: list[int], polar: list[int], d: int) -> np.ndarray:
    """Exact integers over n ** 2, one rounding for each entry."""
    i, j = pair_index(d)
    spread = [n * p - (sums[a] + sums[b] * (a != b)) ** 2 for p, a, b in zip(polar, i.tolist(), j.tolist())]
    v = np.zeros((d, d))
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        v[a, b] = v[b, a] = spread[k] / (n * n) if a == b else (spread[k] - spread[a] - spread[b]) / (2 * n * n)
    return v


@dataclass
class Whitening:
    """``n`` fitted vectors of ``d`` dimensions with sums ``shift * n + rest``; a column of ``axes`` is a unit eigenvector of
    falling variance. ``error`` is the largest absolute entry of the whitened vectors' covariance minus the identity."""

    n: int
    d: int
    shift: list[int]
    rest: list[int]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z - np.array([r / self.n for r in self.rest])) @ self.axes / np.sqrt(self.variances)

    def deviations(self, z: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S) ** 2 = n² Σz² - 2n Σz·rest + Σrest²; None beyond 64 bits."""
        most, far = int(np.abs(z).max(initial=0)), max(map(abs, self.rest), default=0)
        z = exact(z, self.d * most * max(most, far))
        square, cross, last = (z * z).sum(1).tolist(), (z * np.array(self.rest, z.dtype)).sum(1).tolist(), sum(r * r for r in self.rest)
        n = self.n
        whole = [n * n * a - 2 * n * b + last for a, b in zip(square, cross)]
        return [v if v < 1 << 63 else None for v in whole]


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes, variances, shares) of at most ``most`` directions that have any spread beyond rounding."""
    values, vectors = np.linalg.eigh(v)
    values, vectors, trace = values[::-1], vectors[:, ::-1], np.trace(v)
    k = int((values[:most] > 1e-12 * trace).sum())
    axes = vectors[:, :k]
    sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(k)]) if k else np.ones(0)
    return axes * sign, values[:k], values[:k] / trace if k else values[:0]


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Measured on the whitened fit list, in a pass of its own: k means and k x k products."""
    k = len(w.variances)

    def run(batches):
        total = np.zeros(k + k * k)
        for b in batches:
            x = matrix(b.column(0), w.d) - np.array(w.shift, np.int64)
            for lo in range(0, len(x), CHUNK):
                out = w.whitened(x[lo:lo + CHUNK])
                total += np.concatenate([out.sum(0), (out.T @ out).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    parts = fit.where(F.col("d") == w.d).select("x").mapInArrow(run, "i int, v double")
    total = np.zeros(k + k * k)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r["i"]] = r["v"]
    mean, both = total[:k] / w.n, total[k:].reshape(k, k) / w.n
    return float(np.abs(both - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def fit_whitening(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """From the distinct vectors of column ``x`` (longs), each counted once. Vectors of another length than most have are
    left out (a tie: the longer). None without vectors."""
    fit = materialise(vectors.select("x").distinct().select("x", F.size("x").alias("d")), "whitening-fit")
    top = fit.where("d > 0").groupBy("d").count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if top is None:
        return None
    d = top["d"]
    n, *sums = summed(fit, d, d + 1, plain_sums, [0] * d)
    shift = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, shift)]
    polar = summed(fit, d, d * (d + 1) // 2, polar_sums, shift)
    w = Whitening(n, d, shift, rest, *principal(covariance(n, rest, polar, d), components))
    w.error = identity_error(fit, w)
    return w


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64,
           shift: int = 1_000_000) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Vectors that are null, or hold null or non-finite entries, are dropped, as are those of another length than most
    distinct vectors have. Copies count once in the fit; each row gets its rows, null ids too. Directions without
    spread have no whitened value and are no components, so one distinct vector or an empty table gives no rows. A
    deviation beyond 64 bits is null, entries beyond ``LARGEST`` / ``scale`` count as that. Other columns are not read.
    """
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v"))).select("id", on_grid(F.col("v"), scale, shift).alias("x"))
    w = fit_whitening(src, components)
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, deviation bigint, whitened array<double>"
    if w is None or not len(w.variances):
        scored = vectors.sparkSession.createDataFrame([], schema)
    else:
        def run(batches):
            for b in batches:
                z = matrix(b.column(1), w.d) - np.array(w.shift, np.int64)
                for lo in range(0, len(z), CHUNK):
                    out = w.whitened(z[lo:lo + CHUNK])
                    k = out.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(lo, len(out)), pa.array(w.deviations(z[lo:lo + CHUNK]), pa.int64()),
                         pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * k, pa.int32()), pa.array(out.ravel()))],
                        names=["id", "deviation", "whitened"])

        scored = src.where(F.size("x") == w.d).mapInArrow(run, schema)
    shares = F.array(*[F.lit(float(v)) for v in w.explained]) if w else F.array().cast("array<double>")
    return (scored.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.lit(w.n if w else 0).cast("bigint").alias("n"), "deviation", "whitened",
                    F.get(shares, F.col("place")).alias("explained"), F.lit(w.error if w else 0.0).alias("identity_error")))
