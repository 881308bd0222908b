"""Matrix reductions (C19, C20, C22): truncated SVD, NMF and the Nystroem kernel map.

Only k-sized factors reach the driver (k x d for SVD / NMF, m x d landmarks for Nystroem);
the row factors stay distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binlens.functions.ranking import md5_key
from binlens.functions.sums import vector_sum
from binlens.session import cut_lineage


# ---------------------------------------------------------------- truncated SVD



def svd(df: DataFrame, k: int, id_col: str = "id", features_col: str = "features"):
    """Uncentred truncated SVD from the Gram matrix: each partition adds up its rows' X'X, the d x d sum
    is solved on the driver, and rows are projected in place. Ids may be of any type. Returns
    (projection DataFrame (id, components array = U * s), singular values, V (d x k))."""
    n = len(df.select(vector_to_array(F.col(features_col)).alias("x")).first()["x"])

    def gram(part):
        total = np.zeros((n, n))
        for pdf in part:
            if len(pdf):
                X = np.stack(pdf["x"].to_numpy())
                total += X.T @ X
        yield pd.DataFrame({"v": [total[np.triu_indices(n)]]})

    x = df.select(vector_to_array(F.col(features_col)).alias("x"))
    upper = vector_sum(x.mapInPandas(gram, "v array<double>"), n * (n + 1) // 2)
    G = np.zeros((n, n))
    G[np.triu_indices(n)] = upper
    G = G + G.T - np.diag(np.diag(G))
    values, vectors = np.linalg.eigh(G)
    order = np.argsort(-values, kind="stable")[:k]
    s = np.sqrt(np.maximum(values[order], 0.0))
    V = vectors[:, order]
    # a fixed sign for each component: its largest entry is positive
    V = V * np.where(V[np.abs(V).argmax(0), np.arange(V.shape[1])] < 0, -1.0, 1.0)
    return svd_project(df, V, id_col, features_col), s, V


def svd_project(df: DataFrame, V: np.ndarray, id_col: str = "id", features_col: str = "features",
                keep: tuple = (), output_col: str = "components") -> DataFrame:
    """Rows x V for new data (same as U * s on the fitted rows); ``keep`` columns ride along."""
    Vb = V.copy()
    cols = [id_col, *keep]

    def proj(it):
        for pdf in it:
            X = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, Vb.shape[0]))
            out = pdf[cols].copy()
            out[output_col] = list(X @ Vb)
            yield out

    schema = df.select(*cols).schema.add(output_col, T.ArrayType(T.DoubleType()))
    return df.select(*cols, vector_to_array(F.col(features_col)).alias("x")).mapInPandas(proj, schema)


# ---------------------------------------------------------------- NMF (C20)

def _nndsvd(df, k, id_col, features_col):
    """NNDSVD start: W from the positive / negative parts of U, H from those of V."""
    proj, s, V = svd(df, k, id_col, features_col)
    U = proj.select(id_col, F.transform("components", lambda c, j: c / F.element_at(F.array(*[F.lit(float(v) if v > 0 else 1.0) for v in s]), j + 1)).alias("u"))
    norms = U.select(*[F.sqrt(F.sum(F.pow(F.greatest(F.col("u")[j], F.lit(0.0)), 2))).alias(f"p{j}") for j in range(k)],
                     *[F.sqrt(F.sum(F.pow(F.least(F.col("u")[j], F.lit(0.0)), 2))).alias(f"n{j}") for j in range(k)]).first()
    H = np.zeros((k, V.shape[0]))
    pick, scale = [], []
    for j in range(k):
        v = V[:, j]
        if j == 0:
            H[0] = np.sqrt(s[0]) * np.abs(v)
            pick.append("abs"); scale.append(np.sqrt(s[0]))
            continue
        vp, vn = np.maximum(v, 0), np.maximum(-v, 0)
        up, un = norms[f"p{j}"] or 0.0, norms[f"n{j}"] or 0.0
        mp, mn = up * np.linalg.norm(vp), un * np.linalg.norm(vn)
        if mp >= mn and mp > 0:
            sig = mp
            H[j] = np.sqrt(s[j] * sig) * vp / np.linalg.norm(vp)
            pick.append("pos"); scale.append(np.sqrt(s[j] * sig) / up)
        elif mn > 0:
            sig = mn
            H[j] = np.sqrt(s[j] * sig) * vn / np.linalg.norm(vn)
            pick.append("neg"); scale.append(np.sqrt(s[j] * sig) / un)
        else:
            pick.append("zero"); scale.append(0.0)
    cols = []
    for j in range(k):
        c = F.col("u")[j]
        part = {"abs": F.abs(c), "pos": F.greatest(c, F.lit(0.0)), "neg": F.greatest(-c, F.lit(0.0)), "zero": F.lit(0.0)}[pick[j]]
        cols.append(part * F.lit(float(scale[j])))
    W = U.select(id_col, F.array(*cols).alias("w"))
    return W, H


#: Entries (rows x features) up to which the steps of a factorization are one task's.
IN_PLACE = 2_000_000


def _nmf_in_place(data: DataFrame, H: np.ndarray, id_col: str, max_iter: int, tol: float, eps: float):
    """All steps of ``nmf`` in one pass over a small table: (W, H, steps)."""
    def run(part):
        pdf = pd.concat(list(part)).sort_values(id_col)
        X, W, h, last, first = np.stack(pdf["x"].to_numpy()), np.stack(pdf["w"].to_numpy()), H, None, None
        square, it = (X**2).sum(), 0
        for it in range(1, max_iter + 1):
            W = W * (X @ h.T) / np.maximum(W @ (h @ h.T), eps)
            WtX, WtW = W.T @ X, W.T @ W
            h = h * WtX / np.maximum(WtW @ h, eps)
            if it % 10 == 0:
                err = float(np.sqrt(max(square - 2 * np.sum(h * WtX) + np.sum(h * (WtW @ h)), 0.0)))
                if first is None:
                    first = err
                elif first > 0 and (last - err) / first < tol:
                    break
                last = err
        yield pd.DataFrame({id_col: pdf[id_col].astype("Int64"), "w": list(W), "steps": pd.array([None] * len(W), "Int64")})
        yield pd.DataFrame({id_col: pd.array([None], "Int64"), "w": [h.ravel()], "steps": pd.array([it], "Int64")})

    out = cut_lineage(data.repartition(1).mapInPandas(run, f"{id_col} long, w array<double>, steps long"))
    found = out.filter(F.col("steps").isNotNull()).first()
    return out.filter(F.col("steps").isNull()).select(id_col, "w"), np.array(found["w"]).reshape(H.shape), found["steps"]


def nmf(df: DataFrame, k: int, id_col: str = "id", features_col: str = "features", max_iter: int = 500,
        tol: float = 1e-4, checkpoint_every: int = 10, eps: float = 1e-10, in_place: int = IN_PLACE):
    """X ~ W H with W, H >= 0 by multiplicative updates (Frobenius loss), NNDSVD start.

    Per step one distributed pass: each partition updates its W rows with the current H and
    yields one partial WtX (k x d) and WtW (k x k), which are added in a shuffle; H is then updated on the driver. Every 10
    steps the relative drop of the reconstruction error is tested against ``tol``. Tables of at most ``in_place`` entries take
    the same steps in one task.
    Returns (W DataFrame (id, w array), H ndarray, n_iter).
    """
    spark = df.sparkSession
    X = df.select(id_col, vector_to_array(F.col(features_col)).alias("x"))
    W0, H = _nndsvd(df, k, id_col, features_col)
    data = X.join(W0, id_col)
    data = cut_lineage(data)
    if 0 < data.count() * H.shape[1] <= in_place:
        return _nmf_in_place(data, H, id_col, max_iter, tol, eps)
    xx = data.select(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("s")).agg(F.sum("s")).first()[0] or 0.0
    err0 = prev = None
    held = None
    it = 0
    for it in range(1, max_iter + 1):
        Hb = H.copy()

        def step(part, Hb=Hb):
            HHt = Hb @ Hb.T
            total = np.zeros(k * Hb.shape[1] + k * k)
            for pdf in part:
                if pdf.empty:
                    continue
                Xp = np.stack(pdf["x"].to_numpy())
                Wp = np.stack(pdf["w"].to_numpy())
                Wp = Wp * (Xp @ Hb.T) / np.maximum(Wp @ HHt, eps)
                total += np.concatenate([(Wp.T @ Xp).ravel(), (Wp.T @ Wp).ravel()])
                yield pd.DataFrame({id_col: pdf[id_col], "x": pdf["x"], "w": list(Wp), "s": [None] * len(pdf)})
            yield pd.DataFrame({id_col: [None], "x": [None], "w": [None], "s": [total]})

        # One job per step: the stats collect materialises the persisted output, whose W rows
        # feed the next step; the previous step's output is released once this one is cached.
        out = data.mapInPandas(step, f"{id_col} long, x array<double>, w array<double>, s array<double>")
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
        d = H.shape[1]
        sums = vector_sum(out.filter(F.col("s").isNotNull()), k * d + k * k, "s")
        if held is not None:
            held.unpersist()
        held = out
        WtX = sums[: k * d].reshape(k, d)
        WtW = sums[k * d:].reshape(k, k)
        H = H * WtX / np.maximum(WtW @ H, eps)
        data = out.filter(F.col("s").isNull()).select(id_col, "x", "w")
        if it % checkpoint_every == 0:
            data = cut_lineage(data)
            held.unpersist()
            held = None
        if it % 10 == 0:
            # ||X - WH||^2 = ||X||^2 - 2 tr(H^T W^T X) + tr(H^T W^T W H) with the W of this step
            err = float(np.sqrt(max(xx - 2 * np.sum(H * WtX) + np.sum(H * (WtW @ H)), 0.0)))
            if err0 is None:
                err0 = err
            elif prev is not None and err0 > 0 and (prev - err) / err0 < tol:
                break
            prev = err
    W = cut_lineage(data.select(id_col, "w"))
    if held is not None:
        held.unpersist()
    return W, H, it


def nmf_transform(df: DataFrame, H: np.ndarray, id_col: str = "id", features_col: str = "features", keep: tuple = (),
                  output_col: str = "w", n_iter: int = 200, eps: float = 1e-10) -> DataFrame:
    """W for new rows with H fixed: multiplicative updates from the constant start
    sqrt(mean(X) / k). Each row is solved on its own, so this is a map with no shuffle; the
    mean is one aggregate."""
    k = H.shape[0]
    x = vector_to_array(F.col(features_col))
    stats = df.select(F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("s"), F.size(x).alias("d")) \
              .agg(F.sum("s"), F.sum("d")).first()
    mean = float(stats[0] or 0.0) / max(float(stats[1] or 1), 1.0)
    start = float(np.sqrt(max(mean, 0.0) / k))
    Hb = H.copy()
    cols = [id_col, *keep]

    def solve(it):
        HHt = Hb @ Hb.T
        for pdf in it:
            X = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, Hb.shape[1]))
            W = np.full((X.shape[0], k), start)
            XHt = X @ Hb.T
            for _ in range(n_iter):
                W = W * XHt / np.maximum(W @ HHt, eps)
            out = pdf[cols].copy()
            out[output_col] = list(W)
            yield out

    schema = df.select(*cols).schema.add(output_col, T.ArrayType(T.DoubleType()))
    return df.select(*cols, x.alias("x")).mapInPandas(solve, schema)


class NmfModel:
    """The fixed factor H; ``transform`` adds ``output_col`` with the rows' own factor."""

    def __init__(self, H: np.ndarray, features_col: str = "features", output_col: str = "w"):
        self.H, self.features_col, self.output_col = np.asarray(H, float), features_col, output_col

    def transform(self, df: DataFrame, id_col: str = "id", keep: tuple = ()) -> DataFrame:
        return nmf_transform(df, self.H, id_col, self.features_col, keep, self.output_col)


# ---------------------------------------------------------------- Nystroem map

def _kernel(kind, A, B, gamma, degree, coef0):
    if kind == "rbf":
        d2 = (A * A).sum(1)[:, None] + (B * B).sum(1)[None, :] - 2 * A @ B.T
        return np.exp(-gamma * np.maximum(d2, 0))
    if kind == "linear":
        return A @ B.T
    if kind == "poly":
        return (gamma * (A @ B.T) + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * (A @ B.T) + coef0)
    raise ValueError(kind)


class NystroemModel:
    def __init__(self, landmarks, normalization, kernel, gamma, degree, coef0, features_col, output_col):
        self.landmarks, self.normalization = landmarks, normalization
        self.kernel, self.gamma, self.degree, self.coef0 = kernel, gamma, degree, coef0
        self.features_col, self.output_col = features_col, output_col

    def transform(self, df: DataFrame) -> DataFrame:
        L, M = self.landmarks, self.normalization
        kind, g, deg, c0 = self.kernel, self.gamma, self.degree, self.coef0

        @F.pandas_udf("array<double>")
        def embed(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype=object)
            X = np.stack(x.to_numpy())
            return pd.Series(list(_kernel(kind, X, L, g, deg, c0) @ M.T))

        return df.withColumn(self.output_col, array_to_vector(embed(vector_to_array(F.col(self.features_col)))))


def fit_nystroem(df: DataFrame, id_col: str = "id", features_col: str = "features", output_col: str = "kernel_features",
                 n_components: int = 250, kernel: str = "rbf", gamma: float = 0.2, degree: float = 3, coef0: float = 1.0):
    """Landmarks = the first ``n_components`` rows in md5(id) order (a fixed-size sample, so
    the collect is bounded); normalisation = K_mm^(-1/2) from an m x m SVD on the driver."""
    rows = (df.select(id_col, vector_to_array(F.col(features_col)).alias("x"))
            .orderBy(md5_key(id_col)).limit(n_components).collect())
    L = np.stack([np.asarray(r["x"], dtype=float) for r in rows])
    K = _kernel(kernel, L, L, gamma, degree, coef0)
    U, S, Vt = np.linalg.svd(K)
    S = np.maximum(S, 1e-12)
    M = (U / np.sqrt(S)) @ Vt
    return NystroemModel(L, M, kernel, gamma, degree, coef0, features_col, output_col)
