"""Exact k nearest neighbours by pivots (D8): a query meets only the cells that can hold one of its neighbours.

Every training row belongs to the cell of its nearest pivot; a cell keeps its size and the smallest and largest distance of its rows
to the pivot. A query is first answered in its own cell. Its k-th distance there (or, in a cell of fewer rows, the distance
within which the cells' counts and radii promise k rows) bounds the search: by the triangle inequality a cell can hold a neighbour
only if ``d(q, p) - largest <= bound`` and ``smallest - d(q, p) <= bound``, and for euclidean distances also only if the query is no
further than the bound from the plane between both pivots. The second join visits those cells. Ties at the bound are kept.

Training rows are dealt by cell and never copied to cells they are not in; a cell beyond ``block`` rows is cut into sub-blocks, and
one with more than ``query_block`` visiting queries is read once for each so many of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binlens.functions.ranking import md5_key
from binlens.operators.knn import CAND, _block_pairs, _by_number, _integral
from binlens.session import cut_lineage

SLACK = 1e-6


def _to_pivots(x: np.ndarray, pivots: np.ndarray, p: int) -> np.ndarray:
    if p == 1:
        return np.stack([np.abs(x - c).sum(1) for c in pivots], 1)
    return np.sqrt(np.stack([((x - c) ** 2).sum(1) for c in pivots], 1))


def _located(df: DataFrame, pivots: np.ndarray, p: int, cols: list[str]) -> DataFrame:
    """``cols`` with ``cell`` and ``far``, the distance to its pivot; ``vec`` is a column of theirs."""
    def run(it):
        for pdf in it:
            d = _to_pivots(np.stack(pdf["vec"].to_numpy()).astype(float), pivots, p) if len(pdf) else np.zeros((0, len(pivots)))
            yield pdf.assign(cell=d.argmin(1).astype("int32") if len(pdf) else [], far=d.min(1) if len(pdf) else [])

    schema = df.select(*cols).schema.add("cell", "integer").add("far", "double")
    return df.select(*cols).mapInPandas(run, schema)


def visits(dist: np.ndarray, bound: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, between: np.ndarray, p: int) -> np.ndarray:
    """(queries, cells) True where a cell other than the query's own can hold a row within ``bound``."""
    room = bound[:, None] + SLACK * (1 + bound[:, None])
    can = (dist - high[None, :] <= room) & (low[None, :] - dist <= room)
    if p == 2:      # distance to the plane between the own pivot and the other
        gap = between[own]
        plane = (dist**2 - np.take_along_axis(dist, own[:, None], 1) ** 2) / np.maximum(2 * gap, 1e-300)
        can &= (plane <= room) | (gap <= 0)
    can[np.arange(len(own)), own] = False
    return can


def promised(dist: np.ndarray, high: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """A distance within which at least k rows lie (infinite without so many rows)."""
    reach = dist + high[None, :]
    order = np.argsort(reach, 1)
    enough = np.cumsum(size[order], 1) >= k
    at = enough.argmax(1)
    out = np.take_along_axis(reach, order[np.arange(len(order)), at][:, None], 1)[:, 0]
    return np.where(enough.any(1), out, np.inf)


def pivot_neighbours(train: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", label_col: str = "label", pivots: int = 64,
                     p: int = 2, block: int = 16384, query_block: int = 2048) -> DataFrame:
    """(qid, tid, label, d2, rank) as ``knn.nearest_neighbours`` gives them. ``pivots`` rows of the training side, the first by a hash of the id,
    are the only rows that reach the driver; null ids are rows of neither side."""
    if p not in (1, 2):
        raise ValueError(f"p = {p}: only 1 and 2")
    if not _integral(train, id_col) or not _integral(queries, id_col):
        return _by_number(lambda t, q: pivot_neighbours(t, q, k, id_col, vec_col, label_col, pivots, p, block, query_block), train, queries, id_col)
    t = train.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("tid"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("int").alias("label"))
    q = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("vec"))
    chosen = t.orderBy(md5_key("tid"), "tid").limit(pivots).select("vec").collect()
    w = Window.partitionBy("qid").orderBy("d2", "tid")
    if not chosen:
        return train.sparkSession.createDataFrame([], CAND + ", rank int")
    centre = np.unique(np.array([r[0] for r in chosen], float), axis=0)
    t = cut_lineage(_located(t, centre, p, ["tid", "vec", "label"]))
    stats = {r["cell"]: r for r in t.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}     # a row a pivot
    at = range(len(centre))
    size = np.array([stats[c]["n"] if c in stats else 0 for c in at])
    low, high = (np.array([stats[c][s] if c in stats else e for c in at]) for s, e in (("low", np.inf), ("high", -np.inf)))
    between = _to_pivots(centre, centre, p)
    q = _located(q, centre, p, ["qid", "vec"])
    parts = np.maximum(1, np.ceil(size / block)).astype(int).tolist()
    spark = train.sparkSession
    cells = F.broadcast(spark.createDataFrame(list(zip(at, parts)), "cell int, subs int"))      # a row a pivot
    salted = t.join(cells, "cell").withColumn("sub", F.pmod(F.xxhash64("tid"), F.col("subs")).cast("int")).select("tid", "vec", "label", "cell", "sub")

    def answered(visiting: DataFrame) -> DataFrame:
        """k candidates of each (query, cell, sub-block) of ``visiting`` (qid, vec, cell)."""
        crowd = visiting.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(query_block))).cast("int").alias("crowds"))
        crowd = F.broadcast(crowd)       # a row a pivot
        v = (visiting.join(cells, "cell").join(crowd, "cell").withColumn("crowd", F.pmod(F.xxhash64("qid"), F.col("crowds")).cast("int"))
             .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select("qid", "vec", "cell", "sub", "crowd"))
        rows = salted.join(crowd, "cell").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).select("tid", "vec", "label", "cell", "sub", "crowd")
        keys = ["cell", "sub", "crowd"]
        return v.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_block_pairs(k, p), CAND)

    first = cut_lineage(answered(q.select("qid", "vec", "cell")))
    # the k-th distance in the own cell, where it has k rows
    own = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("qid", F.col("d2").alias("kth"))

    def spread(it):
        for pdf in it:
            if not len(pdf):
                continue
            dist = _to_pivots(np.stack(pdf["vec"].to_numpy()).astype(float), centre, p)
            kth = pdf["kth"].to_numpy(dtype=float)
            bound = np.fmin(np.sqrt(kth) if p == 2 else kth, promised(dist, high, size, k))
            r, c = np.nonzero(visits(dist, bound, pdf["cell"].to_numpy(), low, high, between, p))
            yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[r], "vec": pdf["vec"].to_numpy()[r], "cell": c.astype("int32")})

    more = cut_lineage(q.join(own, "qid", "left").select("qid", "vec", "cell", "kth").mapInPandas(spread, "qid long, vec array<double>, cell int"))
    found = first.unionByName(answered(more))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
