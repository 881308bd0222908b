"""Exact k nearest neighbours (D8): order by (distance rounded to 9 digits, training id), keep k. The
distance is the squared euclidean one (``p = 2``) or Manhattan's (``p = 1``). Ids may be of any sortable
type: others than integers are numbered in their order first, and named again in the result.

Three plans, chosen by a size check on either side:

* **broadcast queries** (queries x dimension x 8 bytes within ``MAX_BROADCAST_BYTES``): the query
  matrix is shipped once to every executor; each training partition streams its Arrow batches,
  keeps a running top-k per query and emits k candidates per query. The training side is read
  once and never shuffled; only (partitions x queries x k) candidates are, to a per-query top-k.
* **broadcast training rows** (more than ``FEW_QUERIES`` queries, training rows within the same limit): the training
  matrix is shipped once instead, and a task looks up its share of the queries in all of it, so that a query's
  k-th distance is the final one early and few boxes are looked into. No candidates are shuffled.
* **cells** (more queries than ``FEW_QUERIES`` or beyond the limit, and training rows beyond it): a tree of cuts, made from some training rows, deals
  all rows of both sides into cells of about ``train_block / 2`` training rows. A query meets its own cell first; its k-th distance there bounds
  the search, and only cells whose box of training rows is no further away are visited, with that bound. Rows travel packed, a block of a cell in a
  few byte strings; blocks bound a task's memory, and only boxes and the rows that the cuts are made from reach the driver.

In every plan queries and training rows stand in boxes of at most ``LEAF`` rows, halved at medians. A query's boxes are looked
into from the nearest on, and not beyond its k-th distance, so that few pairs are computed where the data has near rows (at worst all).

Inside a box, distances are prefiltered with the expanded form |q|^2 + |x|^2 - 2 q.x, and the
exact squared differences are computed for the candidates only. A query whose k-th candidate
ties beyond the prefilter margin is recomputed exactly against the whole box, so ties are
always broken by the smaller training id. Manhattan distances are summed one dimension at a time.
"""

from __future__ import annotations

import math
import threading

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binlens.functions.ranking import group_position
from binlens.functions.sizing import MAX_BROADCAST_BYTES
from binlens.session import cut_lineage

CAND = "qid long, tid long, label int, d2 double"
LEAF = 256               # queries or training rows in a box
SLACK = 1e-6             # of a distance, for rounding
HELD = 1 << 21           # numbers of training rows that a scan looks through at a time
QUERIES_OF_A_TASK = 16384
FEW_QUERIES = 4096       # queries up to which they are sent to the training rows
NOBODY = np.iinfo(np.int64).max       # stands for a row at a search's bound
_SENDING = threading.Lock()           # one matrix at a time is on its way through the driver


def _distances(diff: np.ndarray, p: int) -> np.ndarray:
    return np.round((np.abs(diff) if p == 1 else diff * diff).sum(-1), 9)


def _rough(Q: np.ndarray, X: np.ndarray, p: int) -> np.ndarray:
    if p == 2:
        return (Q * Q).sum(1)[:, None] + (X * X).sum(1)[None, :] - 2.0 * Q @ X.T
    out = np.zeros((len(Q), len(X)))
    for q, x in zip(Q.T, X.T):
        out += np.abs(q[:, None] - x[None, :])
    return out


def block_topk(Q: np.ndarray, X: np.ndarray, tids: np.ndarray, k: int, margin: int = 8, p: int = 2):
    """(index into X, exact rounded distance), each (len(Q), min(k, len(X))), ordered by (distance, tid)."""
    n = X.shape[0]
    kk = min(k, n)
    approx = _rough(Q, X, p)
    m = min(kk + margin, n)
    if m < n:
        cand = np.argpartition(approx, m - 1, axis=1)[:, :m]
    else:
        cand = np.tile(np.arange(n), (Q.shape[0], 1))
    diff = Q[:, None, :] - X[cand]
    d2 = _distances(diff, p)
    order = np.lexsort((tids[cand], d2), axis=1)
    rows = np.arange(Q.shape[0])[:, None]
    pick, pick_d = cand[rows, order[:, :kk]], d2[rows, order[:, :kk]]
    if m < n:
        # rows outside the candidate set may tie with the k-th distance: recompute those exactly
        kth = pick_d[:, -1]
        outside = np.partition(approx, m, axis=1)[:, m]        # nearest row left out of the candidates
        risky = np.nonzero(outside <= kth + 1e-6 * (1.0 + np.abs(kth)))[0]
        for r in risky:
            dd = _distances(X - Q[r], p)
            o = np.lexsort((tids, dd))[:kk]
            pick[r], pick_d[r] = o, dd[o]
    return pick, pick_d


def _merge(best_t, best_d, best_l, new_t, new_d, new_l, k):
    t = np.concatenate([best_t, new_t], 1)
    d = np.concatenate([best_d, new_d], 1)
    lab = np.concatenate([best_l, new_l], 1)
    o = np.lexsort((t, d), axis=1)[:, :k]
    r = np.arange(t.shape[0])[:, None]
    return t[r, o], d[r, o], lab[r, o]


def leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in groups of at most ``size``, parted at the median of the dimension of the widest range; rows equal there stay together where not all are."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            if len(at):
                out.append(at)
            continue
        part = x[at]
        j = int(np.argmax(part.max(0) - part.min(0))) if x.shape[1] else 0
        half = len(at) // 2
        order = np.argpartition(part[:, j], half) if x.shape[1] else np.arange(len(at))
        if x.shape[1]:
            v = part[order[half], j]
            below, upto = part[:, j] < v, part[:, j] <= v
            side = below if abs(int(below.sum()) - half) <= abs(int(upto.sum()) - half) else upto
            if 0 < side.sum() < len(at):
                todo += [at[side], at[~side]]
                continue
        todo += [at[order[:half]], at[order[half:]]]
    return out


def _boxes(x: np.ndarray, groups: list[np.ndarray]):
    return np.stack([x[g].min(0) for g in groups]), np.stack([x[g].max(0) for g in groups])


def _gap(lo, hi, to_lo, to_hi, p: int) -> np.ndarray:
    """Least distance between points of two boxes; 0 where it is not a number."""
    with np.errstate(invalid="ignore"):
        gap = np.maximum(np.maximum(lo - to_hi, to_lo - hi), 0.0)
        return np.nan_to_num((gap if p == 1 else gap * gap).sum(-1), nan=0.0)


class Search:
    """The nearest rows of queries so far. Queries and rows stand in boxes; a box is not looked into where it lies beyond the k-th distance."""

    def __init__(self, Q: np.ndarray, k: int, p: int, bound: np.ndarray | None = None):
        """``bound``: a distance for each query beyond which no row is looked for."""
        self.Q, self.k, self.p = Q, k, p
        self.groups = leaves(Q, LEAF)
        self.boxes = _boxes(Q, self.groups) if self.groups else None
        self.best = [(np.zeros((len(g), 0), np.int64), np.zeros((len(g), 0)), np.zeros((len(g), 0), np.int64)) for g in self.groups]
        if bound is not None:
            self.best = [(np.full((len(g), k), NOBODY), np.repeat(bound[g][:, None], k, 1), np.zeros((len(g), k), np.int64)) for g in self.groups]

    def add(self, X: np.ndarray, tids: np.ndarray, labels: np.ndarray) -> None:
        if not len(X):
            return
        boxes = leaves(X, LEAF)
        lo, hi = _boxes(X, boxes)
        for i, g in enumerate(self.groups):
            Q, (t, d, lab) = self.Q[g], self.best[i]
            least = _gap(self.boxes[0][i], self.boxes[1][i], lo, hi, self.p)
            for j in np.argsort(least, kind="stable"):
                full = d.shape[1] == self.k
                if full and least[j] > d[:, -1].max() + SLACK * (1.0 + least[j]):
                    break
                near = ~(_gap(Q, Q, lo[j], hi[j], self.p) * (1.0 - SLACK) - SLACK > d[:, -1]) if full else np.ones(len(g), bool)
                if not near.any():
                    continue
                x = boxes[j]
                idx, d2 = block_topk(Q[near], X[x], tids[x], self.k, p=self.p)
                new = _merge(t[near], d[near], lab[near], tids[x][idx], d2, labels[x][idx], self.k)
                if full:
                    t[near], d[near], lab[near] = new
                else:
                    t, d, lab = new
            self.best[i] = t, d, lab

    def kth(self) -> np.ndarray:
        """Every query's k-th distance so far, infinite without k rows."""
        out = np.full(len(self.Q), np.inf)
        for g, (_, d, _) in zip(self.groups, self.best):
            if d.shape[1] == self.k:
                out[g] = d[:, -1]
        return out

    def found(self, qids: np.ndarray) -> pd.DataFrame:
        t, d, lab = (np.concatenate([b[i].ravel() for b in self.best]) if self.best else np.zeros(0) for i in range(3))
        q = np.concatenate([np.repeat(qids[g], b[0].shape[1]) for g, b in zip(self.groups, self.best)]) if self.best else np.zeros(0)
        return pd.DataFrame({"qid": q.astype(np.int64), "tid": t.astype(np.int64), "label": lab.astype("int32"), "d2": d})


def _broadcast_scan(bq, k: int, p: int):
    """mapInPandas over training partitions: running top-k of every query, k rows per query out.
    ``bq`` is a broadcast variable holding (query ids, query matrix)."""
    def fn(it):
        qids, Q = bq.value
        if len(qids) == 0:
            return
        search, held = Search(Q, k, p), []

        def flush():
            if held:
                search.add(*(np.concatenate(x) for x in zip(*held)))
                held.clear()

        for pdf in it:
            if pdf.empty:
                continue
            held.append((np.stack(pdf["vec"].to_numpy()).astype(np.float64), pdf["tid"].to_numpy().astype(np.int64), pdf["label"].to_numpy().astype(np.int64)))
            if sum(x.size for x, _, _ in held) > HELD:
                flush()
        flush()
        yield search.found(qids)
    return fn


def _squeezed(dim: int):
    """mapInArrow over training rows (tid, vec, label): a batch's ids, labels and vectors as byte strings, the vectors compressed column by column."""
    def fn(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
                ids, labels = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (ids, labels, pa.compress(x.T.tobytes(), codec="zstd", asbytes=True))], names=["ids", "labels", "vecs"])
    return fn


def _broadcast_lookup(bt, dim: int, k: int, p: int):
    """mapInPandas over query partitions: the k nearest of all training rows for every query.
    ``bt`` is a broadcast variable holding all training rows as ``_squeezed`` gives them."""
    def fn(it):
        held = [pdf for pdf in it if len(pdf)]
        if not held or not bt.value:
            return
        tids, labels = (np.concatenate([np.frombuffer(part[i], np.int64) for part in bt.value]) for i in (0, 1))
        X, at = np.empty((len(tids), dim)), 0
        for ids, _, vecs in bt.value:
            n = len(ids) // 8
            X[at:at + n] = np.frombuffer(pa.decompress(vecs, n * dim * 8, codec="zstd", asbytes=True), np.float64).reshape(dim, n).T
            at += n
        q = pd.concat(held, ignore_index=True)
        search = Search(np.stack(q["vec"].to_numpy()).astype(np.float64), k, p)
        search.add(X, tids, labels)
        yield search.found(q["qid"].to_numpy().astype(np.int64))
    return fn


def _block_pairs(k: int, p: int):
    def fn(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"qid": [], "tid": [], "label": [], "d2": []})
        search = Search(np.stack(q["vec"].to_numpy()).astype(np.float64), k, p)
        search.add(np.stack(t["vec"].to_numpy()).astype(np.float64), t["tid"].to_numpy().astype(np.int64), t["label"].to_numpy().astype(np.int64))
        return search.found(q["qid"].to_numpy())
    return fn


class Cuts:
    """A tree of cuts at medians of the widest range of some rows; every row belongs to one of its ``cells``."""

    def __init__(self, x: np.ndarray, size: int):
        self.nodes, self.cells, todo = [None], 0, [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            part = x[at]
            j = int(np.argmax(np.ptp(part, 0))) if len(at) > size and x.shape[1] else -1
            v = np.partition(part[:, j], len(at) // 2)[len(at) // 2] if j >= 0 else np.nan
            side = None
            for upto in (part[:, j] <= v, part[:, j] < v) if j >= 0 else ():
                if 0 < upto.sum() < len(at) and (side is None or abs(2 * int(upto.sum()) - len(at)) < abs(2 * int(side.sum()) - len(at))):
                    side = upto
            if side is None:
                self.nodes[node] = self.cells
                self.cells += 1
                continue
            self.nodes[node] = (j, part[side, j].max(), len(self.nodes))
            self.nodes += [None, None]
            todo += [(len(self.nodes) - 2, at[side]), (len(self.nodes) - 1, at[~side])]

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not isinstance(self.nodes[node], tuple):
                out[at] = self.nodes[node]
                continue
            j, v, below = self.nodes[node]
            side = x[at, j] <= v
            todo += [(below, at[side]), (below + 1, at[~side])]
        return out


_BLOCK = "cell int, n long, ids binary, vecs binary, more binary"
_NAMES = ["cell", "n", "ids", "vecs", "more"]


def _block(cell: int, ids, x, more):
    return [int(cell), len(ids), *(np.ascontiguousarray(v).tobytes() for v in (ids, x, more))]


def _blocks(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.int32(), pa.int64(), *[pa.binary()] * 3))], names=_NAMES)


def _joined(table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(v.as_buffer(), kind) for v in table.column(name))])


def _dealt(df: DataFrame, cuts: Cuts, most: int, dim: int) -> DataFrame:
    """Rows (id, vec[, label]) as blocks of at most ``most`` rows of a cell."""
    def run(batches):
        held: dict[int, list] = {}

        def out(cell):
            ids, x, more = (np.concatenate(v) for v in zip(*held.pop(cell)))
            return [_block(cell, ids[lo:lo + most], x[lo:lo + most], more[lo:lo + most]) for lo in range(0, len(ids), most)]

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            more = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) if b.num_columns > 2 else np.zeros(len(ids), np.int64)
            cell = cuts.cell_of(x)
            order = np.argsort(cell, kind="stable")
            edge = np.flatnonzero(np.diff(cell[order], prepend=-1))
            for lo, hi in zip(edge, [*edge[1:], len(order)]):
                at = order[lo:hi]
                held.setdefault(int(cell[at[0]]), []).append((ids[at], x[at], more[at]))
            full = [c for c, parts in held.items() if sum(len(v[0]) for v in parts) >= most]
            if full:
                yield _blocks([row for c in full for row in out(c)])
            if sum(len(v[0]) for parts in held.values() for v in parts) * dim > HELD:
                yield _blocks([row for c in list(held) for row in out(c)])
        if held:
            yield _blocks([row for c in list(held) for row in out(c)])

    return df.where(df[df.columns[0]].isNotNull()).mapInArrow(run, _BLOCK)


def _cell_boxes(blocks: DataFrame, cells: int, dim: int):
    """(rows, lows, highs) of every cell; a row a cell reaches the driver."""
    def run(batches):
        got: dict[int, tuple] = {}
        for b in batches:
            for row in b.to_pylist():
                x = np.frombuffer(row["vecs"], np.float64).reshape(-1, dim)
                n, lo, hi = got.get(row["cell"], (0, np.full(dim, np.inf), np.full(dim, -np.inf)))
                got[row["cell"]] = n + row["n"], np.minimum(lo, x.min(0, initial=np.inf)), np.maximum(hi, x.max(0, initial=-np.inf))
        yield _blocks([[c, n, b"", np.stack([lo, hi]).tobytes(), b""] for c, (n, lo, hi) in got.items()])      # the corners add up as rows do

    spark = blocks.sparkSession
    got = blocks.mapInArrow(run, _BLOCK).repartition(spark.sparkContext.defaultParallelism, "cell").mapInArrow(run, _BLOCK).toArrow().to_pylist()
    n, lo, hi = np.zeros(cells, np.int64), np.full((cells, dim), np.inf), np.full((cells, dim), -np.inf)
    for row in got:
        n[row["cell"]], (lo[row["cell"]], hi[row["cell"]]) = row["n"], np.frombuffer(row["vecs"], np.float64).reshape(2, dim)
    return n, lo, hi


def _by_cells(t: DataFrame, q: DataFrame, nt: int, dim: int, k: int, p: int, query_block: int, train_block: int) -> DataFrame:
    """Candidates (``CAND``) of every query, among them its k nearest."""
    spark = t.sparkSession
    t, q = t.select("tid", "vec", "label").where(F.col("tid").isNotNull()), q.where(F.col("qid").isNotNull())
    some = max(1, min(nt, max(4096, 128 * math.ceil(nt / train_block)), (1 << 21) // max(1, dim)))      # rows that the cuts are made from
    shown = t.where(F.pmod(F.xxhash64("tid"), F.lit(max(1, nt // some))) == 0).select("vec").limit(2 * some).toArrow().column("vec").combine_chunks()
    x = shown.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(shown), dim)
    cuts = Cuts(x, max(16, math.ceil(len(x) * train_block / 2 / max(1, nt))))
    rows, asked = (_dealt(df, cuts, max(1, block // 4), dim).persist(StorageLevel.MEMORY_AND_DISK) for df, block in ((t, train_block), (q, query_block)))
    n, lo, hi = _cell_boxes(rows, cuts.cells, dim)
    subs = np.maximum(1, np.ceil(n / train_block)).astype(int)

    def met(visiting: DataFrame, look) -> DataFrame:
        """``look`` at each (block of a cell's queries, block of its training rows)."""
        crowds = {r["cell"]: max(1, math.ceil(r["n"] / query_block)) for r in visiting.groupBy("cell").agg(F.sum("n").alias("n")).collect()}       # a row a cell
        sizes = F.broadcast(spark.createDataFrame([(c, int(subs[c]), crowds[c]) for c in sorted(crowds) if n[c]], "cell int, subs int, crowds int"))
        mine = lambda of: F.pmod(F.xxhash64("ids"), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        keys = ["cell", "sub", "crowd"]
        left = visiting.join(sizes, "cell").withColumn("crowd", mine("crowds")).withColumn("sub", every("subs")).select(*keys, *_NAMES[1:])
        right = rows.join(sizes, "cell").withColumn("sub", mine("subs")).withColumn("crowd", every("crowds")).select(*keys, *_NAMES[1:])
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, _BLOCK + ", found binary")

    def answers(search, qids):
        got = search.found(qids)
        got = got[got["tid"] != NOBODY]
        cand = np.stack([got["qid"].to_numpy(), got["tid"].to_numpy(), got["label"].to_numpy().astype(np.int64), got["d2"].to_numpy().view(np.int64)], 1)
        return [-1, 0, b"", b"", b"", np.ascontiguousarray(cand).tobytes()]

    def table(out):
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [()] * 6, kinds)], names=[*_NAMES, "found"])

    def look(key, mine, theirs, bounded):
        qids, Q = _joined(mine, "ids", np.int64), _joined(mine, "vecs", np.float64).reshape(-1, dim)
        tids, X, labels = _joined(theirs, "ids", np.int64), _joined(theirs, "vecs", np.float64).reshape(-1, dim), _joined(theirs, "more", np.int64)
        if not len(qids) or not len(tids):
            return table([])
        search = Search(Q, k, p, _joined(mine, "more", np.float64) if bounded else None)
        search.add(X, tids, labels)
        out = [answers(search, qids)]
        if not bounded and key[1].as_py() == 0:      # one of a cell's blocks says where else to look
            bound = search.kth()
            for c in np.flatnonzero(n):
                if c == key[0].as_py():
                    continue
                at = np.flatnonzero(~(_gap(Q, Q, lo[c], hi[c], p) * (1.0 - SLACK) - SLACK > bound))
                out += [[*_block(c, qids[a], Q[a], bound[a]), b""] for a in (at[i:i + max(1, query_block // 4)] for i in range(0, len(at), max(1, query_block // 4)))]
        return table(out)

    lost = np.flatnonzero(n == 0)       # cells without training rows: their queries look everywhere
    first = cut_lineage(met(asked, lambda key, mine, theirs: look(key, mine, theirs, False)))
    visits = first.where(F.col("cell") >= 0).select(*_NAMES)
    if lost.size:
        def anywhere(batches):
            for b in batches:
                yield _blocks([[int(c), r["n"], r["ids"], r["vecs"], np.full(r["n"], np.inf).tobytes()] for r in b.to_pylist() for c in np.flatnonzero(n)])

        visits = visits.unionByName(asked.where(F.col("cell").isin(lost.tolist())).mapInArrow(anywhere, _BLOCK))
    more = cut_lineage(met(visits, lambda key, mine, theirs: look(key, mine, theirs, True)))
    for x in (rows, asked):
        x.unpersist()

    def unpacked(batches):
        for b in batches:
            got = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(v.as_buffer(), np.int64) for v in b.column(0))]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), pa.array(got[:, 2].astype(np.int32)), pa.array(got[:, 3].copy().view(np.float64))], names=["qid", "tid", "label", "d2"])

    return first.where(F.col("cell") < 0).select("found").unionByName(more.select("found")).mapInArrow(unpacked, CAND)


def nearest_neighbours(train: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec",
                       label_col: str = "label", query_block: int = 32768, train_block: int = 65536,
                       broadcast_bytes: int = MAX_BROADCAST_BYTES, p: int = 2) -> DataFrame:
    """(qid, tid, label, d2, rank) for the k nearest training rows of every query; ``d2`` is the distance
    that ``p`` names. Null ids are not rows of either side."""
    if p not in (1, 2):
        raise ValueError(f"p = {p}: only 1 and 2")
    if not _integral(train, id_col) or not _integral(queries, id_col):
        return _by_number(lambda t, q: nearest_neighbours(t, q, k, id_col, vec_col, label_col, query_block, train_block,
                                                          broadcast_bytes, p), train, queries, id_col)
    nq = queries.count()
    t = train.select(F.col(id_col).alias("tid"), F.col(vec_col).alias("vec"), F.col(label_col).cast("int").alias("label"))
    first = queries.select(F.size(vec_col).alias("d")).first()
    dim = int(first["d"]) if first else 0
    nt = train.count() if nq > FEW_QUERIES else None
    if nt is not None and nt * max(dim, 1) * 8 <= broadcast_bytes:
        with _SENDING:
            got = t.where(F.col("tid").isNotNull()).mapInArrow(_squeezed(dim), "ids binary, labels binary, vecs binary").toArrow()          # size-checked above
            bt = queries.sparkSession.sparkContext.broadcast([tuple(row.values()) for row in got.to_pylist()])
        parts = max(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(nq / QUERIES_OF_A_TASK))
        q = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("vec")).where(F.col("qid").isNotNull()).repartition(parts, "qid")
        cands = q.mapInPandas(_broadcast_lookup(bt, dim, k, p), CAND)
    elif nq <= FEW_QUERIES and nq * max(dim, 1) * 8 <= broadcast_bytes:
        rows = queries.select(id_col, vec_col).collect()          # size-checked above
        qids = np.array([r[0] for r in rows], dtype=np.int64)
        Q = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), dim)
        bq = queries.sparkSession.sparkContext.broadcast((qids, Q))
        cands = t.mapInPandas(_broadcast_scan(bq, k, p), CAND)
    else:
        cands = _by_cells(t, queries.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("vec")), train.count() if nt is None else nt, dim, k, p, query_block, train_block)
    w = Window.partitionBy("qid").orderBy("d2", "tid")
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _integral(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _by_number(search, train: DataFrame, queries: DataFrame, id_col: str) -> DataFrame:
    """Run ``search`` on ids numbered in their order (one number for an id on either side)."""
    ids = train.select(id_col).union(queries.select(id_col)).where(F.col(id_col).isNotNull()).distinct()
    numbered = group_position(ids.withColumn("_g", F.lit(0)), ["_g"], [id_col], name="_no").drop("_g")
    numbered = cut_lineage(numbered.select(F.col(id_col).alias("_id"), F.col("_no").cast("long").alias("_no")))

    def known(df):
        return df.join(numbered, F.col(id_col) == F.col("_id")).drop(id_col, "_id").withColumnRenamed("_no", id_col)

    out = search(known(train), known(queries))
    for c in ("qid", "tid"):
        out = out.join(numbered.withColumnRenamed("_no", c), c).drop(c).withColumnRenamed("_id", c)
    return out.select("qid", "tid", "label", "d2", "rank")


def approx_neighbours(train: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec",
                      label_col: str = "label", bucket_length: float = 1.0, num_tables: int = 4, seed: int = 1,
                      train_block: int = 16384, query_block: int = 2048) -> DataFrame:
    """Approximate k nearest neighbours: (qid, tid, label, d2, rank), candidates limited to rows
    sharing a random-projection bucket with the query in at least one of ``num_tables`` tables.

    Buckets come from Spark's ``BucketedRandomProjectionLSH``. Unlike a similarity join, no pair
    list is emitted: a bucket is split into ``ceil(size / train_block)`` training and
    ``ceil(queries / query_block)`` query sub-blocks (salted by id; the bucket sizes are one
    aggregate), each pair of sub-blocks is one group, and the numpy kernel returns k candidates per
    query and group. A bucket holding a third of either side is therefore spread over many tasks.
    A query without a bucket mate is answered exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if not _integral(train, id_col) or not _integral(queries, id_col):
        return _by_number(lambda t, q: approx_neighbours(t, q, k, id_col, vec_col, label_col, bucket_length, num_tables,
                                                         seed, train_block, query_block), train, queries, id_col)
    t = train.select(F.col(id_col).alias("tid"), F.col(vec_col).alias("vec"),
                     F.col(label_col).cast("int").alias("label"), array_to_vector(F.col(vec_col)).alias("v"))
    q = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("vec"), array_to_vector(F.col(vec_col)).alias("v"))
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length,
                                      numHashTables=num_tables, seed=seed).fit(t)

    def keyed(df, cols):
        return (lsh.transform(df).select(*cols, F.posexplode("h").alias("tbl", "hv"))
                .select(*cols, "tbl", vector_to_array(F.col("hv"))[0].cast("long").alias("bucket")))

    tk = keyed(t, ["tid", "vec", "label"])
    qk = keyed(q, ["qid", "vec"])
    def parts(df, block, name):
        return df.groupBy("tbl", "bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias(name))

    sizes = parts(tk, train_block, "n_sub").join(parts(qk, query_block, "n_qsub"), ["tbl", "bucket"])

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    ts = tk.join(sizes, ["tbl", "bucket"]).withColumn("sub", F.pmod(F.xxhash64("tid"), F.col("n_sub")).cast("int")) \
           .withColumn("qsub", every("n_qsub"))
    qs = qk.join(sizes, ["tbl", "bucket"]).withColumn("qsub", F.pmod(F.xxhash64("qid"), F.col("n_qsub")).cast("int")) \
           .withColumn("sub", every("n_sub"))
    keys = ["tbl", "bucket", "sub", "qsub"]
    cands = (qs.select(*keys, "qid", "vec").groupBy(*keys)
             .cogroup(ts.select(*keys, "tid", "vec", "label").groupBy(*keys))
             .applyInPandas(_block_pairs(k, 2), CAND)
             .dropDuplicates(["qid", "tid"]))
    cands = cut_lineage(cands)
    alone = queries.join(cands.select(F.col("qid").alias(id_col)).distinct(), id_col, "left_anti")
    cands = cands.unionByName(nearest_neighbours(train, alone, k, id_col, vec_col, label_col).drop("rank"))
    w = Window.partitionBy("qid").orderBy("d2", "tid")
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_predict(neigh: DataFrame) -> DataFrame:
    """Majority label among the neighbours (tie -> lowest label) and its vote share."""
    votes = neigh.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    tot = neigh.groupBy("qid").agg(F.count(F.lit(1)).alias("k"))
    best = votes.groupBy("qid").agg(F.max_by(F.struct("label", "votes"), F.struct(F.col("votes"), -F.col("label"))).alias("b"))
    return best.join(tot, "qid").select("qid", F.col("b.label").alias("prediction"),
                                        (F.col("b.votes") / F.col("k")).alias("probability"))
