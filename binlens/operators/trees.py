"""Binary trees on binned features, grown level by level, many trees in each pass.

A pass over the rows serves one level of *all* trees of a batch: every task sums two whole numbers for each
(node, feature, bin), the sums meet in one shuffle dealt by node, and each node's best cut comes back as one row. The trees
(not the rows) are the state on the driver, as in Spark's own forests; a batch holds as many trees as
``NODE_BUDGET`` nodes allow at the depth asked for.

Two criteria share the passes:

* class impurity (``gini``, ``entropy``): the sums are the rows' weights and the weights of class 1;
* second-order boosting (``newton``): the sums are hessians and gradients in fixed point.

All sums are integers, so results do not depend on the order of rows, tasks or retries. Rows carry their own random
numbers as hashes of their id: bootstrap weights (Poisson) and per-node feature draws are the same in every pass.

A node's cut depends on the rows in it, the features drawn for it and the smallest leaf allowed, not on the depth limit, the smallest
node that may be split, or the number of trees. So one growth serves every candidate of a search that differs only in
those: ``candidate_counts`` cuts the grown trees back for each.
"""

from __future__ import annotations

import heapq
import math
import threading
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binlens.functions.hashing import mixed, uniform
from binlens.functions.sizing import MAX_BROADCAST_BYTES
from binlens.operators.boosting import stump_thresholds
from binlens.session import cut_lineage

#: Nodes of one batch of trees (about 40 bytes each, on the driver and in every Python worker).
NODE_BUDGET = 8_000_000
#: Rows up to which a table within the limit of a broadcast is a boosted model's task's.
IN_PLACE = 2_000_000
#: Rows times trees of a task; a table below it is one task's.
DEALT = 20_000
#: Rows below a node up to which one task grows the rest of a boosted tree.
FINISH = 100_000
#: Rows times trees that a task grows at a time from a whole table.
ROOM = 1_000_000
#: Rows times trees handled at a time, and histogram cells held before they are sent.
PAIRS = 1 << 18
CELLS = 1 << 20
#: Steps of a unit in gradients and hessians.
UNIT = float(1 << 28)
#: Chances of 0, 1, 2, ... draws of a row in a bootstrap sample of the same size.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass
class Binned:
    """(rid, label, fold, bins) rows; ``bins`` has one byte per feature: the number of thresholds below the value."""

    rows: DataFrame
    thresholds: list[list[float]]
    n: int
    tasks: int

    @property
    def offsets(self) -> np.ndarray:
        """Where each feature's bins begin when all features' bins are numbered through (and the end)."""
        return np.cumsum([0, *(len(t) + 1 for t in self.thresholds)])

    def release(self) -> None:
        self.rows.unpersist()


def bin_rows(df: DataFrame, features_col: str = "features", label_col: str = "label", id_col: str = "id", fold_col: str | None = None,
             keep: tuple[str, ...] = (), max_bins: int = 256, thresholds: list[list[float]] | None = None, trees: int = 1, send: bool = False) -> Binned:
    """Quantile bins (at most 256 a feature) of a labelled frame, persisted. ``trees`` sizes the work of a pass: small tables
    are dealt over more tasks when many trees read them (not if a table within the limit is to ``send``); tables that already have enough partitions stay as they are."""
    if max_bins > 256:
        raise ValueError("at most 256 bins fit a byte")
    if thresholds is None:
        thresholds = stump_thresholds(df, features_col, max_bins)
    cuts = [np.asarray(t, float) for t in thresholds]
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(-1)
    src = df.select(F.xxhash64(F.col(id_col).cast("string")).alias("rid"), F.col(label_col).cast("int").alias("label"), fold.alias("fold"), *keep,
                    vector_to_array(F.col(features_col)).alias("x"))

    def run(batches):
        for b in batches:
            flat = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(-1, len(cuts)) if len(cuts) else np.zeros((b.num_rows, 0))
            bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(cuts)), len(bins), [None, pa.py_buffer(np.ascontiguousarray(bins).tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed.cast(pa.binary())], names=[*b.schema.names[:-1], "bins"])

    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep)
    rows = src.mapInArrow(run, f"rid long, label int, fold int{kept}, bins binary")
    n = df.count()
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if send and sendable(n, len(cuts)):
        trees = 1
    per = min(DEALT, IN_PLACE)
    want = max(1, min(width, math.ceil(n * trees / per)))
    have = rows.rdd.getNumPartitions()
    if want > have:
        rows, have = rows.repartition(want, "rid"), want
    elif n * trees <= per and have > 1:
        rows, have = rows.coalesce(1), 1
    return Binned(rows.persist(StorageLevel.MEMORY_AND_DISK), thresholds, n, have)


@dataclass
class Specs:
    """One entry per tree. Rows of ``fold`` are left out (-1: none are). ``sample`` numbers a tree's bootstrap weights (-1: every
    row once). ``per_node`` features are drawn at each node from those that ``per_tree`` allows (0: all)."""

    fold: np.ndarray
    sample: np.ndarray
    key: np.ndarray
    per_node: np.ndarray
    per_tree: np.ndarray
    depth: np.ndarray
    min_split: np.ndarray
    min_leaf: np.ndarray
    entropy: np.ndarray
    lam: np.ndarray
    gamma: np.ndarray

    @staticmethod
    def of(trees: int, **given) -> Specs:
        base = dict(fold=-1, sample=-1, key=0, per_node=0, per_tree=0, depth=5, min_split=2, min_leaf=1.0, entropy=False, lam=0.0, gamma=0.0)
        kind = dict(key=np.uint64, min_leaf=float, entropy=bool, lam=float, gamma=float)
        return Specs(**{k: np.broadcast_to(np.asarray(given.get(k, v), kind.get(k, np.int64)), (trees,)).copy() for k, v in base.items()})

    def some(self, at) -> Specs:
        return Specs(**{k: v[at] for k, v in self.__dict__.items()})

    def __len__(self) -> int:
        return len(self.fold)


@dataclass
class Forest:
    """Nodes of all trees, level by level; ``feature`` -1 is a leaf, the right child follows the left one. ``a`` and ``b`` are the
    node's two sums (weight and class 1 weight, or hessian and gradient)."""

    trees: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tree: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    depth: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def grown(self, **more) -> Forest:
        return replace(self, **{k: np.concatenate([getattr(self, k), np.asarray(v, getattr(self, k).dtype)]) for k, v in more.items()})

    def levels(self) -> int:
        return int(self.depth.max(initial=0))


def descend(feature, cut, left, bins: np.ndarray, start: np.ndarray, levels: int) -> np.ndarray:
    """(rows, trees) nodes that the rows reach from ``start`` after at most ``levels`` steps."""
    node = start.copy()
    row = np.arange(len(bins))[:, None]
    for _ in range(levels):
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            break
        node = np.where(inner, left[node] + (bins[row, f] > cut[node]), node)
    return node


def bootstrap(rid: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """(rows, trees) Poisson weights; sample -1: 1."""
    kinds, at = np.unique(sample, return_inverse=True)
    with np.errstate(over="ignore"):
        keys = rid.astype(np.uint64)[:, None] ^ mixed(kinds.astype(np.uint64) + np.uint64(77))[None, :]
    w = np.searchsorted(_POISSON, uniform(keys), side="right").astype(np.int64)
    w[:, kinds < 0] = 1
    return w[:, at]


def drawn_features(keys: np.ndarray, tree_keys: np.ndarray, per_node: np.ndarray, per_tree: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, features): the features that each node looks at, those of the smallest hashes."""
    f = np.arange(d, dtype=np.uint64)[None, :]
    allowed = np.where(per_tree > 0, np.minimum(per_tree, d), d)
    count = np.where(per_node > 0, np.minimum(per_node, allowed), allowed)
    of_tree = mixed(mixed(tree_keys + np.uint64(13))[:, None] ^ f)
    place = np.argsort(np.argsort(of_tree, 1, kind="stable"), 1, kind="stable")
    of_node = mixed(mixed(keys)[:, None] ^ (f + np.uint64(1 << 32)))
    order = np.argsort(np.where(place < allowed[:, None], of_node >> np.uint64(1), np.uint64(2**64 - 1)), 1, kind="stable")
    chosen = np.arange(d)[None, :] < count[:, None]
    offsets = np.concatenate([[0], np.cumsum(count)])
    return offsets, order[chosen].astype(np.int32)


def merged(keys: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Sums of equal keys, in key order."""
    if not len(keys):
        return keys, a, b
    if (keys[1:] > keys[:-1]).all():
        return keys, a, b
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(a[order], first), np.add.reduceat(b[order], first)


class _Held:
    """Histogram cells gathered until there are many; then summed once more."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys, a, b):
        self.parts.append((keys, a, b))
        self.size += len(keys)
        if self.size > 4 * CELLS:
            self.parts = [self.sum()]
            self.size = max(len(self.parts[0][0]), 1)

    def sum(self):
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return merged(*(np.concatenate(x) for x in zip(*self.parts)))


def _impurity(a, b, entropy):
    """Weight times impurity of nodes of weight ``a`` with ``b`` of class 1."""
    p = b / np.maximum(a, 1e-300)
    if not np.any(entropy):
        return a * (2 * p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        e = -(np.where(p > 0, p * np.log2(np.maximum(p, 1e-300)), 0) + np.where(p < 1, (1 - p) * np.log2(np.maximum(1 - p, 1e-300)), 0))
    return a * np.where(entropy, e, 2 * p * (1 - p))


def best_cuts(keys: np.ndarray, a: np.ndarray, b: np.ndarray, offsets: np.ndarray, newton: bool, min_leaf, entropy, lam, gamma):
    """Best cut of every node that occurs in the (node, feature, bin) ``keys``, as columns
    (node, feature, bin, gain, a, b, left a, left b); feature -1 where no cut is allowed. Ties: lowest feature, lowest bin."""
    if not len(keys):
        return tuple(np.zeros(0, float if i == 3 else np.int64) for i in range(8))
    width = int(offsets[-1])
    q, cell = keys // width, keys % width
    f = np.searchsorted(offsets, cell, side="right") - 1
    fresh = np.concatenate(([True], (q[1:] != q[:-1]) | (f[1:] != f[:-1])))
    first = np.flatnonzero(fresh)
    segment = np.cumsum(fresh) - 1
    ca, cb = np.cumsum(a), np.cumsum(b)
    before = lambda c, x: (c - x)[first][segment]
    la, lb = ca - before(ca, a), cb - before(cb, b)
    last = np.append(first[1:], len(q)) - 1
    ta, tb = la[last][segment], lb[last][segment]
    ra, rb = ta - la, tb - lb
    if newton:
        score = lambda h, g: (g / UNIT) ** 2 / np.maximum(h / UNIT + lam[q], 1e-300)
        gain = score(la, lb) + score(ra, rb) - score(ta, tb)
        least = min_leaf[q] * UNIT
        ok = (la >= least) & (ra >= least) & (gain > np.maximum(gamma[q], 1e-9))
    else:
        ent = entropy[q]
        gain = _impurity(ta, tb, ent) - _impurity(la, lb, ent) - _impurity(ra, rb, ent)
        ok = (la >= min_leaf[q]) & (ra >= min_leaf[q]) & (tb > 0) & (tb < ta)
        gain = np.round(gain, 9)
    ok &= (ra > 0) & (la > 0)
    node = np.concatenate(([True], q[1:] != q[:-1]))
    at, owner = np.flatnonzero(node), np.cumsum(node) - 1
    scored = np.where(ok, gain, -np.inf)
    top = np.maximum.reduceat(scored, at)
    hit = np.flatnonzero(scored == top[owner])
    pick = hit[np.unique(owner[hit], return_index=True)[1]]     # first in key order
    found = np.isfinite(top)
    return (q[at], np.where(found, f[pick], -1), (cell - offsets[f])[pick], np.where(found, top, 0.0), ta[at], tb[at], la[pick], lb[pick])


_CUTS = "node long, feature long, bin long, gain double, a long, b long, la long, lb long"
_CUT_NAMES = [c.split()[0] for c in _CUTS.split(", ")]


def histograms(q, r, wa, wb, bins, sub_at, sub, offsets):
    """(keys, a, b) of the (node, feature, bin) cells of pairs (node q, row r) with sums wa, wb, in chunks, each summed. Nodes' cells are counted
    in one array over the chunk's nodes where it is not much larger than the chunk, else sorted."""
    count, width = np.diff(sub_at), int(offsets[-1])
    bins_of = np.diff(offsets)
    for m in np.unique(count[q]).tolist():
        mine = np.flatnonzero(count[q] == m)
        if m == 0:
            continue
        most = max(1, 4 * PAIRS // m)
        if len(mine) > most:
            mine = mine[np.argsort(q[mine], kind="stable")]     # a chunk has few nodes
        for s in range(0, len(mine), most):
            i = mine[s:s + most]
            nodes, at = np.unique(q[i], return_inverse=True) if len(i) < len(count) else (np.arange(len(count)), q[i])
            nodes = nodes if len(i) < len(count) else np.where(count == m, nodes, -1)
            used = nodes >= 0
            f = np.zeros((len(nodes), m), np.int64)
            f[used] = np.sort(sub[sub_at[nodes[used]][:, None] + np.arange(m)], 1)
            size = np.where(used[:, None], bins_of[f], 0)
            start = np.cumsum(size.ravel()) - size.ravel()
            cells = int(start[-1] + size[-1, -1])
            if cells <= max(4 * m * len(i), CELLS):
                k, flat = np.empty((m, len(i)), np.int64), bins.reshape(-1)
                one = f[used][0] if (f[used] == f[used][0]).all() else None
                row, at = r[i].astype(np.int64) * bins.shape[1], at * m
                for j in range(m):
                    np.take(start, at + j, out=k[j])
                    k[j] += flat.take(row + (f.ravel().take(at + j) if one is None else one[j]))
                a, b = (np.bincount(k.ravel(), np.tile(w[i].astype(float), m), cells) for w in (wa, wb))      # whole numbers below 2^53
                hit = np.flatnonzero((a != 0) | (b != 0))
                part = np.repeat(np.arange(size.size), size.ravel())[hit]
                first = (np.maximum(nodes, 0)[:, None] * width + offsets[f]).ravel()
                yield first[part] + hit - start[part], a[hit].astype(np.int64), b[hit].astype(np.int64)
            else:
                at = f[at]
                cell = q[i].astype(np.int64)[:, None] * width + offsets[at] + bins[r[i][:, None], at]
                yield merged(cell.ravel(), np.repeat(wa[i], m), np.repeat(wb[i], m))


#: Features up to which groups of exclusive ones are looked for, and codes of such a group.
MOST_FEATURES, MOST_CODES = 256, 4096


def exclusive(bins: np.ndarray, sizes: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """(groups, common): each feature's most common bin, and groups of features of which no row has two outside of it, as counted over all rows."""
    n, d = bins.shape
    common = np.array([np.bincount(bins[:, f], minlength=1).argmax() for f in range(d)], np.int64)
    if d > MOST_FEATURES or not n:
        return [[f] for f in range(d)], common
    meet = np.zeros((d, d))
    for lo in range(0, n, PAIRS):
        rest = (bins[lo:lo + PAIRS] != common).astype(np.float32)      # whole numbers below 2^24
        meet += rest.T @ rest
    groups, open_ = [], []
    for f in range(d):
        group = None if 2 * meet[f, f] > n else next((g for g in open_ if not meet[f, g].any() and sizes[g].sum() + sizes[f] < MOST_CODES), None)
        if group is None:
            groups.append([f])
            if 2 * meet[f, f] <= n:
                open_.append(groups[-1])
        else:
            group.append(f)
    return groups, common


class Columns:
    """A table's bins as columns of codes: one for each feature, or for a group of exclusive ones (as the slots of a category are), whose code is the bin of
    the one that is not at its most common bin, or 0. Such a bin's sums are what the feature's others leave of the node's."""

    def __init__(self, bins: np.ndarray, offsets: np.ndarray):
        self.offsets, self.columns = offsets, []
        sizes = np.diff(offsets)
        groups, common = exclusive(bins, sizes)
        for group in groups:
            if len(group) == 1:
                f = group[0]
                self.columns.append((np.ascontiguousarray(bins[:, f]), int(sizes[f]), [(f, 0, -1)]))
                continue
            codes, at, members = np.zeros(len(bins), np.uint16), 1, []
            for f in group:
                hit = np.flatnonzero(bins[:, f] != common[f])
                codes[hit] = at + bins[hit, f].astype(np.uint16)
                members.append((f, at, int(common[f])))
                at += int(sizes[f])
            self.columns.append((codes, at, members))

    def pays(self, rows: int, pairs: int, nodes: int) -> bool:
        """Whether counting every column of all bins is less work than the (row, feature) ``pairs`` that are looked at."""
        return 4 * pairs >= rows * len(self.columns) + nodes * int(self.offsets[-1])

    def cells(self, q, row, wa, wb, looked: np.ndarray):
        """(keys, a, b) as ``histograms``; ``looked`` is (nodes, features)."""
        nodes, sizes, out = len(looked), np.diff(self.offsets), []
        key = np.empty(len(q), np.int64)
        wanted = [c for c in self.columns if looked[:, [f for f, _, _ in c[2]]].any()]
        for w in (wa.astype(float), wb.astype(float)):       # whole numbers below 2^53
            total, cells = np.bincount(q, w, nodes), np.zeros((nodes, int(self.offsets[-1])))
            out.append(cells)
            for codes, size, members in wanted:
                np.multiply(q, size, out=key)
                key += codes[row]
                got = np.bincount(key, w, nodes * size).reshape(nodes, size)
                for f, at, common in members:
                    mine = cells[:, self.offsets[f]:self.offsets[f + 1]]
                    mine[:] = got[:, at:at + sizes[f]]
                    if common >= 0:
                        mine[:, common] = total - mine.sum(1)
        a, b = out
        hit = (a != 0) | (b != 0)
        if not looked.all():
            hit &= np.repeat(looked, sizes, axis=1)
        at = np.flatnonzero(hit)
        return at, a.ravel()[at].astype(np.int64), b.ravel()[at].astype(np.int64)


class Level:
    """What a task needs to sum one level: the trees so far, the nodes to cut and the features that each looks at."""

    def __init__(self, forest: Forest, specs: Specs, nodes: np.ndarray, keys: np.ndarray, offsets: np.ndarray):
        owner = forest.tree[nodes]
        self.alive = np.unique(owner)
        self.specs = specs.some(self.alive)
        self.sub_at, self.sub = drawn_features(keys, specs.key[owner], specs.per_node[owner], specs.per_tree[owner], len(offsets) - 1)
        self.place = np.full(len(forest.feature), -1, np.int32)
        self.place[nodes] = np.arange(len(nodes))
        self.nodes, self.offsets, self.steps = len(nodes), offsets, forest.levels()
        self.arrays = forest.feature, forest.cut, forest.left
        self.limits = tuple(x[owner] for x in (specs.min_leaf, specs.entropy, specs.lam, specs.gamma))

    def cells(self, bins, label, rid, fold, grads, tally=None):
        """(keys, a, b) of the rows' (node, feature, bin) cells, in chunks, each summed; ``tally`` adds up the rows of every node."""
        specs = self.specs
        left_out = np.where(specs.fold >= 0, specs.fold, -2)[None, :]
        step = max(1, PAIRS // max(1, len(specs)))
        for lo in range(0, len(bins), step):
            part = slice(lo, lo + step)
            q = self.place[descend(*self.arrays, bins[part], np.broadcast_to(self.alive, (len(bins[part]), len(self.alive))), self.steps)]
            use = (q >= 0) & (fold[part, None] != left_out)
            if grads is None:
                wa = bootstrap(rid[part], specs.sample)
                wb = wa * label[part, None]
            else:
                wa, wb = (g[part][:, self.alive] for g in grads)
            use &= (wa != 0) | (wb != 0)
            r, t = np.nonzero(use)
            if tally is not None:
                tally += np.bincount(q[r, t], minlength=self.nodes)
            yield from histograms(q[r, t], r, wa[r, t], wb[r, t], bins[part], self.sub_at, self.sub, self.offsets)

    def cuts(self, held: _Held, newton: bool) -> list[np.ndarray]:
        return list(best_cuts(*held.sum(), self.offsets, newton, *self.limits))


def row_columns(batch: pa.RecordBatch, d: int):
    """(bins, label, rid, fold) of a batch of binned rows."""
    col = lambda n: batch.column(batch.schema.get_field_index(n))
    bins = np.frombuffer(b"".join(col("bins").to_pylist()), np.uint8).reshape(batch.num_rows, d)
    return bins, *(col(c).to_numpy() for c in ("label", "rid", "fold"))


def _add_notes(noted: dict, found) -> None:
    for t, x, y in found:
        p = noted.get(int(t), (0, 0))
        noted[int(t)] = (p[0] + int(x), p[1] + int(y))


def level_cuts(data: Binned, forest: Forest, specs: Specs, nodes: np.ndarray, keys: np.ndarray, newton=None, notes=None):
    """Best cuts of the active ``nodes``: one pass over the rows, one shuffle.

    ``newton(batch, bins)`` gives (rows, trees) hessians and gradients as integers, None: class weights. ``notes``, if given, is
    called with every batch and returns (number, sum, sum) triples that ride along in the same pass; their totals come back too.
    """
    d, width = len(data.thresholds), int(data.offsets[-1])
    spark = data.rows.sparkSession
    deal = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(len(nodes) / 64)))
    sent = spark.sparkContext.broadcast(Level(forest, specs, nodes, keys, data.offsets))

    def sums(batches):
        level = sent.value
        held, noted, tally = _Held(), {}, np.zeros(level.nodes, np.int64) if newton is not None else None

        def out():
            got = [(-1, np.array([t]), np.array([x]), np.array([y])) for t, (x, y) in noted.items()]
            noted.clear()
            if tally is not None:
                got.append((-2, np.flatnonzero(tally), tally[tally > 0], tally[tally > 0]))
                tally[:] = 0
            k, a, b = held.sum()
            held.parts, held.size = [], 0
            to = (k // width) * deal // level.nodes
            edge = np.flatnonzero(np.diff(to, prepend=-1))
            got += [(int(to[lo]), k[lo:hi], a[lo:hi], b[lo:hi]) for lo, hi in zip(edge, [*edge[1:], len(k)])]
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), *[pa.array([g[i].astype(np.int64).tobytes() for g in got], pa.binary()) for i in (1, 2, 3)]],
                                              names=["bucket", "keys", "a", "b"])

        for b in batches:
            bins, label, rid, fold = row_columns(b, d)
            if notes is not None:
                _add_notes(noted, notes(b, bins))
            for cells in level.cells(bins, label, rid, fold, newton(b, bins) if newton is not None else None, tally):
                held.add(*cells)
                if held.size > 2 * CELLS:
                    yield out()
        yield out()

    def choose(batches):
        held, noted, tally = _Held(), {}, np.zeros(sent.value.nodes, np.int64)
        for b in batches:
            for to, k, x, y in zip(*(c.to_pylist() for c in b.columns)):
                k, x, y = (np.frombuffer(v, np.int64) for v in (k, x, y))
                if to == -2:
                    tally[k] += x
                elif to < 0:
                    _add_notes(noted, zip(k, x, y))
                else:
                    held.add(k, x, y)
        cols = sent.value.cuts(held, newton is not None)
        for t, (x, y) in noted.items():
            cols = [np.append(c, v) for c, v in zip(cols, (-1 - t, -1, 0, 0.0, x, y, 0, 0))]
        if (q := np.flatnonzero(tally)).size:
            z = np.zeros(len(q), np.int64)
            cols = [np.concatenate([c, v]) for c, v in zip(cols, (q, z - 2, z, z, tally[q], z, z, z))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "gain" else pa.int64()) for n, c in zip(_CUT_NAMES, cols)], names=_CUT_NAMES)

    cells = data.rows.mapInArrow(sums, "bucket int, keys binary, a binary, b binary").repartition(deal, "bucket")
    got = cells.mapInArrow(choose, _CUTS).toArrow()     # a row for each active node
    sent.unpersist()
    cols = {n: got.column(n).to_numpy() for n in _CUT_NAMES}
    noted: dict = {}
    extra = cols["node"] < 0
    _add_notes(noted, zip(-1 - cols["node"][extra], cols["a"][extra], cols["b"][extra]))
    rows, counted = np.zeros(len(nodes), np.int64), cols["feature"] == -2
    rows[cols["node"][counted]] = cols["a"][counted]
    cuts = {n: c[~extra & ~counted] for n, c in cols.items()}
    return cuts | {"rows": rows[cuts["node"]]}, noted


def _grown(specs: Specs, boosted: bool, cuts_of, depth=0, node_key=None, finish=None) -> tuple[Forest, dict]:
    """The level loop; ``cuts_of(forest, nodes, keys, first)`` gives the cuts of a level and, at first, the notes. Roots may stand at a ``depth`` with
    a ``node_key`` each, where they are nodes of a larger tree. Nodes whose parent has at most ``FINISH`` rows (column ``rows`` of the cuts) wait, and
    ``finish(forest, nodes, rows, keys)`` adds what grows below all of them."""
    trees = len(specs)
    z = np.zeros(trees)
    forest = Forest(trees).grown(feature=z - 1, cut=z, left=z, a=z, b=z, gain=z, tree=np.arange(trees), depth=z + depth, parent=z - 1)
    node_key = mixed(specs.key + np.uint64(1)) if node_key is None else node_key
    nodes, noted, first = np.arange(trees), {}, True
    waiting, waiting_rows = [], []
    while len(nodes):
        cuts, said = cuts_of(forest, nodes, node_key[nodes], first)
        noted = said if first else noted
        at = nodes[cuts["node"]]
        if first:
            forest.a[at], forest.b[at] = cuts["a"], cuts["b"]
        first = False
        t = forest.tree[at]
        ok = (cuts["feature"] >= 0) & (forest.depth[at] < specs.depth[t])
        if not boosted:
            ok &= forest.a[at] >= specs.min_split[t]
        order = np.flatnonzero(ok)[np.argsort(at[ok])]
        at, cuts = at[order], {n: c[order] for n, c in cuts.items()}
        base = len(forest.feature)
        forest.feature[at], forest.cut[at], forest.gain[at] = cuts["feature"], cuts["bin"], cuts["gain"]
        forest.left[at] = base + 2 * np.arange(len(at))
        pair = lambda x, whole: np.stack([x, whole[at] - x], 1).ravel()
        twice = lambda x: np.repeat(x, 2)
        a, b = pair(cuts["la"], forest.a), pair(cuts["lb"], forest.b)
        with np.errstate(over="ignore"):
            node_key = np.append(node_key, mixed(twice(node_key[at]) * np.uint64(2) + np.tile(np.array([0, 1], np.uint64), len(at))))
        z = np.zeros(2 * len(at))
        forest = forest.grown(feature=z - 1, cut=z, left=z, a=a, b=b, gain=z, tree=twice(forest.tree[at]), depth=twice(forest.depth[at] + 1), parent=twice(at))
        nodes = base + np.arange(2 * len(at))
        t = forest.tree[nodes]
        go = forest.depth[nodes] < specs.depth[t]
        if boosted:
            go &= a >= 2 * specs.min_leaf[t] * UNIT
        else:
            go &= (a >= np.maximum(specs.min_split[t], 2 * specs.min_leaf[t])) & (b > 0) & (b < a)
        if finish is not None:
            rows = twice(cuts["rows"])
            small = go & (rows <= FINISH)
            waiting.append(nodes[small])
            waiting_rows.append(rows[small])
            go &= ~small
        nodes = nodes[go]
    if finish is not None and (waits := np.concatenate([np.zeros(0, np.int64), *waiting])).size:
        forest = finish(forest, waits, np.concatenate(waiting_rows), node_key[waits])
    return forest, noted


class Resident:
    """Rows that a task holds, with the nodes that they have reached in trees numbered from 0: levels grow without descending again."""

    def __init__(self, bins, row, tree, wa, wb, offsets, columns: Columns | None = None):
        self.bins, self.row, self.wa, self.wb, self.offsets, self.columns = bins, row, wa, wb, offsets, columns
        self.node = tree.copy()

    @staticmethod
    def of_table(bins, label, rid, fold, specs: Specs, offsets, columns: Columns | None = None) -> Resident:
        """All rows that each tree of class weights draws."""
        row, tree, wa = [], [], []
        for t in range(len(specs)):
            w = bootstrap(rid, specs.sample[t:t + 1])[:, 0]
            r = np.flatnonzero((w > 0) & (fold != (specs.fold[t] if specs.fold[t] >= 0 else -2)))
            row.append(r.astype(np.int32))
            tree.append(np.full(len(r), t, np.int32))
            wa.append(w[r])
        row, tree, wa = (np.concatenate(x) for x in (row, tree, wa))
        return Resident(bins, row, tree, wa, wa * label[row], offsets, columns)

    def cuts_of(self, specs: Specs, newton: bool):
        def cuts(forest, nodes, keys, first):
            if not first:
                f = forest.feature[self.node]
                if (f < 0).any():
                    go = np.flatnonzero(f >= 0)
                    self.row, self.wa, self.wb, self.node, f = self.row[go], self.wa[go], self.wb[go], self.node[go], f[go]
                self.node = forest.left[self.node] + (self.bins[self.row, f] > forest.cut[self.node])
            place = np.full(len(forest.feature), -1, np.int32)
            place[nodes] = np.arange(len(nodes))
            q = place[self.node]
            if (q < 0).any():
                on = np.flatnonzero(q >= 0)
                self.row, self.wa, self.wb, self.node, q = self.row[on], self.wa[on], self.wb[on], self.node[on], q[on]
            owner = forest.tree[nodes]
            sub_at, sub = drawn_features(keys, specs.key[owner], specs.per_node[owner], specs.per_tree[owner], len(self.offsets) - 1)
            limits = tuple(x[owner] for x in (specs.min_leaf, specs.entropy, specs.lam, specs.gamma))
            rows = np.bincount(q, minlength=len(nodes))
            looked = np.diff(sub_at)
            upto = np.cumsum(np.minimum(rows * looked, looked * int(np.diff(self.offsets).max(initial=0))) if self.columns is None
                             else np.full(len(nodes), int(self.offsets[-1])))      # cells at most
            edges = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(CELLS, upto[-1], CELLS), side="right"), [len(nodes)]]))
            if len(edges) > 2:
                order = np.argsort(q, kind="stable")
                self.row, self.wa, self.wb, self.node, q = self.row[order], self.wa[order], self.wb[order], self.node[order], q[order]
            ends, got = np.append(0, np.cumsum(rows)), []
            for lo, hi in zip(edges, edges[1:]):        # nodes of about CELLS cells, whatever the number of rows and levels
                i, held = slice(ends[lo], ends[hi]), _Held()
                if self.columns is not None and self.columns.pays(int(ends[hi] - ends[lo]), int((rows * looked)[lo:hi].sum()), int(hi - lo)):
                    seen = np.zeros((hi - lo, len(self.offsets) - 1), bool)
                    seen[np.repeat(np.arange(hi - lo), looked[lo:hi]), sub[sub_at[lo]:sub_at[hi]]] = True
                    held.add(*self.columns.cells(q[i] - lo, self.row[i], self.wa[i], self.wb[i], seen))
                else:
                    for part in histograms(q[i] - lo, self.row[i], self.wa[i], self.wb[i], self.bins, sub_at[lo:hi + 1], sub, self.offsets):
                        held.add(*part)
                node, *more = best_cuts(*held.sum(), self.offsets, newton, *(x[lo:hi] for x in limits))
                got.append((node + lo, *more))
            return dict(zip(_CUT_NAMES, (np.concatenate(c) for c in zip(*got)))), {}
        return cuts


def grow_resident(state: Resident, specs: Specs, newton: bool) -> Forest:
    """The trees of the rows that a task holds."""
    return _grown(specs, newton, state.cuts_of(specs, newton))[0]


FOREST = ("feature", "cut", "left", "a", "b", "gain", "tree", "depth", "parent")
_NODES = "feature long, cut long, left long, a long, b long, gain double, tree long, depth long, parent long"


def _grow_in_place(data: Binned, specs: Specs, newton, notes) -> tuple[Forest, dict]:
    """All levels in the one task that holds a table of at most ``DEALT`` (row, tree) pairs: the same sums and cuts without a
    job for each level."""
    d, offsets = len(data.thresholds), data.offsets
    sent = data.rows.sparkSession.sparkContext.broadcast(specs)

    def run(batches):
        specs, parts, noted = sent.value, [], {}
        for b in batches:
            bins, label, rid, fold = row_columns(b, d)
            if notes is not None:
                _add_notes(noted, notes(b, bins))
            parts.append((bins, label, rid, fold, newton(b, bins) if newton is not None else None))

        def cuts_of(forest, nodes, keys, first):
            level, held = Level(forest, specs, nodes, keys, offsets), _Held()
            for part in parts:
                for cells in level.cells(*part):
                    held.add(*cells)
            return dict(zip(_CUT_NAMES, level.cuts(held, newton is not None))), noted

        forest, _ = _grown(specs, newton is not None, cuts_of)
        cols = {n: getattr(forest, n) for n in FOREST}
        for t, (x, y) in noted.items():
            cols = {n: np.append(c, {"a": x, "b": y, "tree": -1 - t}.get(n, 0)) for n, c in cols.items()}
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "gain" else pa.int64()) for n, c in cols.items()], names=list(FOREST))

    got = data.rows.mapInArrow(run, _NODES).toArrow()
    sent.unpersist()
    cols = {n: got.column(n).to_numpy() for n in FOREST}
    noted: dict = {}
    extra = cols["tree"] < 0
    _add_notes(noted, zip(-1 - cols["tree"][extra], cols["a"][extra], cols["b"][extra]))
    return Forest(len(specs)).grown(**{n: c[~extra] for n, c in cols.items()}), noted


def _dealt(rows: np.ndarray, groups: int) -> np.ndarray:
    """A group for every entry, the largest first to the group with the fewest rows."""
    out, heap = np.zeros(len(rows), np.int64), [(0, g) for g in range(groups)]
    for i in np.argsort(-rows, kind="stable").tolist():
        n, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (n + int(rows[i]), g))
    return out


_PIECE = "bucket int, q binary, bins binary, a binary, b binary"


def finished(data: Binned, specs: Specs, newton, forest: Forest, nodes: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> Forest:
    """The forest with all that grows below ``nodes``: their rows meet by node, at most about ``FINISH`` in a task, which grows the levels left."""
    d, offsets, spark = len(data.thresholds), data.offsets, data.rows.sparkSession
    groups = min(len(nodes), max(math.ceil(rows.sum() / FINISH), spark.sparkContext.defaultParallelism))
    group, owner = _dealt(rows, groups), forest.tree[nodes]
    place = np.full(len(forest.feature), -1, np.int32)
    place[nodes] = np.arange(len(nodes))
    sent = spark.sparkContext.broadcast((forest.feature, forest.cut, forest.left, forest.levels(), place, group, np.unique(owner), specs, specs.some(owner), forest.depth[nodes], keys))

    def gather(batches):
        feature, cut, left, levels, place, group, alive, specs, *_ = sent.value
        left_out = np.where(specs.fold[alive] >= 0, specs.fold[alive], -2)[None, :]
        for batch in batches:
            bins, _, _, fold = row_columns(batch, d)
            a, b = (x[:, alive] for x in newton(batch, bins))
            q = place[descend(feature, cut, left, bins, np.broadcast_to(alive, (len(bins), len(alive))), levels)]
            r, t = np.nonzero((q >= 0) & (fold[:, None] != left_out) & ((a != 0) | (b != 0)))
            q, to = q[r, t], group[q[r, t]]
            order = np.argsort(to, kind="stable")
            r, t, q, to = r[order], t[order], q[order], to[order]
            edge = np.flatnonzero(np.diff(to, prepend=-1))
            parts = [slice(lo, hi) for lo, hi in zip(edge, [*edge[1:], len(to)])]
            cols = [pa.array([np.ascontiguousarray(x[p]).tobytes() for p in parts], pa.binary()) for x in (q.astype(np.int32), bins[r], a[r, t], b[r, t])]
            yield pa.RecordBatch.from_arrays([pa.array(to[edge], pa.int32()), *cols], names=["bucket", "q", "bins", "a", "b"])

    def grow_rest(batches):
        *_, group, _, _, mine, depth, keys = sent.value
        held: dict[int, list] = {}
        for batch in batches:
            for to, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(to, []).append(parts)
        for to in list(held):
            q, bins, a, b = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held.pop(to)), (np.int32, np.uint8, np.int64, np.int64)))
            members = np.flatnonzero(group == to)
            some, local = mine.some(members), np.searchsorted(members, q)
            order = np.argsort(local, kind="stable")
            state = Resident(bins.reshape(len(q), d), order, local[order], a[order], b[order], offsets)
            sub, _ = _grown(some, True, state.cuts_of(some, True), depth[members], keys[members])
            cols = [np.full(len(sub.feature), to), *(getattr(sub, n) for n in FOREST)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "gain" else pa.int64()) for n, c in zip(("group", *FOREST), cols)], names=["group", *FOREST])

    got = data.rows.mapInArrow(gather, _PIECE).repartition(groups, "bucket").mapInArrow(grow_rest, "group long, " + _NODES).toArrow()
    sent.unpersist()
    cols = {n: got.column(n).to_numpy() for n in ("group", *FOREST)}
    for to in np.unique(cols["group"]):
        sub, members = {n: c[cols["group"] == to] for n, c in cols.items()}, np.flatnonzero(group == to)
        k, base = len(members), len(forest.feature)
        number = np.concatenate([nodes[members], base + np.arange(len(sub["feature"]) - k)])       # of the part's nodes in the forest
        left = number[sub["left"]]
        for n, c in (("feature", sub["feature"]), ("cut", sub["cut"]), ("gain", sub["gain"]), ("left", left)):
            getattr(forest, n)[nodes[members]] = c[:k]
        more = {n: sub[n][k:] for n in ("feature", "cut", "a", "b", "gain", "depth")}
        forest = forest.grown(**more, left=left[k:], parent=number[sub["parent"]][k:], tree=owner[members][sub["tree"][k:]])
    return forest


def grow(data: Binned, specs: Specs, newton=None, notes=None) -> tuple[Forest, dict]:
    """All trees of ``specs`` at once, and the totals of ``notes`` from the first pass."""
    if data.tasks == 1 and data.n * len(specs) <= min(DEALT, IN_PLACE):
        return _grow_in_place(data, specs, newton, notes)
    finish = None if newton is None else lambda *waiting: finished(data, specs, newton, *waiting)
    return _grown(specs, newton is not None, lambda forest, nodes, keys, first: level_cuts(data, forest, specs, nodes, keys, newton, notes if first else None), finish=finish)


# ---------------------------------------------------------------- fitted models

@dataclass
class TreeModel:
    """Trees with thresholds on raw values: ``x[feature] <= threshold`` goes left. Class 1 score: the mean of the trees' leaf shares."""

    forest: Forest
    thresholds: list[list[float]]
    features_col: str = "features"

    def node_rows(self) -> list[tuple]:
        """(tree, node, depth, feature, threshold, left, right, gain, impurity, n, value); node 0 is the root, a leaf has no feature."""
        f = self.forest
        number = np.zeros(len(f.feature), np.int64)
        for t in range(f.trees):
            at = np.flatnonzero(f.tree == t)
            number[at] = np.arange(len(at))
        gini = _impurity(f.a, f.b, np.zeros(len(f.a), bool)) / np.maximum(f.a, 1)
        out = []
        for i in range(len(f.feature)):
            j = int(f.feature[i])
            inner = j >= 0
            out.append((int(f.tree[i]), int(number[i]), int(f.depth[i]), j if inner else None, self.thresholds[j][f.cut[i]] if inner else None,
                        int(number[f.left[i]]) if inner else None, int(number[f.left[i] + 1]) if inner else None,
                        float(f.gain[i]) / float(f.a[i]) if inner else None, float(gini[i]), int(f.a[i]), float(f.b[i] / max(f.a[i], 1))))
        return out

    def importances(self) -> np.ndarray:
        """Impurity decrease of every feature, each tree's summing to one, averaged."""
        f = self.forest
        out = np.zeros(len(self.thresholds))
        for t in range(f.trees):
            at = np.flatnonzero((f.tree == t) & (f.feature >= 0))
            part = np.bincount(f.feature[at], f.gain[at], len(out))
            out += part / part.sum() if part.sum() > 0 else 0
        return out / out.sum() if out.sum() > 0 else out

    def score(self) -> Column:
        f, cuts = self.forest, [np.asarray(t, float) for t in self.thresholds]
        arrays, levels = (f.feature, f.cut, f.left), f.levels()
        share = f.b / np.maximum(f.a, 1)

        @F.pandas_udf("double")
        def scored(x):
            import pandas as pd

            if not len(x):
                return pd.Series([], dtype=float)
            m = np.stack(x.to_numpy())
            bins = np.stack([np.searchsorted(c, m[:, j], side="left") for j, c in enumerate(cuts)], 1)
            start = np.broadcast_to(np.arange(f.trees), (len(m), f.trees))
            return pd.Series(share[descend(*arrays, bins, start, levels)].mean(1))

        return scored(vector_to_array(F.col(self.features_col)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", self.score()).withColumn("prediction", (F.col("score") > 0.5).cast("double"))


def rows_of(value, n: int) -> int:
    """A share of ``n`` rows (a float below or at one), rounded up, or a number of rows."""
    return max(1, math.ceil(value * n)) if isinstance(value, float) and value <= 1.0 else int(value)


def split_rows(value, n: int) -> int:
    return max(2, rows_of(value, n))


def features_of(value, d: int) -> int:
    """Features looked at in a node: a number, ``auto`` (the root of all) or None (all)."""
    return d if value is None else max(1, int(math.sqrt(d))) if value == "auto" else min(int(value), d)


def fit_forest(train: DataFrame, n_estimators: int = 1, max_depth: int = 5, max_features=None, min_samples_split=2, min_samples_leaf=1, criterion: str = "gini",
               bootstrap_rows: bool = False, seed: int = 0, features_col: str = "features", label_col: str = "label", id_col: str = "id") -> TreeModel:
    """A tree, or a forest of bootstrapped trees. Shares among ``min_samples_*`` are of the training rows."""
    data = bin_rows(train, features_col, label_col, id_col, trees=n_estimators)
    d = len(data.thresholds)
    specs = Specs.of(n_estimators, sample=np.arange(n_estimators) + 1000 * seed if bootstrap_rows else -1, key=mixed(np.arange(n_estimators) + 1000 * seed),
                     per_node=features_of(max_features, d), depth=max_depth, min_split=split_rows(min_samples_split, data.n), min_leaf=rows_of(min_samples_leaf, data.n),
                     entropy=criterion == "entropy")
    forest, _ = grow(data, specs)
    data.release()
    return TreeModel(forest, data.thresholds, features_col)


# ---------------------------------------------------------------- many candidates from few trees

def _cut_back(forest: Forest, specs: Specs, depth: np.ndarray, min_split: np.ndarray) -> np.ndarray:
    """(node, rule) class 1 share that a row reaching ``node`` gets under each stop rule; ``min_split`` is (tree, rule)."""
    share = forest.b / np.maximum(forest.a, 1)
    value = np.zeros((len(share), len(depth)))
    stopped = np.zeros(value.shape, bool)
    for level in range(forest.levels() + 1):
        at = np.flatnonzero(forest.depth == level)
        up = forest.parent[at]
        done = stopped[up] if level else np.zeros((len(at), len(depth)), bool)
        value[at] = np.where(done, value[up] if level else 0.0, share[at, None])
        stopped[at] = done | (level >= depth)[None, :] | (forest.a[at, None] < min_split[forest.tree[at]])
    return value


COUNTS = "family int, fold int, size int, rule int, split string, n long, ap long, pp long, tp long, hit long"


def candidate_counts(data: Binned, families: list[dict], rules: list[tuple], sizes: list[int], folds: list[int], bootstrap_rows: bool, seed: int = 0,
                     score_train: bool = True) -> DataFrame:
    """Counts for every (family, fold, forest size, stop rule): rows, actual and predicted positives, their meet, and hits.

    A family is {max_features, min_samples_leaf, criterion}; a rule is (max_depth, min_samples_split). Each family's trees are grown once per fold, with the loosest rule
    and the most trees, and cut back for every rule and size. ``split`` 'test' counts the fold's rows, 'train' all others.
    A binned table within ``MAX_BROADCAST_BYTES`` is sent to the executors and each (family, fold) is one task's (``_dealt_counts``); for larger
    ones families and folds are grown by passes over the rows, in batches within ``NODE_BUDGET``.
    """
    d, most = len(data.thresholds), max(sizes)
    if sendable(data.n, d):
        return _dealt_counts(data, families, rules, sizes, folds, bootstrap_rows, seed, score_train)
    per_fold = {r["fold"]: r["n"] for r in data.rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(per_fold.values())
    deepest = max(r[0] for r in rules)
    jobs = [(i, f) for f in folds for i in range(len(families))]
    room, batches = 0, [[]]
    for i, f in jobs:
        n = total - per_fold.get(f, 0)
        leaf = rows_of(families[i]["min_samples_leaf"], n)
        need = most * min(2 ** (deepest + 1), 2 * max(1, n // leaf))
        if batches[-1] and room + need > NODE_BUDGET:
            batches.append([])
            room = 0
        batches[-1].append((i, f))
        room += need
    frames = [_batch_counts(data, families, rules, sizes, part, total, per_fold, bootstrap_rows, seed, score_train, d) for part in batches]
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def sendable(n: int, d: int) -> bool:
    """Whether bins, label, id and fold of n rows are proven small enough for a broadcast."""
    return n * (d + 16) <= MAX_BROADCAST_BYTES


_TABLE = dict(bins=np.uint8, label=np.int8, rid=np.int64, fold=np.int32)
#: One table at a time is on its way through the driver, however many threads search.
_SENDING = threading.Lock()


def small_table(data: Binned):
    """(bins, label, rid, fold) of a table that is ``sendable``; rows come packed, a few bytes each, and are no objects on the driver."""
    d = len(data.thresholds)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                cols = dict(zip(("bins", "label", "rid", "fold"), row_columns(b, d)))
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(cols[n].astype(t)).tobytes()], pa.binary()) for n, t in _TABLE.items()], names=list(_TABLE))

    got = data.rows.select("rid", "label", "fold", "bins").mapInArrow(pack, ", ".join(f"{n} binary" for n in _TABLE)).toArrow()       # within MAX_BROADCAST_BYTES
    out = {n: np.concatenate([np.zeros(0, t), *(np.frombuffer(v.as_buffer(), t) for v in got.column(n))]) for n, t in _TABLE.items()}
    return out["bins"].reshape(-1, d), out["label"], out["rid"], out["fold"]


def sent_table(data: Binned):
    """``small_table`` as a broadcast variable; to be destroyed after use, or the driver keeps it."""
    with _SENDING:
        return data.rows.sparkSession.sparkContext.broadcast(small_table(data))


def _dealt_counts(data: Binned, families: list[dict], rules: list[tuple], sizes: list[int], folds: list[int], bootstrap_rows: bool, seed: int, score_train: bool) -> DataFrame:
    """Counts as ``candidate_counts``, the trees of a (family, fold) grown one bundle after the other in the task that also counts their hits: no
    trees and no histograms are shuffled or reach the driver. A task holds ``ROOM`` (row, tree) pairs at a time, and one sum for each row and rule."""
    d, most, spark, offsets = len(data.thresholds), max(sizes), data.rows.sparkSession, data.offsets
    sent = sent_table(data)
    jobs = [(i, f) for f in folds for i in range(len(families))]
    jobs.sort(key=lambda j: features_of(families[j[0]]["max_features"], d) / rows_of(families[j[0]]["min_samples_leaf"], data.n), reverse=True)     # the longest first
    depth = np.array([r[0] for r in rules])

    def one(number):
        bins, label, rid, fold = sent.value
        family, out_fold = families[jobs[number][0]], jobs[number][1]
        n = int((fold != out_fold).sum())
        splits = np.array([split_rows(r[1], n) for r in rules])
        parts = {"test": np.flatnonzero(fold == out_fold)} | ({"train": np.flatnonzero(fold != out_fold)} if score_train else {})
        sums = {k: np.zeros((len(at), len(rules))) for k, at in parts.items()} if most > 1 else {}
        bundle, chunk = max(1, ROOM // max(1, n)), max(1, (1 << 20) // len(rules))
        columns = Columns(bins, offsets)
        for lo in range(0, most, bundle):
            index = np.arange(lo, min(lo + bundle, most)) + 1000 * seed
            specs = Specs.of(len(index), fold=out_fold, sample=index if bootstrap_rows else -1, key=mixed(index), per_node=features_of(family["max_features"], d), depth=depth.max(),
                             min_split=splits.min(), min_leaf=float(rows_of(family["min_samples_leaf"], n)), entropy=family.get("criterion", "gini") == "entropy")
            state = Resident.of_table(bins, label, rid, fold, specs, offsets, columns)
            forest = grow_resident(state, specs, False)
            del state
            levels, leaves = forest.levels(), {}
            for t in range(len(index)):
                for kind, at in parts.items():
                    leaves[t, kind] = np.concatenate([np.zeros(0, np.int32), *(descend(forest.feature, forest.cut, forest.left, bins[r], np.full((len(r), 1), t, np.int32), levels)[:, 0]
                                                                               for r in (at[c:c + PAIRS] for c in range(0, len(at), PAIRS)))])
            few = max(1, 2 * CELLS // len(forest.feature))        # rules whose values of all nodes are held at a time
            for first in range(0, len(rules), few):
                some = slice(first, first + few)
                value = _cut_back(forest, specs, depth[some], np.broadcast_to(splits[some], (len(index), len(splits[some]))))
                for (t, kind), leaf in leaves.items():
                    at, counted = parts[kind], lo + t + 1 in sizes
                    pp, tp, hit = (np.zeros(value.shape[1], np.int64) for _ in range(3))
                    for c in range(0, len(at), chunk):
                        v = value[leaf[c:c + chunk]]
                        if most > 1:
                            v = np.add(sums[kind][c:c + chunk, some], v, out=sums[kind][c:c + chunk, some])
                        if counted:
                            p, y = v / (lo + t + 1) > 0.5 + 1e-12, (label[at[c:c + chunk]] == 1)[:, None]
                            pp, tp, hit = pp + p.sum(0), tp + (p & y).sum(0), hit + (p == y).sum(0)
                    if counted:
                        for i in range(len(pp)):
                            yield (jobs[number][0], out_fold, lo + t + 1, first + i, kind, len(at), int(label[at].sum(dtype=np.int64)), int(pp[i]), int(tp[i]), int(hit[i]))

    def run(batches):
        names = [c.split()[0] for c in COUNTS.split(", ")]
        for b in batches:
            for number in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(_columns(one(number)), schema=pa.schema(list(zip(names, _COUNT_TYPES))))

    out = cut_lineage(spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, COUNTS))
    sent.destroy()        # the counts are in their checkpoint
    return out


_COUNT_TYPES = [pa.int32()] * 4 + [pa.string()] + [pa.int64()] * 5


def _columns(rows):
    return [pa.array(c, t) for c, t in zip(zip(*rows), _COUNT_TYPES)]


def _batch_counts(data, families, rules, sizes, jobs, total, per_fold, bootstrap_rows, seed, score_train, d) -> DataFrame:
    most = max(sizes)
    rep = lambda x: np.repeat(np.array(x), most)
    rows = [total - per_fold.get(f, 0) for _, f in jobs]
    index = np.tile(np.arange(most), len(jobs)) + 1000 * seed
    splits = np.array([[split_rows(r[1], n) for r in rules] for n in rows])
    specs = Specs.of(len(jobs) * most, fold=rep([f for _, f in jobs]), sample=index if bootstrap_rows else -1, key=mixed(index),
                     per_node=rep([features_of(families[i]["max_features"], d) for i, _ in jobs]), depth=max(r[0] for r in rules), min_split=rep(splits.min(1)),
                     min_leaf=rep([rows_of(families[i]["min_samples_leaf"], n) for (i, _), n in zip(jobs, rows)]).astype(float),
                     entropy=rep([families[i].get("criterion", "gini") == "entropy" for i, _ in jobs]))
    forest, _ = grow(data, specs)
    depth = np.array([r[0] for r in rules])
    spark = data.rows.sparkSession
    sent = spark.sparkContext.broadcast((forest, specs, np.repeat(splits, most, 0)))
    levels, places = forest.levels(), np.array(sizes) - 1
    at_once = max(1, (1 << 21) // (most * len(rules)))          # (row, forest) pairs cut back at a time

    def count(batches):
        forest, specs, min_split = sent.value
        value = _cut_back(forest, specs, depth, min_split)
        got = np.zeros((2, len(jobs), len(sizes), len(rules), 3), np.int64)     # pp, tp, hit
        of = np.zeros((2, len(jobs), 2), np.int64)                              # n, ap
        for b in batches:
            bins, label, _, fold = row_columns(b, d)
            for g, (_, out_fold) in enumerate(jobs):
                roots = np.arange(g * most, (g + 1) * most)
                for kind, mine in ((0, fold == out_fold), (1, fold != out_fold)):
                    if kind and not score_train:
                        continue
                    at = np.flatnonzero(mine)
                    of[kind, g] += [len(at), int(label[at].sum())]
                    for lo in range(0, len(at), at_once):
                        r = at[lo:lo + at_once]
                        leaf = descend(forest.feature, forest.cut, forest.left, bins[r], np.broadcast_to(roots, (len(r), most)), levels)
                        p = np.cumsum(value[leaf], 1)[:, places] / (places + 1)[None, :, None] > 0.5 + 1e-12
                        y = (label[r] == 1)[:, None, None]
                        got[kind, g] += np.stack([p.sum(0), (p & y).sum(0), (p == y).sum(0)], -1)
        k, g, s, r = np.indices(got.shape[:4]).reshape(4, -1)
        if not score_train:
            k, g, s, r = (x[: len(x) // 2] for x in (k, g, s, r))
        flat = got.reshape(-1, 3)[: len(k)]
        fam, fol = np.array([i for i, _ in jobs]), np.array([f for _, f in jobs])
        yield pa.RecordBatch.from_arrays(
            [pa.array(fam[g], pa.int32()), pa.array(fol[g], pa.int32()), pa.array(np.array(sizes)[s], pa.int32()), pa.array(r, pa.int32()),
             pa.array(np.array(["test", "train"])[k]), pa.array(of[k, g, 0]), pa.array(of[k, g, 1]), *[pa.array(flat[:, i]) for i in range(3)]],
            names=[x.split()[0] for x in COUNTS.split(", ")])

    parts = data.rows.mapInArrow(count, COUNTS)
    out = cut_lineage(parts.groupBy("family", "fold", "size", "rule", "split").agg(*[F.sum(c).alias(c) for c in ("n", "ap", "pp", "tp", "hit")]))
    sent.unpersist()        # this batch's trees are no longer needed
    return out


def count_metrics() -> dict[str, Column]:
    """Accuracy, class 1 precision and recall and the macro averages (0/0 is 0) from the counts."""
    n, ap, pp, tp, hit = (F.col(c).cast("double") for c in ("n", "ap", "pp", "tp", "hit"))
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    tn = hit - tp
    prec, rec, prec0, rec0 = safe(tp, pp), safe(tp, ap), safe(tn, n - pp), safe(tn, n - ap)
    f1 = lambda p, r: safe(2 * p * r, p + r)
    return {"accuracy": safe(hit, n), "precision": prec, "recall": rec, "recall_macro": (rec + rec0) / 2, "f1_macro": (f1(prec, rec) + f1(prec0, rec0)) / 2}


def search_forests(train: DataFrame, candidates: list[dict], folds: list[int], metrics: list[str], fold_col: str = "cv_fold", bootstrap_rows: bool = True, seed: int = 0,
                   score_train: bool = True, features_col: str = "features", label_col: str = "label", id_col: str = "id") -> DataFrame:
    """(candidate, fold, split, <metrics>) for forests {n_estimators, max_depth, max_features, min_samples_split, min_samples_leaf[, criterion]}.

    Every candidate's result is that of its own forest fitted with the same seed; candidates that differ in the forest's size or
    the stop rules share their trees.
    """
    key = lambda p: (p.get("max_features"), p.get("min_samples_leaf", 1), p.get("criterion", "gini"))
    rule = lambda p: (p.get("max_depth", 5), p.get("min_samples_split", 2))
    unique = lambda xs: list({(type(x), x) if not isinstance(x, tuple) else tuple((type(v), v) for v in x): x for x in xs}.values())
    fams, rules, sizes = unique(map(key, candidates)), unique(map(rule, candidates)), sorted({p.get("n_estimators", 1) for p in candidates})
    same = lambda xs, x: next(i for i, y in enumerate(xs) if y == x and list(map(type, y)) == list(map(type, x)))
    data = bin_rows(train, features_col, label_col, id_col, fold_col, trees=max(sizes) * len(fams) * len(folds), send=True)
    counts = candidate_counts(data, [dict(zip(("max_features", "min_samples_leaf", "criterion"), f)) for f in fams], rules, sizes, folds, bootstrap_rows, seed, score_train)
    data.release()
    spark = train.sparkSession
    want = spark.createDataFrame([(i, same(fams, key(p)), same(rules, rule(p)), p.get("n_estimators", 1)) for i, p in enumerate(candidates)],
                                 "candidate int, family int, rule int, size int")
    cols = count_metrics()
    return counts.join(F.broadcast(want), ["family", "rule", "size"]).select("candidate", "fold", "split", *[cols[m].alias(m) for m in metrics])
