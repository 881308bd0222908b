"""Exact KNN equals brute force on tie-heavy data, on both plans: blocked join across several
query and training blocks, and broadcast queries with a running top-k per partition (D8)."""

import numpy as np
import pytest

from binlens.operators import knn
from binlens.operators.knn import knn_predict, nearest_neighbours


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_knn_matches_brute_force(spark, broadcast_bytes):
    rng = np.random.RandomState(3)
    X = rng.randint(0, 4, size=(90, 3)).astype(float)      # many equal distances -> tie order matters
    y = rng.randint(0, 3, size=90)
    Q = rng.randint(0, 4, size=(25, 3)).astype(float)
    train = spark.createDataFrame([(i, X[i].tolist(), int(y[i])) for i in range(90)], "id long, vec array<double>, label int")
    queries = spark.createDataFrame([(1000 + j, Q[j].tolist()) for j in range(25)], "id long, vec array<double>")
    k = 4
    got = nearest_neighbours(train, queries, k, query_block=7, train_block=20, broadcast_bytes=broadcast_bytes).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r.qid, []).append((r.rank, r.tid))
    for j in range(25):
        d2 = ((X - Q[j]) ** 2).sum(1)
        want = sorted(range(90), key=lambda i: (d2[i], i))[:k]
        assert [t for _, t in sorted(by_q[1000 + j])] == want
    pred = {r.qid: r.prediction for r in knn_predict(
        nearest_neighbours(train, queries, k, query_block=7, train_block=20, broadcast_bytes=broadcast_bytes)).collect()}
    for j in range(25):
        d2 = ((X - Q[j]) ** 2).sum(1)
        nb = sorted(range(90), key=lambda i: (d2[i], i))[:k]
        votes = np.bincount(y[nb], minlength=3)
        assert pred[1000 + j] == int(np.argmax(votes))     # argmax keeps the lowest class on a tie


def test_lsh_neighbours_recall_and_hot_bucket_split(spark):
    from binlens.operators.knn import approx_neighbours

    rng = np.random.RandomState(7)
    centers = rng.normal(0, 3, size=(5, 8))
    X = np.concatenate([c + rng.normal(0, 0.3, size=(60, 8)) for c in centers])
    Q = np.concatenate([c + rng.normal(0, 0.3, size=(6, 8)) for c in centers])
    train = spark.createDataFrame([(i, X[i].tolist(), i // 60) for i in range(len(X))], "id long, vec array<double>, label int")
    queries = spark.createDataFrame([(1000 + j, Q[j].tolist()) for j in range(len(Q))], "id long, vec array<double>")
    k = 3
    exact = {(r.qid, r.tid) for r in nearest_neighbours(train, queries, k).collect()}
    big = approx_neighbours(train, queries, k, bucket_length=4.0, num_tables=4)
    small = approx_neighbours(train, queries, k, bucket_length=4.0, num_tables=4, train_block=7)   # many sub-blocks
    a = {(r.qid, r.tid) for r in big.collect()}
    b = {(r.qid, r.tid) for r in small.collect()}
    assert a == b                                   # splitting hot buckets changes nothing
    assert len(a & exact) / len(exact) >= 0.9       # recall against the exact answer


def test_every_query_is_answered(spark):
    from binlens.operators.knn import approx_neighbours
    rng = np.random.RandomState(1)
    train = spark.createDataFrame([(i, rng.normal(0, 1, 4).tolist(), i % 2) for i in range(80)], "id long, vec array<double>, label int")
    queries = spark.createDataFrame([(1000 + j, (np.ones(4) * 1e3 * j).tolist()) for j in range(6)], "id long, vec array<double>")
    kw = dict(bucket_length=0.5, num_tables=2)
    got = approx_neighbours(train, queries, 3, **kw).collect()
    assert {r.qid for r in got} == {1000 + j for j in range(6)} and len(got) == 18
    split = approx_neighbours(train, queries, 3, query_block=1, train_block=9, **kw).collect()
    assert sorted(map(str, split)) == sorted(map(str, got))


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_text_ids_and_manhattan(spark, p, broadcast_bytes):
    rng = np.random.RandomState(5)
    X = rng.randint(0, 4, size=(70, 3)).astype(float)
    Q = rng.randint(0, 4, size=(12, 3)).astype(float)
    tid = [f"{(i * 37) % 1000:03d}ab" for i in range(70)]
    train = spark.createDataFrame([(tid[i], X[i].tolist(), i % 3) for i in range(70)], "id string, vec array<double>, label int")
    queries = spark.createDataFrame([(f"q{j}", Q[j].tolist()) for j in range(12)], "id string, vec array<double>")
    got = nearest_neighbours(train, queries, 4, query_block=5, train_block=16, broadcast_bytes=broadcast_bytes, p=p).collect()
    for j in range(12):
        d = (np.abs(X - Q[j]) ** p).sum(1)
        want = sorted(range(70), key=lambda i: (d[i], tid[i]))[:4]
        mine = sorted((r.rank, r.tid, r.d2) for r in got if r.qid == f"q{j}")
        assert [t for _, t, _ in mine] == [tid[i] for i in want] and [x for *_, x in mine] == [d[i] for i in want]


# ---------------------------------------------------------------- pivots

def _sides(spark, x, y, q):
    train = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(len(x))], "id long, vec array<double>, label int").repartition(4)
    return train, spark.createDataFrame([(5000 + j, v.tolist()) for j, v in enumerate(q)], "id long, vec array<double>")


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("pivots,block,crowd", [(1, 1000, 1000), (12, 20, 7), (400, 1000, 1000)])
def test_pivot_join_equals_brute_force(spark, p, pivots, block, crowd):
    from binlens.operators.pivot_knn import pivot_neighbours

    rng = np.random.RandomState(5)
    x = np.concatenate([rng.randint(0, 5, (120, 3)).astype(float), rng.normal(20, 2, (60, 3)), np.zeros((40, 3))])      # ties, a far cluster, a pile of copies
    q = np.concatenate([rng.randint(0, 5, (25, 3)).astype(float), rng.normal(20, 3, (10, 3)), [[100.0, 100.0, 100.0], [0.0, 0.0, 0.0]]])
    train, queries = _sides(spark, x, rng.randint(0, 2, len(x)), q)
    got = {}
    for r in pivot_neighbours(train, queries, 4, pivots=pivots, p=p, block=block, query_block=crowd).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.tid, r.d2))
    for j, v in enumerate(q):
        d = np.round((np.abs(x - v) if p == 1 else (x - v) ** 2).sum(1), 9)
        want = sorted(range(len(x)), key=lambda i: (d[i], i))[:4]
        assert [(t, e) for _, t, e in sorted(got[5000 + j])] == [(i, d[i]) for i in want]


def test_pivot_join_visits_few_cells(spark):
    """Queries in tight clusters look at a small part of the training rows."""
    from binlens.operators import pivot_knn as K

    rng = np.random.RandomState(1)
    centre = rng.normal(0, 10, (30, 4))
    x = (centre[:, None] + rng.normal(0, 0.3, (30, 40, 4))).reshape(-1, 4)
    pivots = x[rng.permutation(len(x))[:60]]
    d, dq = K._to_pivots(x, pivots, 2), K._to_pivots(x[::7] + 0.01, pivots, 2)
    cell = d.argmin(1)
    low, high, size = (np.array([f(d[cell == c, c]) for c in range(60)]) for f in (min, max, len))
    bound = K.promised(dq, high, size, 3)
    true = np.sort(np.linalg.norm(x[::7][:, None] + 0.01 - x[None], axis=2), 1)[:, 2]
    assert (bound >= true - 1e-9).all()
    can = K.visits(dq, true, dq.argmin(1), low, high, K._to_pivots(pivots, pivots, 2), 2)
    assert (can @ size).mean() < 0.1 * len(x)


def test_pivot_join_odd_sides(spark):
    from binlens.operators.pivot_knn import pivot_neighbours

    train, queries = _sides(spark, np.arange(6).reshape(3, 2).astype(float), [0, 1, 1], np.ones((2, 2)))
    assert pivot_neighbours(train.limit(0), queries, 3).count() == 0 and pivot_neighbours(train, queries.limit(0), 3).count() == 0
    assert pivot_neighbours(train, queries, 9).count() == 6
    named = lambda df: df.selectExpr("concat('r', id) AS id", *[c for c in df.columns if c != "id"])
    assert {r.tid for r in pivot_neighbours(named(train), named(queries), 2).collect()} <= {"r0", "r1", "r2"}


def test_block_memory_stays_bounded():
    """300 queries against a full training block of 16,384 rows stay under 100 MB."""
    import tracemalloc

    import pandas as pd

    from binlens.operators import knn

    rng = np.random.RandomState(0)
    X, Q = rng.normal(size=(16384, 8)), rng.normal(size=(300, 8))
    t = pd.DataFrame({"tid": np.arange(16384), "vec": list(X), "label": 0})
    q = pd.DataFrame({"qid": np.arange(300), "vec": list(Q)})
    tracemalloc.start()
    got = knn._block_pairs(3, 2)(q, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    want = [np.lexsort((np.arange(16384), np.round(((X - v) ** 2).sum(1), 9)))[:3].tolist() for v in Q[:20]]
    assert got.sort_values(["qid", "d2", "tid"]).groupby("qid")["tid"].apply(list).tolist()[:20] == want


@pytest.mark.parametrize("p", [1, 2])
def test_boxes_beyond_the_kth_distance_are_not_looked_into(monkeypatch, p):
    from binlens.operators import knn

    rng = np.random.RandomState(1)
    X = np.column_stack([rng.randint(0, 30, 8000) * 50.0, rng.normal(size=(8000, 2)).round(1)])
    X[4000:5000] = X[:1000]                                         # ties
    tids, Q = rng.permutation(8000), X[rng.permutation(8000)[:600]] + rng.choice([0, 0.05], (600, 3))
    pairs, top = [], knn.block_topk
    monkeypatch.setattr(knn, "block_topk", lambda q, x, *a, **k: pairs.append(len(q) * len(x)) or top(q, x, *a, **k))
    search = knn.Search(Q, 4, p)
    for lo in range(0, 8000, 3000):
        search.add(X[lo:lo + 3000], tids[lo:lo + 3000], tids[lo:lo + 3000] % 2)
    got = search.found(np.arange(600)).sort_values(["qid", "d2", "tid"]).groupby("qid")["tid"].apply(list).tolist()
    exact = lambda v: np.round((np.abs(X - v) if p == 1 else (X - v) ** 2).sum(1), 9)
    assert got == [tids[np.lexsort((tids, exact(v)))[:4]].tolist() for v in Q]
    assert sum(pairs) < 600 * 8000 / 2


@pytest.mark.parametrize("p", [1, 2])
def test_many_queries_look_into_all_training_rows_sent(spark, monkeypatch, p):
    rng = np.random.RandomState(5)
    X, Q = (np.column_stack([rng.randint(0, 2, n) * 4.0, rng.randint(0, 3, n) / 2, rng.rand(n).round(2)]) for n in (900, 700))
    train = spark.createDataFrame([(i, X[i].tolist(), i % 2) for i in range(900)], "id long, vec array<double>, label int").repartition(6)
    queries = spark.createDataFrame([(i, Q[i].tolist()) for i in range(700)], "id long, vec array<double>").repartition(5)
    monkeypatch.setattr(knn, "FEW_QUERIES", 10)
    monkeypatch.setattr(knn, "LEAF", 16)
    out = nearest_neighbours(train, queries, 3, p=p)
    assert out.count() == 2100
    got = {(r["qid"], r["rank"]): (r["tid"], r["d2"], r["label"]) for r in out.collect()}
    diff = Q[:, None, :] - X[None]
    d = np.round((np.abs(diff) if p == 1 else diff * diff).sum(-1), 9)
    for i in range(700):
        for rank, t in enumerate(np.lexsort((np.arange(900), d[i]))[:3], 1):
            assert got[i, rank] == (t, pytest.approx(d[i, t], abs=1e-9), t % 2)


def test_boxes_part_at_value_borders():
    rng = np.random.RandomState(6)
    x = np.column_stack([(rng.rand(3000) < 0.1) * 5.0, (rng.rand(3000) < 0.3) * 4.0, rng.rand(3000)])
    groups = knn.leaves(x, 100)
    assert sorted(np.concatenate(groups).tolist()) == list(range(3000)) and max(map(len, groups)) <= 100
    assert all(len(np.unique(x[g, j])) == 1 for g in groups for j in (0, 1))
    assert max(map(len, knn.leaves(np.zeros((500, 2)), 100))) <= 100 and max(map(len, knn.leaves(np.full((500, 2), np.nan), 100))) <= 100


# ---------------------------------------------------------------- cells

@pytest.mark.parametrize("p", [1, 2])
def test_many_queries_are_dealt_by_cell_and_stay_off_the_driver(spark, monkeypatch, p):
    """Queries within the limit, training rows beyond it: queries used to be collected as rows and met every training partition."""
    monkeypatch.setattr(knn, "FEW_QUERIES", 10)
    rng = np.random.RandomState(9)
    X = np.concatenate([rng.randint(0, 4, (300, 3)).astype(float), rng.normal(30, 2, (200, 3)), np.zeros((60, 3))])
    Q = np.concatenate([rng.randint(0, 4, (40, 3)).astype(float), rng.normal(30, 3, (20, 3)), [[1e6, 0, 0], [0, 0, 0]]])
    train = spark.createDataFrame([(i, X[i].tolist(), i % 3) for i in range(len(X))] + [(None, [0.0] * 3, 1)], "id long, vec array<double>, label int").repartition(3)
    queries = spark.createDataFrame([(1000 + j, v.tolist()) for j, v in enumerate(Q)], "id long, vec array<double>")
    whole = type(queries).collect
    monkeypatch.setattr(type(queries), "collect", lambda self: pytest.fail("vectors reach the driver") if "vec" in self.columns else whole(self))
    frame = nearest_neighbours(train, queries, 4, query_block=9, train_block=50, broadcast_bytes=len(Q) * 3 * 8, p=p)
    got = {}
    for r in frame.collect():
        got.setdefault(r.qid, []).append((r["rank"], r.tid, r.label, r.d2))
    for j, v in enumerate(Q):
        d = np.round((np.abs(X - v) ** p).sum(1), 9)
        want = sorted(range(len(X)), key=lambda i: (d[i], i))[:4]
        assert [(t, y, e) for _, t, y, e in sorted(got[1000 + j])] == [(i, i % 3, d[i]) for i in want]


@pytest.mark.parametrize("n,k", [(0, 3), (1, 3), (40, 60)])
def test_cells_with_few_training_rows(spark, n, k):
    rng = np.random.RandomState(n)
    X = rng.normal(0, 1, (n, 2))
    train = spark.createDataFrame([(i, X[i].tolist(), 1) for i in range(n)], "id long, vec array<double>, label int")
    queries = spark.createDataFrame([(j, [float(j), 0.0]) for j in range(5)], "id long, vec array<double>")
    got = nearest_neighbours(train, queries, k, query_block=2, train_block=8, broadcast_bytes=0).collect()
    assert len(got) == 5 * min(n, k) and {(r.qid, r.tid) for r in got} == {(j, i) for j in range(5) for i in range(n)}


def test_cuts_part_what_can_be_parted():
    x = np.concatenate([np.zeros((50, 2)), np.random.RandomState(0).normal(0, 1, (50, 2))])
    cuts = knn.Cuts(x, 10)
    cell = cuts.cell_of(x)
    assert cuts.cells > 4 and len(set(cell[:50])) == 1 and np.bincount(cell[50:]).max() <= 10
    assert knn.Cuts(np.zeros((0, 2)), 10).cells == 1
