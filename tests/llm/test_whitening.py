import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from binlens.llm import whitening as W
from binlens.llm.queries import QUERIES

from conftest import SF001

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(n, {id: deviation}, fit matrix, kept vectors) with whole numbers."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in map(float, v)]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    dev = defaultdict(set)
    for i, x in kept:
        dev[i].add(sum((n * a - b) ** 2 for a, b in zip(x, s)))
    return n, dev, fit, s, kept


def check(rows, got, most=16):
    n, dev, fit, s, kept = brute(rows)
    d = len(s)
    cov = np.array([[float(sum(Fraction(n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit) / n**3) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    k = int((e > 1e-12 * np.trace(cov)).sum())
    assert len(got) == k * len(kept)
    by = defaultdict(dict)
    for r in got:
        by[r.component][r.vec_id] = r
        assert r.n == n and r.deviation in dev[r.vec_id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-9)
    mean = np.array([v / n for v in s])
    for c in range(1, k + 1):
        want = {i: (np.array(x) - mean) @ u[:, c - 1] / math.sqrt(e[c - 1]) for i, x in kept}
        sign = np.sign(sum(want[i] * by[c][i].whitened for i in want))
        assert all(by[c][i].whitened == pytest.approx(sign * want[i], abs=1e-6) for i in want)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").limit(60).collect()]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    check(rows, W.whiten(df).collect())
    full = QUERIES["op13_whitening"](spark, SF001)
    assert full.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = full.collect()
    assert len(got) == 16 * spark.read.parquet(f"{SF001}/embeddings.parquet").count() and max(r.identity_error for r in got) < 1e-9


def test_few_dimensions_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 3, 3).tolist()) for i in range(50)] + [(i, [0.5, 1.0, -2.0]) for i in range(50, 150)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    check(rows, W.whiten(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(5)).collect())


def test_polarisation_is_exact():
    rng = np.random.default_rng(1)
    for most in (200, 1 << 49):
        z = rng.integers(-most, most, (40, 5))
        n, sums = len(z), [int(v) for v in z.astype(object).sum(0)]
        got = W.covariance(n, sums, W.polar_sums(z), 5)
        want = [[float(Fraction(sum(int(r[a]) * int(r[b]) for r in z), n) - Fraction(sums[a] * sums[b], n * n)) for b in range(5)] for a in range(5)]
        assert np.allclose(got, want, rtol=1e-15, atol=0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i % 3) / 64, 1.0]) for i in range(30)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [nan, 1.0, 2.0]), (93, [inf, 1.0, 2.0]), (94, []), (95, [1.0]), (None, [2.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], SCHEMA)
    got = W.whiten(df).collect()
    assert {r.component for r in got} == {1, 2}          # the third dimension is constant
    assert sorted({str(r.vec_id) for r in got}) == sorted({*(str(i) for i, _ in good), "None"})
    again = W.whiten(df.selectExpr("*", "'x' AS id", "'y' AS x", "1 AS component", "2 AS n", "embedding AS whitened")).collect()
    key = lambda r: (str(r.vec_id), r.component, round(r.whitened, 9), r.deviation)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.where("vec_id in (90, 92, 94)")).count() == 0
    assert W.whiten(df.where("vec_id = 1")).count() == 0
    huge = spark.createDataFrame([(i, [1e30 * (i - 1), float(i)], 0) for i in range(4)], SCHEMA)
    assert all(r.deviation is None or r.deviation >= 0 for r in W.whiten(huge).collect())
