"""Every registered query without an oracle runs on the smallest tables, returns a stable,
vector-free schema, and satisfies its structural invariants."""

from collections import Counter

import pytest

import __spark_entry__ as E

from binlens.plans.catalog import QUERIES as CATALOG

from conftest import SF001

QUERIES = E.queries()
# the training-data queries have tests of their own
ROWS_ONLY = sorted(q for q in set(QUERIES) - set(E.oracle_sql()) if q in CATALOG)


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name in ROWS_ONLY:
        df = QUERIES[name](spark, SF001)
        out[name] = (df.schema, df.collect())
    return out


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs_with_plain_columns(results, name):
    schema, rows = results[name]
    assert all("Vector" not in type(f.dataType).__name__ for f in schema.fields)
    assert len(rows) >= 1


def test_structural_invariants(results):
    lb = results["model_leaderboard"][1]
    assert sorted(r.model for r in lb) == sorted(["knn", "linear_svm", "decision_tree", "random_forest", "boosting",
                                                  "mlp", "adaboost"])
    assert all(0.0 <= r.test_accuracy <= 1.0 for r in lb)
    assert sorted(r.fold for r in results["cv_scores"][1]) == [0, 1, 2, 3, 4]
    assert len(results["learning_curve"][1]) == 10 and [r.max_depth for r in sorted(results["validation_curve"][1])] == list(range(1, 40))
    curves = Counter(r.parameter for r in results["validation_curves_forest"][1])
    assert curves == {"max_depth": 39, "min_samples_split": 27, "max_features": 18, "min_samples_leaf": 22, "n_estimators": 297}
    assert len(results["reducer_comparison"][1]) == 10
    trials = results["space_search"][1]
    assert Counter(r.model for r in trials) == {"forest": 300, "knn": 5, "boosting": 20}
    for m in ("forest", "knn", "boosting"):
        best = [r.best_so_far for r in sorted((r for r in trials if r.model == m), key=lambda r: r.trial)]
        assert best == sorted(best)
    assert sorted({r["rank"] for r in results["grid_search"][1]}) == list(range(1, 1681)) and len(results["grid_search"][1]) == 1680 * 6
    assert Counter(r.model for r in results["random_search"][1]) == {"decision_tree": 100, "sgd": 20, "knn": 6}
    trace = sorted(results["boosting_trace"][1])
    kept = sum(r.kept for r in trace)
    assert 1 < kept and trace[kept - 1].validation_rmse == min(r.validation_rmse for r in trace) and len(trace) in (kept + 10, 1000)
    fs = results["fit_sgd_losses"][1]
    assert {r.model for r in fs} == {"sgd_modified_huber", "sgd_perceptron"}
    assert all(0.0 <= r.score <= 1.0 for r in results["stacking_oof"][1])
