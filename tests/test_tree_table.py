"""The node table read from saved files walks to the model's predictions and sums to its importances."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from binlens.operators import models, tree_table


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(0)
    x = np.column_stack([rng.normal(0, 1, 200), rng.randint(0, 3, 200), rng.normal(0, 1, 200)])
    y = (x[:, 0] * x[:, 1] + 0.4 * rng.normal(0, 1, 200) > 0.3).astype(int)
    return spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i].tolist())) for i in range(200)], ["id", "label", "features"]).cache()


def test_walk_gives_the_models_predictions(spark, rows):
    m = models.decision_tree(max_depth=6).fit(rows)
    nodes = tree_table.tree_nodes(spark, m).cache()
    assert nodes.count() == m.numNodes and nodes.where("feature_idx is null").count() == (m.numNodes + 1) // 2
    got = {r.id: r.prediction for r in tree_table.walk(rows, nodes, m.depth).collect()}
    assert got == {r.id: int(r.prediction) for r in m.transform(rows).collect()}


def test_forest_votes_follow_from_the_leaves(spark, rows):
    m = models.random_forest(n_trees=5, max_depth=4).fit(rows)
    nodes = tree_table.tree_nodes(spark, m)
    leaves = {}
    for r in tree_table.walk(rows, nodes, 4).collect():
        leaves.setdefault(r.id, []).append(r.weights[1] / sum(r.weights))
    want = {r.id: r.probability[1] for r in m.transform(rows).collect()}
    assert all(len(v) == 5 and np.mean(v) == pytest.approx(want[i]) for i, v in leaves.items())


def test_gains_by_sql_are_the_importances(spark, rows):
    m = models.decision_tree(max_depth=5).fit(rows)
    got = {r.feature_idx: r.importance for r in tree_table.split_gains(tree_table.tree_nodes(spark, m)).collect()}
    assert [got.get(i, 0.0) for i in range(3)] == pytest.approx(m.featureImportances.toArray().tolist())


def test_a_single_leaf(spark, rows):
    m = models.decision_tree().fit(rows.where("label = 1"))
    nodes = tree_table.tree_nodes(spark, m)
    assert nodes.count() == 1 and tree_table.walk(rows, nodes, 0).where("prediction = 1").count() == 200
