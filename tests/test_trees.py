"""Scores and importances out of the node table equal those of the library that fitted the forest."""

import random
import re
from functools import partial

import pytest
from pyspark.sql import functions as F

from tallymart.operators import model, trees
from tallymart.plans import queries

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        a, b = rng.random(), rng.randrange(5)
        rows.append((i, a, float(b), rng.random(), int(a + 0.2 * b + rng.gauss(0, 0.3) > 1)))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    return df, model.fit_forest(df, ["a", "b", "c"], "y", ["id"], trees=15, max_depth=5, min_leaf=5)


def test_scores_from_nodes(spark, fitted):
    df, fit = fitted
    nodes = trees.forest_nodes(spark, fit)
    got = {r.id: r for r in trees.node_scores(df, nodes, fit.features, ["id"], depth=5).collect()}
    want = fit.predict(df).collect()
    assert len(got) == len(want) == 600
    for r in want:
        assert got[r.id].probability == pytest.approx(r.probability, abs=1e-12)
        assert got[r.id].prediction == r.prediction or abs(r.probability - 0.5) < 1e-12


def test_importances_from_nodes(spark, fitted):
    df, fit = fitted
    got = {r.feature: r.importance for r in trees.node_importances(trees.forest_nodes(spark, fit), fit.features).collect()}
    want = {r.feature: r.importance for r in model.feature_importances(fit, df).collect()}
    assert got.keys() == want.keys() and sum(got.values()) == pytest.approx(1)
    assert all(got[f] == pytest.approx(want[f], abs=1e-12) for f in want)


def test_nodes_form_trees(spark, fitted):
    _, fit = fitted
    nodes = trees.forest_nodes(spark, fit).collect()
    by_place = {(r.tree, r.node): r for r in nodes}
    assert len(by_place) == len(nodes) == fit.model.totalNumNodes
    for r in nodes:
        assert (r.parent is None) == (r.node == 0)
        if not r.is_leaf:
            children = [by_place[r.tree, c] for c in (r.left, r.right)]
            assert all(c.parent == r.node for c in children)
            assert sum(c.weight for c in children) == pytest.approx(r.weight)


def test_walking_looks_features_up_by_number(spark, fitted):
    df, fit = fitted
    nodes = trees.forest_nodes(spark, fit)
    plan = trees.leaves(df, nodes, fit.features, ["id"], depth=2)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"_x#\d+\[number#", plan) and not re.search(r"_x#\d+\[feature#", plan)


def test_too_few_levels_fail(spark, fitted):
    df, fit = fitted
    with pytest.raises(Exception, match="deeper"):
        trees.node_scores(df, trees.forest_nodes(spark, fit), fit.features, ["id"], depth=1).collect()


def test_registered_scores_and_importances(spark, monkeypatch):
    """The model queries on the registered data against the walk over their own forest, of fewer trees."""
    monkeypatch.setattr(model, "fit_forest", partial(model.fit_forest, trees=20))
    want = {tuple(r[:5]): r.probability for r in queries.registry()["forest_scores"](spark, ROOT).collect()}
    got = {tuple(r[:5]): r.probability for r in queries.registry()["forest_node_scores"](spark, ROOT).collect()}
    assert got.keys() == want.keys() and len(got) > 0
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    want = {r.feature: r.importance for r in queries.registry()["feature_importances"](spark, ROOT).collect()}
    got = {r.feature: r.importance for r in queries.registry()["forest_node_importances"](spark, ROOT).select("feature", F.col("importance")).collect()}
    assert got == pytest.approx(want, abs=1e-12)
