"""The forest for many rows against the library's forest on the same draws, and the draws against their definition."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier

from tallymart.operators import evaluate, forest, model, trees

FEATURES = ["a", "b", "c", "constant"]
KEYS = ["id", "place"]
SCHEMA = "id int, place string, a double, b double, c double, constant double, y int"


def _row(i, rng):
    a, b, c = rng.gauss(0, 1), float(rng.randrange(4)), rng.choice([0.0, rng.random() * 1e6])
    return (i, f"p{i % 3}", a, b, c, 7.0, int(a + 0.5 * b + c * 1e-6 + rng.gauss(0, 0.7) > 1.5))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(8)
    return spark.createDataFrame([_row(i, rng) for i in range(3000)], SCHEMA)


def _estimator(**settings):
    named = {"featuresCol": "_features", "labelCol": "y", "weightCol": "class_weight", "maxBins": 128, "minInstancesPerNode": 10}
    return RandomForestClassifier(**named, seed=42, **settings)


def _grown(estimator, df, rows_per_task=200):
    weights = {r.y: r.class_weight for r in model.class_weights(df, "y").collect()}
    dealt = model._dealt(df, KEYS, df.count(), rows_per_task)
    return forest.fit(estimator, df, dealt, FEATURES, KEYS, [weights[0], weights[1]], df.count())


def _node_rows(spark, fitted):
    columns = ["tree", "node", "feature", "threshold", "left", "right", "gain", "weight", "share"]
    nodes = trees.forest_nodes(spark, model.ForestFit(fitted, tuple(FEATURES)))
    return nodes.fillna(-1.0, ["gain"]).select(columns).orderBy("tree", "node").collect()


@pytest.mark.parametrize("depth", [1, 8])
def test_the_tree_without_draws_is_that_of_the_library(spark, data, monkeypatch, depth):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 90)
    estimator = _estimator(numTrees=2, maxDepth=depth, bootstrap=False, featureSubsetStrategy="all")
    weighted, _ = model.with_class_weight(data, "y")
    library = estimator.fit(model._plain_vector(weighted, FEATURES))
    fitted = _grown(estimator, data)
    want, got = _node_rows(spark, library), _node_rows(spark, fitted)
    assert len(got) == len(want) > 2 * depth
    for g, w in zip(got, want):
        assert g[:6] == w[:6]
        assert g[6:] == pytest.approx(w[6:], rel=1e-9)
    assert fitted.getNumTrees == fitted.numClasses == 2
    assert {p.name: v for p, v in fitted.extractParamMap().items()} == {p.name: v for p, v in library.extractParamMap().items()}
    assert list(fitted.featureImportances.toArray()) == pytest.approx(list(library.featureImportances.toArray()))


def test_many_rows_take_the_blocks_and_score_as_well(spark, data, monkeypatch):
    library = model.fit_forest(data, FEATURES, "y", KEYS, trees=30, max_depth=4)
    monkeypatch.setattr(model, "FOREST_MANY_ROWS", 2999)
    monkeypatch.setattr(model, "_training_set", None)  # nothing is kept for the library
    fit = model.fit_forest(data, FEATURES, "y", KEYS, trees=30, max_depth=4)
    nodes = trees.forest_nodes(spark, fit)
    assert nodes.select("tree").distinct().count() == fit.model.getNumTrees == 30
    assert nodes.where("node = 0").select("weight").distinct().count() > 25  # every tree has a bootstrap of its own
    inner = nodes.where("not is_leaf")
    assert inner.where("tree < 20").select("feature").distinct().count() == 3
    assert nodes.where("is_leaf and weight <= 0").count() == 0
    areas = [evaluate.auc_roc(f.predict(data), label="y").first().auc for f in (library, fit)]
    assert areas[1] == pytest.approx(areas[0], abs=0.01) and areas[1] > 0.8
    pairs = zip(*[f.model.featureImportances.toArray() for f in (library, fit)])
    assert all(b == pytest.approx(a, abs=0.05) for a, b in pairs)


def test_a_forest_of_blocks_does_not_depend_on_how_the_rows_lie(spark, data):
    estimator = _estimator(numTrees=3, maxDepth=5, featureSubsetStrategy="sqrt")
    one = _node_rows(spark, _grown(estimator, data))
    other = _node_rows(spark, _grown(estimator, data.repartition(7, "b").orderBy("c")))
    assert one == other


def test_missing_features_fail_and_other_classes_are_left_to_the_library(spark, data, monkeypatch):
    monkeypatch.setattr(model, "FOREST_MANY_ROWS", 10)
    with pytest.raises(Exception, match="b is NULL or NaN"):
        model.fit_forest(data.selectExpr("id", "place", "a", "if(id = 5, null, b) b", "c", "constant", "y"), FEATURES, "y", KEYS, trees=2)
    three = data.selectExpr("id", "place", "a", "b", "c", "constant", "if(id % 9 = 0, 2, y) y")
    assert model.fit_forest(three, FEATURES, "y", KEYS, trees=2, max_depth=2).model.numClasses == 3


def test_bootstrap_counts_are_poisson():
    tables = forest._poisson_tables()
    counts = forest.bootstrap(400_000, *tables, 42, 1, 0, 3, 0)
    assert (counts == forest.bootstrap(400_000, *tables, 42, 1, 0, 3, 0)).all()
    assert (counts != forest.bootstrap(400_000, *tables, 42, 1, 1, 3, 0)).any()
    for k in range(7):
        p = math.exp(-1) / math.factorial(k)
        assert abs((counts == k).mean() - p) < 5 * math.sqrt(p * (1 - p) / 400_000)
    assert counts.max() < 25


def test_picked_features_are_spread_evenly():
    picked = forest.Grown.roots(200, 6, 9, 3, 42).picked.reshape(-1, 3)
    assert (np.diff(picked, axis=1) > 0).all()
    shares = np.bincount(picked.ravel(), minlength=9) / len(picked)
    assert shares == pytest.approx(np.full(9, 1 / 3), abs=0.02)
