"""Models and metrics against independent NumPy calculations."""

import numpy as np
import pytest

from tallymart.operators import evaluate, model
from tallymart.operators.features import FEATURE_LABELS, FEATURES

KEYS = ["id"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1.0, 1000.0, 0.01] + [0.0, 5000.0, 1.0]
    z = 1.5 * x[:, 0] - 0.001 * (x[:, 1] - 5000) - 1.2
    y = (rng.random(400) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(i, *map(float, row), int(label)) for i, (row, label) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, c double, y int")


def newton_logistic(x, y, c=1.0):
    """Minimise c * sum(weight * loss) + |beta|^2 / 2 with a free intercept."""
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    design = np.column_stack([x, np.ones(n)])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = c * design.T @ (weight * (p - y)) + penalty @ beta
        hessian = c * design.T @ (design * (weight * p * (1 - p))[:, None]) + penalty
        beta -= np.linalg.solve(hessian, gradient)
    return beta


def test_logistic_matches_newton(data):
    x, y, df = data
    fit = model.fit_logistic(df, ["a", "b", "c"], "y", KEYS)
    expected = newton_logistic((x - x.mean(0)) / x.std(0), y)
    got = [*fit.model.coefficients.toArray(), fit.model.intercept]
    assert got == pytest.approx(list(expected), abs=1e-4)
    scores = fit.predict(df)
    assert scores.columns == ["id", "a", "b", "c", "y", "prediction", "probability"]
    assert all((r.probability > 0.5) == (r.prediction == 1) for r in scores.collect())


def test_scaler_uses_training_rows_and_leaves_constants_unscaled(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, k double")
    test = spark.createDataFrame([(5.0, 7.0)], "a double, k double")
    scaled = model.Scaler.fit(train, ["a", "k"]).transform(test)
    assert tuple(scaled.first()) == (3.0, 2.0)


def test_balanced_weights_sum_to_the_rows(data):
    _, y, df = data
    weights = {r.y: r.class_weight for r in model.class_weights(df, "y").collect()}
    assert weights[1] == pytest.approx(400 / (2 * y.sum()))
    weighted, n = model.with_class_weight(df, "y")
    assert n == 400
    assert weighted.agg({"class_weight": "sum"}).first()[0] == pytest.approx(400)


def test_forest_finds_the_signal(data):
    _, _, df = data
    fit = model.fit_forest(df, ["a", "b", "c"], "y", KEYS, trees=20)
    assert fit.model.getNumTrees == 20
    importances = {r.feature: r.importance for r in model.feature_importances(fit, df).collect()}
    assert sum(importances.values()) == pytest.approx(1.0)
    assert min(importances, key=importances.get) == "c"
    area = evaluate.auc_roc(fit.predict(df), label="y").first().auc
    assert area > 0.8


def test_importances_have_display_names(data):
    assert set(FEATURES) < set(FEATURE_LABELS)


def brute_auc(scores, labels):
    positive = [s for s, y in zip(scores, labels) if y == 1]
    negative = [s for s, y in zip(scores, labels) if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return wins / (len(positive) * len(negative))


@pytest.mark.parametrize("levels", [2, 5, 10_000])
def test_area_counts_ties_half(spark, levels):
    rng = np.random.default_rng(levels)
    labels = rng.integers(0, 2, 3000)
    scores = (rng.integers(0, levels, 3000) + labels * levels * 0.2) // 1
    rows = [(float(s), int(y)) for s, y in zip(scores, labels)]
    df = spark.createDataFrame(rows, "probability double, is_top_quartile int")
    row = evaluate.auc_roc(df).first()
    assert row.auc == pytest.approx(brute_auc(scores, labels), abs=1e-9)
    assert row.n_positive + row.n_negative == 3000


def test_area_of_one_class_is_null_and_of_a_perfect_ranking_one(spark):
    schema = "probability double, is_top_quartile int"
    one_class = spark.createDataFrame([(0.1, 1), (0.2, 1)], schema)
    assert tuple(evaluate.auc_roc(one_class).first()) == (2, 0, None)
    perfect = spark.createDataFrame([(0.1, 0), (0.9, 1), (0.2, 0)], schema)
    assert evaluate.auc_roc(perfect).first().auc == 1.0


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(0, 0)] * 50 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(1, 1)] * 15
    return spark.createDataFrame(rows, "is_top_quartile int, prediction int")


def test_report(scored):
    rows = {r.row_name: r for r in evaluate.classification_report(scored).collect()}
    bottom, top = rows["Bottom 75%"], rows["Top Quartile"]
    assert (bottom.precision, bottom.recall, bottom.support) == (50 / 55, 50 / 60, 60)
    assert (top.precision, top.recall, top.support) == (0.6, 0.75, 20)
    assert top.f1_score == pytest.approx(2 * 0.6 * 0.75 / 1.35)
    assert (rows["accuracy"].f1_score, rows["accuracy"].precision) == (65 / 80, None)
    assert rows["macro avg"].recall == pytest.approx((50 / 60 + 0.75) / 2)
    assert rows["weighted avg"].precision == pytest.approx((60 * 50 / 55 + 20 * 0.6) / 80)


def test_matrix_and_lift(scored):
    matrix = [tuple(r) for r in evaluate.confusion_matrix(scored).collect()]
    assert matrix == [(0, 50, 10), (1, 5, 15)]
    lift = evaluate.breakout_lift(scored).first()
    assert (lift.n_flagged, lift.n_positive, lift.n_hits) == (25, 20, 15)
    assert (lift.base_rate, lift.precision, lift.recall) == (0.25, 0.6, 0.75)
    assert lift.lift == pytest.approx(2.4)


def test_report_without_positive_predictions_is_zero(spark):
    rows = [(0, 0)] * 3 + [(1, 0)]
    df = spark.createDataFrame(rows, "is_top_quartile int, prediction int")
    top = evaluate.classification_report(df).filter("position = 2").first()
    assert (top.precision, top.recall, top.f1_score, top.support) == (0.0, 0.0, 0.0, 1)
    assert [tuple(r) for r in evaluate.confusion_matrix(df).collect()] == [(0, 3, 0), (1, 1, 0)]


def test_a_forest_keeps_one_number_per_row_and_tree_and_few_rows_a_task(data, monkeypatch):
    _, _, df = data
    dealt = []
    training_set = model._training_set

    def spy(*args):
        dealt.append(training_set(*args))
        return dealt[-1]

    monkeypatch.setattr(model, "_training_set", spy)
    monkeypatch.setattr(model, "FOREST_ROWS_PER_TASK", 20, raising=False)
    fit = model.fit_forest(df, ["a", "b", "c"], "y", KEYS, trees=3, max_depth=3)
    assert dealt[0].rdd.getNumPartitions() == 20
    assert not fit.model.getCacheNodeIds()
