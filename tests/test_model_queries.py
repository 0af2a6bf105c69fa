"""The model queries on the registered data, which no SQL expresses."""

import duckdb
import numpy as np
import pytest
from test_model import newton_logistic
from test_oracle import ROOT, TABLES

from tallymart.operators import evaluate, model, split
from tallymart.operators.features import FEATURES
from tallymart.operators.panel import PANEL_KEYS
from tallymart.plans import duckdb_checks, queries
from tallymart.session import materialize


@pytest.fixture(scope="module")
def sides(spark):
    train, test, _ = split.train_test_split(queries._stored_cohort(spark, ROOT))
    return materialize(train, "train"), materialize(test, "test")


def _matrix(df, mean=None, scale=None):
    rows = sorted(tuple(r) for r in df.select(*PANEL_KEYS, model.LABEL, *FEATURES).collect())
    x = np.array([row[len(PANEL_KEYS) + 1 :] for row in rows], float)
    y = np.array([row[len(PANEL_KEYS)] for row in rows])
    return [row[: len(PANEL_KEYS)] for row in rows], x, y


def test_logistic_scores_equal_a_newton_solution(sides):
    train, test = sides
    _, x, y = _matrix(train)
    beta = newton_logistic((x - x.mean(0)) / x.std(0), y)
    keys, x_test, _ = _matrix(test)
    wanted = 1 / (1 + np.exp(-((x_test - x.mean(0)) / x.std(0) @ beta[:-1] + beta[-1])))
    scores = model.fit_logistic(train).predict(test).collect()
    found = {tuple(r[k] for k in PANEL_KEYS): r.probability for r in scores}
    assert len(found) == len(keys) > 100
    assert [found[k] for k in keys] == pytest.approx(list(wanted), abs=2e-3)


def test_forest_ranks_the_test_rows(sides):
    train, test = sides
    scores = model.fit_forest(train, trees=40).predict(test)
    assert evaluate.auc_roc(scores).first().auc > 0.5  # the test data is close to random


def test_scored_rows_are_the_test_side_of_the_split(sides):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    columns = f"{', '.join(PANEL_KEYS)}, is_top_quartile"
    sql = f"SELECT {columns} FROM ({duckdb_checks.checks()['train_test_split']}) WHERE split = 'test'"
    assert sorted(db.execute(sql).fetchall()) == sorted(tuple(r) for r in sides[1].select(*PANEL_KEYS, model.LABEL).collect())
