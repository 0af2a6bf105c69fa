"""The exact group quantile against brute force, labels, cohort and split."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallymart.operators import labels, split


def nearest_rank(values, q):
    kept = sorted(v for v in values if v is not None)
    return kept[math.floor((len(kept) - 1) * q + 0.5)] if kept else None


def lower_rank(values, q):
    kept = sorted(v for v in values if v is not None)
    return kept[max(math.ceil(len(kept) * q), 1) - 1] if kept else None


def interpolated(values, q):
    kept = sorted(v for v in values if v is not None)
    if not kept:
        return None
    place = (len(kept) - 1) * q
    low, high = kept[math.floor(place)], kept[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


BRUTE = {"nearest": nearest_rank, "disc": lower_rank, "linear": interpolated}


def _quantiles(spark, groups, q, method="nearest", **options):
    rows = [(key, value) for key, values in groups.items() for value in values]
    df = spark.createDataFrame(rows, "k string, v double")
    out = labels.group_quantile(df, ["k"], "v", q, "x", method, **options)
    return {row.k: row.x for row in out.collect()}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.3, 0.5, 0.6, 0.75, 0.9, 1.0])
def test_small_groups(spark, q):
    rng = random.Random(1)
    groups = {str(n): [float(rng.randint(0, 5)) for _ in range(n)] for n in range(1, 9)}
    groups["ties"] = [2.0] * 5
    groups["nulls"] = [None, 3.0, None, 1.0]
    groups["all null"] = [None, None]
    groups[None] = [4.0, 8.0, 6.0]
    expected = {key: nearest_rank(values, q) for key, values in groups.items()}
    assert _quantiles(spark, groups, q) == expected
    assert _quantiles(spark, groups, q, bounded_groups=True) == expected


@pytest.mark.parametrize("accuracy", [10, 50, 1000])
@pytest.mark.parametrize("q", [0.0, 0.01, 0.3, 0.5, 0.75, 0.99, 1.0])
def test_groups_larger_than_the_accuracy(spark, q, accuracy):
    rng = random.Random(7)
    groups = {
        "spread": [rng.lognormvariate(5, 3) for _ in range(2500)],
        "few values": [float(rng.randint(0, 3)) for _ in range(1200)],
        "one value": [1.5] * 1100,
        "with nulls": [None] * 500 + [rng.gauss(0, 1) for _ in range(1001)],
        "falling": [float(-i) for i in range(1500)],
        "small": [3.0, 1.0, 2.0],
    }
    expected = {key: nearest_rank(values, q) for key, values in groups.items()}
    assert _quantiles(spark, groups, q, accuracy=accuracy) == expected


@pytest.mark.parametrize("method", ["disc", "linear"])
@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_other_methods(spark, monkeypatch, method, q):
    """Small groups, groups past the accuracy, and giant ones whose two ranks may fall in two ranges."""
    monkeypatch.setattr(labels, "MOST_CELLS", 30)
    monkeypatch.setattr(labels, "SPLIT", 4)
    rng = random.Random(5)
    groups = {str(n): [float(rng.randint(0, 5)) for _ in range(n)] for n in range(1, 9)}
    groups |= {"nulls": [None, 3.0, None, 1.0], "all null": [None], None: [4.0, 8.0, 6.0]}
    groups |= {"spread": [rng.lognormvariate(5, 3) for _ in range(3001)], "few": [float(rng.randint(0, 3)) for _ in range(700)]}
    groups |= {f"even {n}": [float(i) for i in range(n)] for n in (200, 400, 401)}
    expected = {key: BRUTE[method](values, q) for key, values in groups.items()}
    assert _quantiles(spark, groups, q, method, accuracy=20) == expected


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="method"):
        labels.group_quantile(spark.range(1), ["id"], "id", 0.5, method="median")


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    values=st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=1, max_size=80),
    q=st.floats(0, 1),
    accuracy=st.sampled_from([5, 20, 1000]),
    method=st.sampled_from(labels.METHODS),
)
def test_any_group(spark, values, q, accuracy, method):
    assert _quantiles(spark, {"g": values}, q, method, accuracy=accuracy) == {"g": BRUTE[method](values, q)}


@pytest.mark.parametrize("q", [0.0, 0.5, 0.77, 1.0])
def test_giant_group_is_narrowed_before_the_last_window(spark, monkeypatch, q):
    """Groups far above the limits, in several passes; others keep their answers."""
    monkeypatch.setattr(labels, "MOST_CELLS", 40)
    monkeypatch.setattr(labels, "SPLIT", 4)
    rng = random.Random(11)
    groups = {
        "giant": [rng.random() for _ in range(6000)],
        None: [rng.lognormvariate(2, 3) for _ in range(900)],
        "small": [3.0, 1.0],
        "none": [None, None],
        "one value": [5.0] * 800,
    }
    expected = {key: nearest_rank(values, q) for key, values in groups.items()}
    assert _quantiles(spark, groups, q, accuracy=20) == expected
    seen = []
    materialize = labels.materialize
    monkeypatch.setattr(labels, "materialize", lambda df, name: seen.append((name, materialize(df, name))) or seen[-1][1])
    _quantiles(spark, groups, q, accuracy=20)
    cells = [df for name, df in seen if name == "quantile-cells"]
    assert len(cells) > 2
    assert max(r["count"] for r in cells[-1].groupBy("_key0").count().collect()) <= 40


def test_quantile_over_many_partitions(spark):
    """One group holds most rows and is spread over many tasks."""
    df = spark.range(200_000, numPartitions=16).selectExpr(
        "if(id % 10 < 7, 'hot', concat('k', id % 10)) AS k", "cast(hash(id) as double) AS v"
    )
    got = {r.k: r.x for r in labels.group_quantile_nearest(df, ["k"], "v", 0.75, "x").collect()}
    values = {}
    for row in df.collect():
        values.setdefault(row.k, []).append(row.v)
    assert got == {key: nearest_rank(group, 0.75) for key, group in values.items()}


def test_bad_quantile(spark):
    with pytest.raises(ValueError):
        labels.group_quantile_nearest(spark.range(1), ["id"], "id", 1.5)


SCHEMA = "store_name string, city string, county string, year int, month int, monthly_revenue double"


def _store(name, revenues, start=(2020, 11)):
    year, month = start
    rows = []
    for revenue in revenues:
        rows.append((name, "C", "X", year, month, revenue))
        year, month = (year, month + 1) if month < 12 else (year + 1, 1)
    return rows


@pytest.fixture(scope="module")
def months(spark):
    rows = _store("A", [9.0, 9.0, 1.0, 9.0]) + _store("B", [1.0, 2.0, 9.0, 1.0])
    rows += _store("C", [2.0, 1.0, 2.0, None])
    return spark.createDataFrame(rows, SCHEMA)


def test_labels_reach_the_month_threshold(months):
    rows = labels.quartile_labels(months).collect()
    got = {(r.store_name, r.month): (r.q75, r.is_top_quartile) for r in rows}
    assert len(rows) == 12
    # Of three values the nearest rank at 0.75 is the highest: round(2 * 0.75) = 2.
    assert got["A", 11] == (9.0, 1) and got["B", 11] == (9.0, 0)
    assert got["B", 1] == (9.0, 1) and got["A", 1] == (9.0, 0)
    assert got["C", 2] == (9.0, None)


def test_cohort_was_below_the_threshold_in_the_row_before(months):
    rows = labels.breakout_labels(months).orderBy("store_name", "year", "month").collect()
    got = [(r.store_name, r.month, r.is_top_quartile) for r in rows]
    assert got == [("A", 2, 1), ("B", 12, 0), ("B", 1, 1), ("C", 12, 0), ("C", 1, 0), ("C", 2, None)]
    assert {r.was_top_quartile_last_month for r in rows} == {0}


def test_split_holds_out_the_last_months_across_a_year_end(months):
    train, test, cutoff = split.train_test_split(months)
    assert cutoff == (2020, 12)
    assert {(r.year, r.month) for r in train.collect()} == {(2020, 11)}
    assert {(r.year, r.month) for r in test.collect()} == {(2020, 12), (2021, 1), (2021, 2)}
    assert train.count() + test.count() == months.count()


def test_too_few_months(months):
    two = months.filter("month > 11 or month = 1")
    with pytest.raises(ValueError, match="2 periods"):
        split.train_test_split(two)
    train, test, _ = split.train_test_split(months.filter("month <> 2"))
    assert (train.count(), test.count()) == (0, 9)


def test_split_summary(months):
    labelled = labels.quartile_labels(months)
    rows = {
        r.split: (r.n_rows, r.positive_rate)
        for r in split.split_summary(split.with_split(labelled, split.Cutoff(2021, 1))).collect()
    }
    assert rows["train"] == (6, pytest.approx(1 / 3))
    assert rows["test"] == (6, pytest.approx(2 / 5))
