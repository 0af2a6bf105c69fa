"""Running sums, numbers and lags over a global order."""

import random

import pytest
from pyspark.sql import functions as F

from tallymart.operators import evaluate, prefix


@pytest.fixture(params=[1, 7, 40])
def partitions(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark, n=900):
    rng = random.Random(4)
    rows = [(i, rng.randrange(30), rng.choice([None, *range(-5, 9)])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id int, k int, v int").repartition(5), sorted(rows, key=lambda r: (-r[1], r[0]))


def order():
    return [F.col("k").desc(), F.col("id")]


def test_running_sums(spark, partitions):
    df, rows = table(spark)
    got = {r.id: (r.upto, r.n) for r in prefix.running_sums(df.withColumn("one", F.lit(1)), order(), {"upto": "v", "n": "one"}).collect()}
    total = 0
    for place, (i, _, v) in enumerate(rows, 1):
        total += v or 0
        assert got[i] == (total, place)


def test_numbers_and_lags(spark, partitions):
    df, rows = table(spark)
    place = {r.id: r.row_number for r in prefix.numbered(df, order()).collect()}
    assert [place[r[0]] for r in rows] == list(range(1, len(rows) + 1))
    for n in (1, 3, 2000):
        lagged = prefix.ordered_lag(df, order(), "v", n)
        assert lagged.columns == ["id", "k", "v", f"v_lag{n}"]
        got = {r.id: r[f"v_lag{n}"] for r in lagged.collect()}
        assert all(got[r[0]] == (rows[i - n][2] if i >= n else None) for i, r in enumerate(rows))
    with pytest.raises(ValueError):
        prefix.ordered_lag(df, order(), "v", 0)


def test_empty(spark):
    df, _ = table(spark)
    assert prefix.running_sums(df.where("false"), ["id"], {"s": "v"}).collect() == []
    assert prefix.ordered_lag(df.where("false"), ["id"], "v").collect() == []


def test_no_task_holds_all_rows(spark, partitions):
    """The only window without a key is over one row per partition."""
    df, _ = table(spark)
    plan = prefix.running_sums(df, order(), {"s": "v"})._jdf.queryExecution().executedPlan().toString()
    single = plan.count("SinglePartition")
    assert plan.count("Window [") == 2 and single <= 1


def test_auc_equals_all_pairs(spark, partitions):
    rng = random.Random(9)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(700)]
    won = sum((p > n) + (p == n) / 2 for p, y in rows if y for n, z in rows if not z)
    pos = sum(y for _, y in rows)
    row = evaluate.auc_roc(spark.createDataFrame(rows, "probability double, is_top_quartile int")).first()
    assert (row.n_positive, row.n_negative) == (pos, 700 - pos)
    assert row.auc == won / (pos * (700 - pos))
