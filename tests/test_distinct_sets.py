"""Distinct counts rolled up from stored sets equal counts on the lines."""

import random

import pytest
from pyspark.sql import functions as F

from tallymart.functions.aggregates import n_unique
from tallymart.operators import distinct_sets as ds

MONTH = ["store", "year", "month"]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(2)
    rows = [
        (rng.choice(["a", "b", None]), 2020 + rng.randrange(2), 1 + rng.randrange(12), rng.randrange(500), rng.randrange(3), rng.choice(["x", "y", "z", None]))
        for _ in range(3000)
    ]
    return spark.createDataFrame(rows, "store string, year int, month int, invoice int, line int, item string").repartition(6)


def counted(df, keys, value):
    return sorted(df.groupBy(*keys).agg(n_unique(value).alias("n_distinct")).collect(), key=str)


@pytest.mark.parametrize("keys", [MONTH, ["store", "year"], ["year", "month"], ["year"], []])
def test_rollups_equal_counts_on_lines(lines, keys):
    for value, column in ((["invoice", "line"], F.struct("invoice", "line")), (["item"], F.col("item"))):
        ids = ds.dense_ids(lines, value, near=["year", "month"])
        sets = ds.distinct_sets(lines, MONTH, value, ids)
        got = sorted(ds.set_sizes(sets, keys).collect(), key=str)
        assert got == counted(lines, keys, column)


def test_quarters_from_months(lines):
    ids = ds.dense_ids(lines, ["invoice"], near=MONTH)
    sets = ds.distinct_sets(lines, MONTH, ["invoice"], ids)
    quarter = F.ceil(F.col("month") / 3).alias("quarter")
    got = sorted(ds.set_sizes(sets.withColumn("quarter", quarter), ["year", "quarter"]).collect(), key=str)
    assert got == counted(lines.withColumn("quarter", quarter), ["year", "quarter"], F.col("invoice"))


def test_ids_are_dense_and_near(spark):
    rows = [(1 + i // 1000, 10_000 - i) for i in range(6000)]  # month, and invoices numbered backwards
    df = spark.createDataFrame(rows, "month int, invoice int").repartition(7)
    ids = ds.dense_ids(df, ["invoice"], near=["month"])
    assert sorted(r.id for r in ids.collect()) == list(range(1, 6001))
    months = df.join(ids, "invoice").groupBy("month").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    assert all((r.lo, r.hi) == (1 + 1000 * (r.month - 1), 1000 * r.month) for r in months.collect())


def test_ranges_beyond_one_bitmap(spark):
    df = spark.range(100_000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    sets = ds.distinct_sets(df, ["k"], ["v"], ds.dense_ids(df, ["v"]))
    assert sets.select(ds.RANGE).distinct().count() == 4
    assert ds.set_sizes(sets, []).first().n_distinct == 100_000


def test_unknown_value_fails_and_empty_is_empty(spark, lines):
    ids = ds.dense_ids(lines.where("item = 'x'"), ["item"])
    with pytest.raises(Exception, match="has no id"):
        ds.distinct_sets(lines, MONTH, ["item"], ids).collect()
    nothing = lines.where("false")
    assert ds.distinct_sets(nothing, MONTH, ["item"], ds.dense_ids(nothing, ["item"])).collect() == []


def test_a_small_set_is_small_and_all_bits_of_a_word_count(spark):
    df = spark.range(1, 4001).select(F.floor((F.col("id") - 1) / 8).alias("k"), F.col("id").alias("v"))
    sets = ds.distinct_sets(df, ["k"], ["v"], ds.dense_ids(df, ["v"], near=["k"]))
    widths = sets.agg(F.count("*"), F.max(F.octet_length(F.col(ds.BITS).cast("string")))).first()
    assert widths[0] <= 1000 and widths[1] <= 20  # eight values, at most two words
    assert ds.set_sizes(sets, []).first().n_distinct == 4000
    assert {r.n_distinct for r in ds.set_sizes(sets, ["k"]).collect()} == {8}


def test_least_number_is_found_without_a_sort(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") % 7).alias("v"), F.col("id").alias("place"))
    plans = []
    monkeypatch.setattr(ds, "numbered", lambda values, order, out: plans.append(values) or values.withColumn(out, F.lit(1)))
    ds.dense_ids(df, ["v"], near=["place"])
    assert "SortAggregate" not in plans[0]._jdf.queryExecution().executedPlan().toString()
