"""Column functions and aggregates on small literal frames."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tallymart.functions.aggregates import n_unique, sum_or_zero
from tallymart.functions.calendar import calendar_columns, parse_date, quarter_label
from tallymart.functions.numbers import growth_pct, ratio, smoothed_change
from tallymart.functions.text import money_text, relabel


def _column(df):
    return [row[0] for row in df.collect()]


def test_dates_with_and_without_leading_zero(spark):
    df = spark.createDataFrame([("01/02/2022",), ("1/2/2022",), (None,)], "d string")
    day = datetime.date(2022, 1, 2)
    assert _column(df.select(parse_date(F.col("d")))) == [day, day, None]


def test_bad_date_fails_or_is_null(spark):
    df = spark.createDataFrame([("2022-01-02",)], "d string")
    with pytest.raises(Exception, match="(?i)parse|datetime"):
        df.select(parse_date(F.col("d"))).collect()
    assert _column(df.select(parse_date(F.col("d"), mode="lenient"))) == [None]
    with pytest.raises(ValueError):
        parse_date(F.col("d"), mode="other")


def test_calendar_of_one_week(spark):
    # 2022-01-03 is a Monday.
    days = [(datetime.date(2022, 1, 3) + datetime.timedelta(n),) for n in range(7)]
    df = spark.createDataFrame(days, "d date").withColumns(calendar_columns(F.col("d")))
    rows = df.orderBy("d").collect()
    assert [row.weekday for row in rows] == [1, 2, 3, 4, 5, 6, 7]
    assert [row.is_weekend for row in rows] == [False] * 4 + [True] * 3
    assert {(row.year, row.month, row.quarter) for row in rows} == {(2022, 1, 1)}


def test_weekend_can_start_on_saturday(spark):
    df = spark.createDataFrame([(datetime.date(2022, 1, 7),)], "d date")
    assert _column(df.select(calendar_columns(F.col("d"), 6)["is_weekend"])) == [False]


def test_quarter_label(spark):
    df = spark.createDataFrame([(2022, 1)], "y int, q int")
    assert _column(df.select(quarter_label(F.col("y"), F.col("q")))) == ["2022 Q1"]


def test_ratio_by_zero(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (None,)], "x double")
    assert _column(df.select(ratio(F.col("x"), F.lit(0)))) == [None] * 4
    ieee = _column(df.select(ratio(F.col("x"), F.lit(0), on_zero="ieee")))
    assert ieee[:2] == [math.inf, -math.inf] and math.isnan(ieee[2]) and ieee[3] is None
    assert _column(df.select(ratio(F.col("x"), F.lit(2), on_zero="ieee")))[:2] == [0.5, -0.5]
    with pytest.raises(ValueError):
        ratio(F.col("x"), F.col("x"), on_zero="other")


def test_growth(spark):
    df = spark.createDataFrame([(150.0, 100.0), (1.0, 0.0), (1.0, None)], "now double, before double")
    assert _column(df.select(growth_pct(F.col("now"), F.col("before")))) == [50.0, None, None]


def test_smoothed_change_of_zero_base_is_finite(spark):
    df = spark.createDataFrame([(5.0, 0.0), (15.0, 10.0)], "now double, before double")
    got = _column(df.select(smoothed_change(F.col("now"), F.col("before"))))
    assert got == pytest.approx([5e9, 0.5])


def test_money_text(spark):
    amounts = [(0.125,), (2.675,), (1234567.005,), (-5.0,), (None,)]
    df = spark.createDataFrame(amounts, "x double")
    got = _column(df.select(money_text(F.col("x"))))
    assert got[1:] == ["$2.67", "$1,234,567.00", "$-5.00", None]
    assert got[0] == "$0.12"


def test_relabel_passes_unknown_values_through(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert _column(df.select(relabel(F.col("x"), {"a": "Apple"}))) == ["Apple", "b", None]
    assert _column(df.select(relabel(F.col("x"), {}))) == ["a", "b", None]


def test_null_counts_as_one_distinct_value(spark):
    df = spark.createDataFrame(
        [("k", "a"), ("k", "a"), ("k", None), ("k", None), ("m", None), ("n", "b"), (None, "c")],
        "k string, v string",
    )
    got = {row.k: row.n for row in df.groupBy("k").agg(n_unique(F.col("v")).alias("n")).collect()}
    assert got == {"k": 2, "m": 1, "n": 1, None: 1}
    assert _column(df.filter("false").agg(n_unique(F.col("v")))) == [0]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("k", None), ("m", 2.0)], "k string, v double")
    got = {row.k: row.s for row in df.groupBy("k").agg(sum_or_zero(F.col("v")).alias("s")).collect()}
    assert got == {"k": 0.0, "m": 2.0}
