"""Sums that do not depend on the order of addition."""

import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymart.functions.exact_sums import Total, amount_total, exact_total, mean_over
from tallymart.operators import features, marts, panel


def cents(rng):
    return rng.randrange(-(10**7), 10**9) / 100


def lines(spark, seed=1, n=4000):
    rng = random.Random(seed)
    rows = [
        (f"s{rng.randrange(3)}", "c", "k", 2020 + rng.randrange(2), 1 + rng.randrange(12), f"i{rng.randrange(9)}", j, rng.randrange(40), cents(rng), rng.randrange(10**6) / 10**5)
        for j in range(n)
    ]
    names = "store_name string, city string, county string, year int, month int, item_description string, invoice_item int, bottles_sold int, sale_dollars double, volume_liters double"
    return spark.createDataFrame(rows, names), rows


def test_any_partitioning_gives_the_same_bits(spark):
    df, rows = lines(spark)
    wanted = None
    for deal in (df.coalesce(1), df.repartition(2), df.repartition(17, "sale_dollars"), df.orderBy("sale_dollars").coalesce(3)):
        months = panel.store_month_panel(deal)
        featured = features.store_features(months)
        top = marts.top_products_revenue(deal).collect()
        summary = marts.sales_summary(deal, volume="volume_liters").collect()
        got = (sorted(months.collect()), sorted(featured.collect()), top, summary)
        wanted = wanted or got
        assert got == wanted
    exact = sum(Decimal(str(r[8])) for r in rows)
    assert wanted[3][0].total_revenue == float(exact)


def test_floating_sums_do_depend_on_the_order(spark):
    """What the exact sums are for: the plain sum of the same rows differs between orders."""
    df, _ = lines(spark, n=20_000)
    plain = {df.orderBy(order).coalesce(1).agg(F.sum("sale_dollars")).first()[0] for order in ("sale_dollars", "invoice_item", "volume_liters")}
    exact = {df.orderBy(order).coalesce(1).agg(amount_total(df, "sale_dollars")).first()[0] for order in ("sale_dollars", "invoice_item", "volume_liters")}
    assert len(plain) > 1 and len(exact) == 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.decimals(-(10**8), 10**8, places=7)), max_size=8))
def test_equals_decimal_addition(spark, amounts):
    df = spark.createDataFrame([(None if a is None else float(a),) for a in amounts], "x double")
    # float() keeps 15 digits or so: compare with what the doubles say to seven places.
    want = sum((Decimal(repr(float(a))).quantize(Decimal("1e-7")) for a in amounts if a is not None), Decimal(0))
    got = df.agg(exact_total(df, "x")).first()[0]
    assert abs(got - want) <= Decimal("1e-7") * len(amounts)  # a double of 16 digits may round either way
    if all(a is None or a == a.quantize(Decimal("0.01")) for a in amounts):
        assert got == want


def test_in_two_steps(spark):
    df, rows = lines(spark)
    total = Total(df, "sale_dollars", "m")
    per = df.groupBy("month").agg(*[v.alias(k) for k, v in total.partial().items()])
    want = sum(Decimal(str(r[8])) for r in rows)
    assert df.agg(total.exact()).first()[0] == want
    assert per.agg(total.amount_again()).first()[0] == float(want) == df.agg(total.amount()).first()[0]


def test_integers_and_decimals_keep_their_types(spark):
    df = spark.createDataFrame([(1, Decimal("1.10"), 0.5), (2, None, None)], "i int, d decimal(10,2), f float")
    out = df.agg(*[amount_total(df, c).alias(c) for c in df.columns])
    assert dict(out.dtypes) == {"i": "bigint", "d": "decimal(20,2)", "f": "double"}
    assert tuple(out.first()) == (3, Decimal("1.10"), 0.5)
    nothing = df.where("false")
    assert tuple(nothing.agg(*[amount_total(df, c) for c in df.columns]).first()) == (0, 0, 0.0)


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), float("-inf"), 1e13, -3e300])
def test_what_has_no_units_is_added_in_floating_point(spark, odd):
    df = spark.createDataFrame([(1, 1.5), (1, odd), (2, 0.25)], "k int, x double")
    with pytest.raises(Exception, match="x is NaN, infinite"):
        df.agg(exact_total(df, "x")).collect()
    total = Total(df, "x")
    got = {r.k: r.t for r in df.groupBy("k").agg(total.amount().alias("t")).collect()}
    assert repr(got[1]) == repr(1.5 + odd) and got[2] == 0.25
    per = df.groupBy("k").agg(*[v.alias(n) for n, v in total.partial().items()])
    assert repr(per.where("k = 1").agg(total.amount_again()).first()[0]) == repr(1.5 + odd)
    frame = Window.partitionBy("k")
    assert {repr(r[0]) for r in df.where("k = 1").select(mean_over(df, "x", frame)).collect()} == {repr((1.5 + odd) / 2)}


def test_sums_beyond_64_bits_of_units(spark):
    df = spark.range(40).select(F.lit(8e11).alias("x"))
    assert df.agg(exact_total(df, "x")).first()[0] == 32 * 10**12


def test_means_over_frames(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.1, 0.2, 0.3, None, 0.7])], "i int, x double")
    window = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    got = [r[1] for r in df.select("i", mean_over(df, "x", window)).orderBy("i").collect()]
    assert got == [None, 0.1, 0.3 / 2, 0.6 / 3, 0.6 / 3]  # floating-point addition gives 0.30000000000000004 and 0.6000000000000001
