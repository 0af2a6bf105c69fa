"""Lines with numbers for texts and marked invoices give the panel that the texts themselves give."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallymart.operators import clean, features, panel
from tallymart.plans import queries
from tallymart.sources import star

LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"


def written(spark, root, order_keys):
    """Keys and names that repeat, are NULL or have no row; orders over 24 months from 1997 on."""

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")

    none = lambda key, n: None if key == n else key
    line = lambda i, k: (k, none(i % 11, 10), none(i % 9, 8), i % 2, 1.0 + i % 3, i / 4, "RN"[i % 5 > 1])
    save("lineitem", [line(i, k) for i, k in enumerate(order_keys)] * 2, LINE)
    days = [(k, k % 5, datetime.datetime(1997 + k % 24 // 12, 1 + k % 12, 1)) for k in [*range(40), 3]]  # 3 twice
    save("orders", days, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp")
    stores = [(0, "a", 0), (1, "a", 0), (2, "a", 1), (3, None, 0), (4, None, None), (5, "b", 2), (5, "c", 2), (6, "b", 9)]
    save("supplier", [*stores, stores[2]], "s_suppkey bigint, s_name string, s_nationkey int")
    parts = [(0, "x", 1), (1, "x", 2), (2, "y", 3), (3, None, 4), (4, "z", None), (5, "z", 6), (5, "w", 7), (5, "w", 7)]
    save("part", [(k, n, "Brand#1", "T", size, 1.0) for k, n, size in parts], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    save("nation", [(0, "n", 0), (1, "m", 0), (2, "n", 1), (2, "n", 1)], "n_nationkey int, n_name string, n_regionkey int")
    save("region", [(0, "r"), (1, None)], "r_regionkey int, r_name string")
    return str(root)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


ORDERS = [i * 7 % 45 for i in range(400)]  # some have no row


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("keyed"), ORDERS)


@pytest.mark.parametrize("dealt", [False, True])
def test_panel_of_numbers(spark, root, monkeypatch, dealt):
    if dealt:
        monkeypatch.setattr(star, "MANY_LINES", 100)
        monkeypatch.setattr(star, "LINES_PER_TASK", 15)
    want = panel.store_month_panel(clean.add_calendar(star.sales(spark, root, queries._PANEL_INPUT)), invoice=queries.INVOICE)
    lines, places = star.keyed_sales(spark, root)
    lines = clean.add_calendar(lines).withColumn("late", F.expr("store_location is null"))
    lines = panel.mark_invoices(lines, "late", ("place", "year", "month"), queries.INVOICE)
    got = panel.panel_of_places(lines, places, item="item", invoice_mark="invoice_mark")
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert rows(got) == rows(want)


def test_refreshed_panel_on_repeated_and_missing_keys(spark, root, tmp_path):
    dated = tmp_path / "dated"
    whole = written(spark, dated, [k for k in ORDERS if k < 40])
    lines = clean.add_calendar(star.sales(spark, whole, queries._PANEL_INPUT))
    want = queries._rounded_features(features.store_features(panel.store_month_panel(lines, invoice=queries.INVOICE)))
    got = queries.refreshed_panel(spark, whole)
    assert want.count() > 50
    assert rows(got.select(*sorted(want.columns))) == rows(want.select(*sorted(want.columns)))


def test_stored_lines_have_no_texts_and_invoices_are_marked_where_the_orders_are_joined(spark, root, monkeypatch):
    monkeypatch.setattr(star, "MANY_LINES", 100)
    monkeypatch.setattr(star, "LINES_PER_TASK", 15)
    kept, materialize = {}, queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, name: kept.setdefault(name, df) and materialize(df, name))
    queries.refreshed_panel(spark, root)
    stored = kept["panel-lines"]
    assert "string" not in dict(stored.dtypes).values()
    plan = stored._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("Window") : plan.index("Join ")]
    assert "Exchange" not in above


def test_lines_without_an_order_are_spread(spark, tmp_path, monkeypatch):
    lines, _ = star.keyed_sales(spark, written(spark, tmp_path, [i if i < 5 else None for i in range(200)]))
    marked = panel.mark_invoices(lines.withColumn("late", F.lit(False)), "late", ("place",), queries.INVOICE)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("Window") : plan.index("Join ")]
    assert above.count("Exchange hashpartitioning(order_key#") == 1 and "order_line#" in above.split("hashpartitioning(")[1].split(")")[0]


def test_marks_count_invoices_of_all_rows_and_of_those_not_late(spark):
    some = [(k % 3 or None, k % 4 or None, k % 5, [False, True, None][k % 7 % 3]) for k in range(200)]
    lines = spark.createDataFrame(some, "store int, order_key int, line int, late boolean")
    marked = panel.mark_invoices(lines, "late", ["store"], ["order_key", "line"])
    for chosen in ("true", "late is not null", "not late"):
        part = marked.where(chosen)
        got = part.groupBy("store").agg(F.sum("invoice_mark"))
        want = part.select("store", "order_key", "line").distinct().groupBy("store").count()
        assert rows(got) == rows(want)
