"""Many lines are joined with their orders in tasks of a bounded number of lines, with the same rows."""

import datetime

import pytest

from tallymart.sources import footers, star

LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
COLUMNS = ("order_key", "order_line", "sale_date", "store_name", "city", "sale_dollars")


def written(spark, root, order_keys):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")

    save("lineitem", [(k, i % 4, i % 3, i, 1.0, float(i), "N") for i, k in enumerate(order_keys)], LINE)
    days = [(k, k % 5 if k % 4 else None, datetime.datetime(2020, 1 + k % 12, 1)) for k in [*range(20), 3]]  # 3 twice
    save("orders", days, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp")
    save("supplier", [(0, "a", 0), (1, "b", 1), (1, "b", 1)], "s_suppkey bigint, s_name string, s_nationkey int")
    save("customer", [(0, "c", 0), (1, "d", 1), (2, "d", None), (2, "e", 1)], "c_custkey bigint, c_name string, c_nationkey int")
    save("nation", [(0, "n", 0), (1, "m", 0)], "n_nationkey int, n_name string, n_regionkey int")
    return str(root)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("store", ["supplier", "customer"])
def test_dealt_lines_have_the_same_rows(spark, tmp_path, monkeypatch, store):
    root = written(spark, tmp_path, [i % 23 for i in range(200)])
    want = rows(star.sales(spark, root, COLUMNS, store))
    monkeypatch.setattr(star, "MANY_LINES", 100, raising=False)
    monkeypatch.setattr(star, "LINES_PER_TASK", 15, raising=False)
    dealt = star.sales(spark, root, COLUMNS, store)
    assert "hashpartitioning(l_orderkey#" in (plan := dealt._jdf.queryExecution().executedPlan().toString())
    assert ", 14), REPARTITION_BY_NUM" in plan
    assert rows(dealt) == want


def test_lines_without_an_order_are_not_brought_together(spark, tmp_path, monkeypatch):
    root = written(spark, tmp_path, [i if i < 5 else None for i in range(200)])
    monkeypatch.setattr(star, "MANY_LINES", 100, raising=False)
    plan = star.sales(spark, root, COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan
    assert footers.counted(spark, f"{root}/lineitem.parquet", "l_orderkey") == (200, 5)
