"""The shape of the physical plans: what is scanned, shuffled and broadcast."""

import pytest

from tallymart.operators import categorize, clean, features, labels, marts, panel
from tallymart.plans import queries
from tallymart.sources.star import sales

ROOT = "/root/testdata/sf0.001"
LAZY = [
    "column_profile",
    "size_estimate",
    "null_proportions",
    "parse_dates",
    "calendar_features",
    "categorize",
    "categorize_by_lookup",
    "category_distribution",
    "uncategorized_audit",
    "category_mapping_pairs",
    "sales_summary",
    "yearly_summary",
    "quarterly_sales",
    "top_categories",
    "top_categories_display",
    "top_products_revenue",
    "top_products_volume",
    "top_counties",
    "top_cities",
    "weekday_weekend",
    "city_efficiency",
    "store_month_panel",
    "panel_stats",
    "store_features",
    "value_relabel",
    "monthly_thresholds",
    "quartile_labels",
    "breakout_labels",
    "temporal_cutoff",
    "group_quantile_nearest",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Sizes as on large data: nothing is small enough for Spark to broadcast on its own."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# Queries that broadcast one row per calendar month by hint.
HINTED = ("monthly_thresholds", "quartile_labels", "breakout_labels", "temporal_cutoff")


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_no_python_and_no_unbounded_broadcast(spark, no_broadcast, name):
    text = plan(queries.registry()[name](spark, ROOT))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in text
    assert ("BroadcastHashJoin" in text) == (name in HINTED)


def test_joins_follow_the_columns(spark):
    totals = plan(marts.sales_summary(sales(spark, ROOT, ["sale_dollars", "volume_gallons", "bottles_sold"])))
    assert "part.parquet" in totals
    assert not any(f"{t}.parquet" in totals for t in ("orders", "supplier", "nation", "region"))
    daily = plan(marts.quarterly_sales(clean.add_calendar(sales(spark, ROOT, ["sale_date", "sale_dollars"]))))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in daily
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in daily


def test_top_k_keeps_only_k_rows_per_task(spark):
    text = plan(marts.top_cities(sales(spark, ROOT, ["city", "sale_dollars"])))
    assert "TakeOrderedAndProject" in text


def test_rules_run_on_aggregated_texts(spark):
    report = categorize.category_distribution(sales(spark, ROOT, ["category_name"]))
    text = report._jdf.queryExecution().optimizedPlan().toString()
    rules = [line.strip() for line in text.splitlines() if "RLIKE" in line]
    assert len(rules) == 1 and "Aggregate [category_name" in rules[0]


def test_features_take_one_shuffle_over_the_panel(spark):
    schema = """store_name string, city string, county string, year int, month int,
        monthly_revenue double, num_transactions bigint, unique_skus bigint"""
    text = plan(features.store_features(spark.createDataFrame([], schema).repartition(4)))
    assert text.count("Exchange hashpartitioning(store_name") == 1
    assert text.count("Sort [store_name") == 1


def test_unique_invoices_need_no_shuffle_of_invoices(spark):
    lines = clean.add_calendar(sales(spark, ROOT, queries._PANEL_INPUT))
    exact = plan(panel.store_month_panel(lines, invoice=queries.INVOICE))
    assert "Expand" not in exact and "concat" not in exact
    unique = plan(panel.store_month_panel(lines, invoice=queries.INVOICE, invoice_is_unique=True))
    assert "Expand" not in unique and "l_linenumber" not in unique


def test_city_efficiency_expands_no_rows(spark):
    text = plan(queries.city_efficiency(spark, ROOT))
    assert "Expand" not in text and "concat" not in text


SUMMED_FIRST = (
    "sales_summary",
    "top_categories",
    "top_products_revenue",
    "top_products_volume",
    "top_counties",
    "top_cities",
    "category_distribution",
    "uncategorized_audit",
    "category_mapping_pairs",
)


@pytest.mark.parametrize("name", SUMMED_FIRST)
def test_no_line_is_shuffled_by_part_or_supplier(spark, no_broadcast, name):
    """Below every exchange on a foreign key stands a partial aggregate of the lines."""
    text = plan(queries.registry()[name](spark, ROOT)).split("Initial Plan")[-1]
    exchanges = [i for i, line in enumerate(text.splitlines()) if "hashpartitioning(l_partkey" in line or "hashpartitioning(l_suppkey" in line]
    lines = text.splitlines()
    assert exchanges
    for i in exchanges:
        assert any("HashAggregate(keys=[l_" in line for line in lines[i + 1 : i + 3]), lines[i : i + 4]


def test_lookup_leaves_the_lines_in_place(spark):
    lines = sales(spark, ROOT, ["invoice_item", "category_name", "sale_dollars"])
    text = plan(categorize.categorize_by_lookup(lines))
    assert "hashpartitioning(category_name" not in text and "hashpartitioning(coalesce(category_name" not in text


def test_no_task_sorts_a_whole_period(spark):
    """Only counted candidates reach the window of the quantile, not rows."""
    schema = "year int, month int, monthly_revenue double"
    text = plan(labels.monthly_thresholds(spark.createDataFrame([], schema).repartition(4)))
    window = text.index("Window [")
    counting = text.index("partial_count(_x", window)
    assert window < counting
    assert "_cell" in text[window:counting]
