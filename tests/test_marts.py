"""Marts on small frames: ties, NULL keys, gaps and totals."""

import datetime

import pytest

from tallymart.operators import clean, marts, panel

SCHEMA = """invoice_item string, sale_date date, store_name string, city string, county string,
    category_name string, item_description string, bottles_sold smallint, sale_dollars double,
    volume_liters double, volume_gallons double"""


def _day(year, month, day):
    return datetime.date(year, month, day)


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        ("i1", _day(2020, 1, 6), "S", "A", "X", "VODKA", "v", 1, 100.0, 1.0, 0.3),
        ("i1", _day(2020, 1, 6), "S", "A", "X", "VODKA", "v", 1, 100.0, 1.0, 0.3),
        ("i2", _day(2020, 5, 1), "S", "B", "X", "GIN", "g", 2, 200.0, 2.0, 0.6),
        (None, _day(2022, 2, 4), "T", None, "Y", None, None, 3, 50.0, None, 0.9),
        (None, _day(2022, 2, 7), "T", None, "Y", None, None, 3, None, 3.0, 0.9),
    ]
    return clean.add_calendar(spark.createDataFrame(rows, SCHEMA)).cache()


def test_summary(sales):
    row = marts.sales_summary(sales).first()
    assert (row.total_revenue, row.total_bottles, row.total_transactions) == (450.0, 10, 5)
    assert row.total_volume_gallons == pytest.approx(3.0)


def test_summary_of_nothing_is_zero(sales):
    assert tuple(marts.sales_summary(sales.filter("false")).first()) == (0.0, 0.0, 0, 0)


def test_growth_looks_back_to_the_year_before_in_the_table(sales):
    rows = marts.yearly_summary(sales).collect()
    assert [row.year for row in rows] == [2020, 2022]
    assert [row.revenue_growth_pct for row in rows] == [None, -87.5]
    assert rows[1].avg_transaction_value == 25.0


def test_quarters(sales):
    rows = marts.quarterly_sales(sales).collect()
    assert [(row.period, row.total_revenue) for row in rows] == [
        ("2020 Q1", 200.0),
        ("2020 Q2", 200.0),
        ("2022 Q1", 50.0),
    ]


def test_ties_are_broken_by_key_and_null_is_a_key(sales):
    rows = [tuple(row) for row in marts.top_cities(sales).collect()]
    assert rows == [("A", 200.0), ("B", 200.0), (None, 50.0)]
    assert [tuple(row) for row in marts.top_cities(sales, 1).collect()] == [("A", 200.0)]


def test_top_reports_add_up_to_the_total(sales):
    for report in (
        marts.top_categories(sales),
        marts.top_products_revenue(sales),
        marts.top_counties(sales),
        marts.top_cities(sales),
        marts.quarterly_sales(sales),
    ):
        measure = "total_sales" if "total_sales" in report.columns else "total_revenue"
        assert sum(row[measure] for row in report.collect()) == 450.0


def test_volume_and_display(sales):
    assert marts.top_products_volume(sales).first().total_volume == 3.0
    shown = marts.with_money_text(marts.top_categories(sales), "total_revenue").collect()
    assert [row.total_revenue for row in shown] == ["$200.00", "$200.00", "$50.00"]


def test_days_are_counted_once(sales):
    rows = {row.day_type: row for row in marts.weekday_weekend(sales).collect()}
    assert (rows["Weekday"].n_days, rows["Weekday"].total_sales) == (2, 200.0)
    assert rows["Weekday"].avg_daily_sales == 100.0
    assert (rows["Weekend"].n_days, rows["Weekend"].total_sales) == (2, 250.0)


def test_efficiency_counts_invoice_lines_once_and_null_as_one(sales):
    rows = [tuple(row) for row in marts.city_efficiency(sales).collect()]
    assert rows == [("A", 200.0, 1, 200.0), ("B", 200.0, 1, 200.0), (None, 50.0, 1, 50.0)]
    by_rows = [tuple(row) for row in marts.city_efficiency(sales, invoice_is_unique=True).collect()]
    assert by_rows == [("B", 200.0, 1, 200.0), ("A", 200.0, 2, 100.0), (None, 50.0, 2, 25.0)]


def test_panel(sales):
    rows = {(row.store_name, row.year, row.month): row for row in panel.store_month_panel(sales).collect()}
    january = rows["S", 2020, 1]
    assert (january.monthly_revenue, january.avg_transaction_value) == (200.0, 100.0)
    assert (january.num_transactions, january.unique_skus, january.total_bottles) == (1, 1, 2)
    february = rows["T", 2022, 2]
    assert (february.monthly_revenue, february.avg_transaction_value) == (50.0, 50.0)
    assert (february.num_transactions, february.unique_skus, february.total_liters) == (1, 1, 3.0)


def test_panel_without_some_measures(sales):
    small = panel.store_month_panel(sales, invoice=None, item=None, bottles=None, liters=None)
    assert small.columns == [*panel.PANEL_KEYS, "monthly_revenue", "avg_transaction_value"]


def test_panel_stats(sales):
    row = panel.panel_stats(panel.store_month_panel(sales)).first()
    assert tuple(row) == (3, 2, 2020, 1, 2022, 2)
