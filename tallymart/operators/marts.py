"""Revenue summaries and top-k reports over the sales table.

Every mart is an aggregation that combines in the map tasks before its shuffle, so a key with a
large share of the rows arrives as one partial result per task. Amounts are summed exactly, so a
report does not depend on the partitioning. Ties in a top-k report are broken by the key, which makes
the report deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions.aggregates import n_rows, n_unique, sum_or_zero
from tallymart.functions.calendar import quarter_label
from tallymart.functions.exact_sums import amount_total, exact_total, is_floating
from tallymart.functions.numbers import growth_pct, ratio
from tallymart.functions.text import money_text
from tallymart.operators.categorize import by_category


def _highest_first(df: DataFrame, measure: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.col(measure).desc_nulls_first(), F.col(key).asc_nulls_first()).limit(k)


def sales_summary(
    df: DataFrame,
    revenue: str = "sale_dollars",
    volume: str = "volume_gallons",
    bottles: str = "bottles_sold",
    rows: str | None = None,
) -> DataFrame:
    """One row: revenue, volume, bottles and transactions.

    ``rows`` names the column with the number of transactions where ``df`` holds partial sums.
    """
    return df.agg(
        amount_total(df, revenue).alias("total_revenue"),
        amount_total(df, volume).alias("total_volume_gallons"),
        amount_total(df, bottles).alias("total_bottles"),
        (n_rows() if rows is None else sum_or_zero(F.col(rows))).alias("total_transactions"),
    )


def yearly_summary(
    df: DataFrame,
    year: str = "year",
    revenue: str = "sale_dollars",
    volume: str = "volume_gallons",
    bottles: str = "bottles_sold",
) -> DataFrame:
    """Totals per year, growth over the year before in the table, and mean sale.

    The growth looks back over the whole ordered result. That window has no partition key, which is
    safe only because its input is one row per calendar year.
    """
    yearly = df.groupBy(year).agg(
        amount_total(df, revenue).alias("revenue"),
        amount_total(df, volume).alias("volume_gallons"),
        amount_total(df, bottles).alias("bottles"),
        n_rows().alias("transactions"),
    )
    previous = F.lag("revenue", 1).over(Window.orderBy(year))
    return yearly.withColumns(
        {
            "revenue_growth_pct": growth_pct(F.col("revenue"), previous),
            "avg_transaction_value": ratio(F.col("revenue"), F.col("transactions")),
        }
    ).orderBy(year)


def quarterly_sales(
    df: DataFrame, year: str = "year", quarter: str = "quarter", revenue: str = "sale_dollars"
) -> DataFrame:
    """Revenue per quarter in order, with a ``2022 Q1`` label."""
    quarterly = df.groupBy(year, quarter).agg(amount_total(df, revenue).alias("total_revenue"))
    return quarterly.withColumn("period", quarter_label(F.col(year), F.col(quarter))).orderBy(
        year, quarter
    )


def top_k(
    df: DataFrame, key: str, measure: str, k: int, out: str = "total_revenue"
) -> DataFrame:
    """The ``k`` keys with the highest sum of ``measure``."""
    totals = df.groupBy(key).agg(amount_total(df, measure).alias(out))
    return _highest_first(totals, out, key, k)


def top_categories(
    df: DataFrame, k: int = 10, text: str = "category_name", revenue: str = "sale_dollars"
) -> DataFrame:
    """The ``k`` major categories with the highest revenue."""
    totals = by_category(df, {"total_revenue": exact_total(df, revenue)}, text)
    if is_floating(df, revenue):
        totals = totals.withColumn("total_revenue", F.col("total_revenue").cast("double"))
    return _highest_first(totals, "total_revenue", "major_category", k)


def with_money_text(df: DataFrame, *columns: str) -> DataFrame:
    """Replace amounts by display text such as ``$1,234.50``."""
    return df.withColumns({name: money_text(F.col(name)) for name in columns})


def top_products_revenue(df: DataFrame, k: int = 20) -> DataFrame:
    return top_k(df, "item_description", "sale_dollars", k)


def top_products_volume(df: DataFrame, k: int = 20) -> DataFrame:
    return top_k(df, "item_description", "volume_liters", k, "total_volume")


def top_counties(df: DataFrame, k: int = 15) -> DataFrame:
    return top_k(df, "county", "sale_dollars", k)


def top_cities(df: DataFrame, k: int = 20) -> DataFrame:
    return top_k(df, "city", "sale_dollars", k, "total_sales")


def weekday_weekend(
    df: DataFrame,
    flag: str = "is_weekend",
    date: str = "sale_date",
    revenue: str = "sale_dollars",
) -> DataFrame:
    """Sales, number of distinct days and mean sales per day, for weekdays and weekends."""
    totals = df.groupBy(flag).agg(
        amount_total(df, revenue).alias("total_sales"),
        n_unique(F.col(date)).alias("n_days"),
    )
    return totals.withColumns(
        {
            "avg_daily_sales": ratio(F.col("total_sales"), F.col("n_days")),
            "day_type": F.when(F.col(flag), F.lit("Weekend")).otherwise(F.lit("Weekday")),
        }
    )


def city_efficiency(
    df: DataFrame,
    k: int = 20,
    key: str = "city",
    revenue: str = "sale_dollars",
    invoice: str | Sequence[str] = "invoice_item",
    invoice_is_unique: bool = False,
) -> DataFrame:
    """The ``k`` cities with the highest revenue per distinct invoice line.

    ``invoice`` is one column or several that together name the line. Native keys are cheaper to
    shuffle than a text made of them.

    ``invoice_is_unique`` states that no two rows share an invoice line; then a row count is the
    same number and no shuffle of the invoice column is needed.
    """
    lines = n_rows() if invoice_is_unique else n_unique(F.col(invoice) if isinstance(invoice, str) else F.struct(*invoice))
    totals = df.groupBy(key).agg(
        amount_total(df, revenue).alias("total_sales"), lines.alias("n_transactions")
    )
    per_line = ratio(F.col("total_sales"), F.col("n_transactions"))
    return _highest_first(totals.withColumn("avg_sale_per_txn", per_line), "avg_sale_per_txn", key, k)
