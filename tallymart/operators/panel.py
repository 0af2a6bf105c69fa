"""Transactions to one row per store and month."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions.aggregates import n_rows, n_unique
from tallymart.functions.exact_sums import Total
from tallymart.functions.numbers import ratio

PANEL_KEYS = ("store_name", "city", "county", "year", "month")


def store_month_panel(
    df: DataFrame,
    keys: Sequence[str] = PANEL_KEYS,
    revenue: str = "sale_dollars",
    invoice: str | Sequence[str] | None = "invoice_item",
    item: str | None = "item_description",
    bottles: str | None = "bottles_sold",
    liters: str | None = "volume_liters",
    invoice_is_unique: bool = False,
    invoice_mark: str | None = None,
) -> DataFrame:
    """Revenue, mean sale, distinct invoice lines and items, bottles and liters per key.

    A measure whose column is None is left out. ``invoice`` is one column or several that together
    name the line. NULL counts as one item and one invoice. Amounts are summed exactly and the mean is one
    division, so the panel has the same bits from every partitioning.

    Sums are taken per (keys, item) first, so the number of items is the number of partial rows.
    Distinct invoices are counted in a branch of their own and joined on the keys. Both shuffle on
    the keys and a value, which spreads a store with a large share of the rows over all tasks, and
    no row is expanded. With ``invoice_is_unique`` (no two rows share an invoice line) the row count
    takes the place of that branch. So does the sum of ``invoice_mark``, a column made by :func:`mark_invoices`.
    """
    sums = {"monthly_revenue": revenue, "total_bottles": bottles, "total_liters": liters}
    totals = {name: Total(df, column, f"_{name}") for name, column in sums.items() if column is not None}
    partial = {part: value for total in totals.values() for part, value in total.partial().items()}
    partial["_n_revenue"] = F.count(revenue)
    partial["_n_rows"] = n_rows() if invoice_mark is None else F.sum(invoice_mark)
    per_item = df.groupBy(*keys, *([item] if item is not None else []))
    per_item = per_item.agg(*[value.alias(name) for name, value in partial.items()])
    rows = per_item.groupBy(*keys).agg(
        *[total.amount_again().alias(name) for name, total in totals.items()],
        ratio(totals["monthly_revenue"].amount_again(), F.sum("_n_revenue")).alias("avg_transaction_value"),
        F.sum("_n_rows").alias("num_transactions"),
        n_rows().alias("unique_skus"),
    )
    if invoice is not None and not invoice_is_unique and invoice_mark is None:
        columns = [invoice] if isinstance(invoice, str) else list(invoice)
        counted = df.select(*keys, *columns).distinct().groupBy(*keys).agg(n_rows().alias("_n_invoices"))
        counted = counted.withColumnsRenamed({key: f"_{key}" for key in keys})
        same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
        rows = rows.join(counted, same).withColumn("num_transactions", F.col("_n_invoices"))
    measures = ["monthly_revenue", "avg_transaction_value"]
    measures += ["num_transactions"] * (invoice is not None) + ["unique_skus"] * (item is not None)
    return rows.select(*keys, *measures, *[name for name in totals if name != "monthly_revenue"])


def mark_invoices(
    df: DataFrame,
    late: str,
    keys: Sequence[str] = PANEL_KEYS,
    invoice: str | Sequence[str] = "invoice_item",
    mark: str = "invoice_mark",
) -> DataFrame:
    """``mark`` is 1 on one row of each invoice line of a key and 0 on the others, so its sum counts invoice lines.

    Rows where ``late`` is false are marked first, then true, then NULL. So the sum also holds for the rows that
    are not late alone. Rows that lie by a column of ``invoice`` already are not shuffled.
    """
    columns = [invoice] if isinstance(invoice, str) else list(invoice)
    window = Window.partitionBy(*columns, *keys).orderBy(F.col(late).asc_nulls_last())
    return df.withColumn(mark, (F.row_number().over(window) == 1).cast("int"))


def panel_of_places(lines: DataFrame, places: DataFrame, place: str = "place", **options) -> DataFrame:
    """The panel of lines that have a number for their store's name, city and county; ``places`` has both.

    Lines are summed by the number, and the names joined to the panel. Options are those of the panel.
    """
    rows = store_month_panel(lines, keys=(place, "year", "month"), **options)
    measures = [c for c in rows.columns if c not in (place, *PANEL_KEYS)]
    return rows.join(places, place, "left").select(*PANEL_KEYS, *measures)


def panel_stats(
    panel: DataFrame, store: str = "store_name", year: str = "year", month: str = "month"
) -> DataFrame:
    """One row: panel rows, distinct stores, first and last month."""
    period = F.struct(F.col(year).alias("y"), F.col(month).alias("m"))
    stats = panel.agg(
        n_rows().alias("n_rows"),
        n_unique(F.col(store)).alias("n_stores"),
        F.min(period).alias("first"),
        F.max(period).alias("last"),
    )
    return stats.select(
        "n_rows",
        "n_stores",
        F.col("first.y").alias("first_year"),
        F.col("first.m").alias("first_month"),
        F.col("last.y").alias("last_year"),
        F.col("last.m").alias("last_month"),
    )
