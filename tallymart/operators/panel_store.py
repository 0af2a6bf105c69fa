"""A stored panel and its features, kept up to date month by month.

Both tables are stored in one folder per month. When lines arrive late or are corrected, only the panel months
they fall in are made again, from the lines of these months. Features look back, so they are made again
from the first changed month on; of earlier months they need three rows per store, and one sum and count.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymart.functions.exact_sums import exact_total
from tallymart.operators.features import TIME_ORDER, month_number, store_features
from tallymart.operators.panel import panel_of_places, store_month_panel
from tallymart.session import materialize

Month = tuple[int, int]
_LOOK_BACK = 3


def _in_months(months: Iterable[Month]) -> Column:
    return reduce(or_, [(F.col("year") == y) & (F.col("month") == m) for y, m in months], F.lit(False))


def _months_of(df: DataFrame) -> set[Month]:
    """The months that occur; bounded by the calendar."""
    return {(r.year, r.month) for r in df.select("year", "month").distinct().collect()}


def _stored(spark: SparkSession, path: str) -> DataFrame:
    # Read anew each time: the folders have changed since.
    return spark.read.option("basePath", path).parquet(path)


def _replace(df: DataFrame, path: str, months: Iterable[Month]) -> None:
    """Put the rows of ``months`` in place of those stored; months without rows lose their folder."""
    spark = df.sparkSession
    made = materialize(df, "months")
    hint = made.hint("rebalance", "year", "month")
    hint.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
    context = spark.sparkContext
    for year, month in set(months) - _months_of(made):
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/year={year}/month={month}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def _panel(lines: DataFrame, places: DataFrame | None, **options) -> DataFrame:
    return store_month_panel(lines, **options) if places is None else panel_of_places(lines, places, **options)


def write_panel(lines: DataFrame, path: str, places: DataFrame | None = None, **options) -> None:
    """The panel of all lines (with calendar columns), stored by month. Options are those of the panel.

    With ``places``, lines have the column ``place`` for their store's name, city and county.
    """
    months = _panel(lines, places, **options)
    months.hint("rebalance", "year", "month").write.partitionBy("year", "month").parquet(path)


def changed_months(new_lines: DataFrame) -> set[Month]:
    """The months that lines which came late, were corrected or were taken back fall in."""
    return _months_of(new_lines)


def refresh_panel(
    lines: DataFrame, path: str, months: Iterable[Month], places: DataFrame | None = None, **options
) -> None:
    """Make the stored panel's ``months`` again from all ``lines``, of which only these months are read."""
    months = set(months)
    if months:
        _replace(_panel(lines.where(_in_months(months)), places, **options), path, months)


def write_features(spark: SparkSession, panel_path: str, path: str, **options) -> None:
    """The features of the whole stored panel, stored by month. Options are those of the features."""
    rows = store_features(_stored(spark, panel_path), **options)
    rows.hint("rebalance", "year", "month").write.partitionBy("year", "month").parquet(path)


def refresh_features(
    spark: SparkSession,
    panel_path: str,
    path: str,
    first: Month,
    store: str = "store_name",
    order: Sequence[str] = TIME_ORDER,
    revenue: str = "monthly_revenue",
    **options,
) -> None:
    """Make the stored features again from the month ``first`` on.

    Rows before it are read for their store, order and lagged columns only: the last three of each store
    come before the new rows, and all older ones as one exact sum and count per store. Lags are of rows.
    """
    panel = _stored(spark, panel_path)
    place = month_number()
    start = first[0] * 12 + first[1] - 1
    later = panel.where(place >= start)
    window = Window.partitionBy(store).orderBy(*order)
    older = window.rowsBetween(Window.unboundedPreceding, -1)
    n_rows = F.count(F.lit(1)).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    earlier = panel.where(place < start)
    # The oldest row kept carries what lies before it.
    oldest = F.col("_age") == _LOOK_BACK
    aged = earlier.withColumns({"_age": n_rows - F.row_number().over(window) + 1, "_old_count": F.count(revenue).over(older)})
    aged = aged.withColumn("_old_sum", F.when(oldest, exact_total(earlier, revenue, older)))
    aged = aged.withColumn("_old_count", F.when(oldest, F.col("_old_count")))
    context = materialize(aged.where(F.col("_age") <= _LOOK_BACK).drop("_age"), "feature-context")
    rows = context.unionByName(later, allowMissingColumns=True)
    made = store_features(rows, store=store, order=order, revenue=revenue, carried=("_old_sum", "_old_count"), **options)
    made = made.where(place >= start).drop("_old_sum", "_old_count")
    stored = {m for m in _months_of(_stored(spark, path)) if m >= tuple(first)}
    _replace(made, path, stored | _months_of(later))
