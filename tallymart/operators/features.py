"""Strictly backward-looking features over the store-month panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallymart.functions.exact_sums import mean_over, sum_over
from tallymart.functions.numbers import smoothed_change

# Model inputs, in the order the models see them.
FEATURES = (
    "revenue_lag1",
    "revenue_lag2",
    "revenue_lag3",
    "revenue_rolling3",
    "mom_growth_rate",
    "store_avg_revenue",
    "txn_lag1",
    "skus_lag1",
    "month_of_year",
)

# Display names of the model inputs.
FEATURE_LABELS = {
    "revenue_lag1": "Revenue: 1 Month Ago",
    "revenue_lag2": "Revenue: 2 Months Ago",
    "revenue_lag3": "Revenue: 3 Months Ago",
    "revenue_rolling3": "3-Month Rolling Avg Revenue",
    "mom_growth_rate": "Month-over-Month Growth Rate",
    "store_avg_revenue": "Store Historical Avg Revenue",
    "store_std_revenue": "Store Revenue Volatility (Std)",
    "txn_lag1": "Transaction Count: 1 Month Ago",
    "skus_lag1": "Unique SKUs: 1 Month Ago",
    "month_of_year": "Month of Year (Seasonality)",
}

# A store name found in two places has two rows in a month; place decides their order.
TIME_ORDER = ("year", "month", "city", "county")


def trailing_mean(df: DataFrame, column: str, window: WindowSpec, size: int) -> Column:
    """Mean of the ``size`` rows before the current one; NULL unless all are there and non-NULL."""
    frame = window.rowsBetween(-size, -1)
    return F.when(F.count(column).over(frame) == size, mean_over(df, column, frame))


def month_number(year: str = "year", month: str = "month") -> Column:
    """Months since year 0, so that the month before is one less."""
    return F.col(year) * 12 + F.col(month) - 1


def store_features(
    panel: DataFrame,
    store: str = "store_name",
    order: Sequence[str] = TIME_ORDER,
    revenue: str = "monthly_revenue",
    transactions: str | None = "num_transactions",
    skus: str | None = "unique_skus",
    month: str = "month",
    lag: str = "rows",
    carried: tuple[str, str] | None = None,
) -> DataFrame:
    """Lags, trailing and expanding means and growth per store; rows where one of three lags is NULL are left out.

    A lag of ``rows`` looks back over the store's rows, whatever months they are. A lag of ``months`` looks
    at calendar months: last month is the month before this one, NULL if the store sold nothing in it, and
    what the store sold in all its places then. No row is made for a month without sales. The expanding mean
    is over the rows before (of the months before). A lag whose column is None is left out.

    ``carried`` names two columns with the sum and the number of a store's rows that lie before those given
    here, for the expanding mean of the rows after the one that has them; NULL on all others.

    All features share one window, so the plan has one shuffle and one sort. Its groups are panel
    rows, one per month and place of a store: their number follows from the calendar and the map,
    not from how much the store sells.
    """
    if lag not in ("rows", "months"):
        raise ValueError(f"lag must be 'rows' or 'months', not {lag!r}")
    if lag == "rows":
        window = Window.partitionBy(store).orderBy(*order)
        back = lambda column, n: F.lag(F.col(column), n).over(window)
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        trailing = trailing_mean(panel, revenue, window, 3)
    else:
        window = Window.partitionBy(store).orderBy(month_number(order[0], order[1]))
        back = lambda column, n: sum_over(panel, column, window.rangeBetween(-n, -n))
        before = window.rangeBetween(Window.unboundedPreceding, -1)
        # All three months are there, see below; each may have several rows.
        trailing = sum_over(panel, revenue, window.rangeBetween(-3, -1)).cast("double") / F.lit(3.0)
    lags = {f"revenue_lag{n}": back(revenue, n) for n in (1, 2, 3)}
    counts = {
        name: back(column, 1) for name, column in (("txn_lag1", transactions), ("skus_lag1", skus)) if column is not None
    }
    more = [F.sum(c).over(before) for c in carried] if carried else []
    featured = panel.withColumns(
        {
            **lags,
            "revenue_rolling3": trailing,
            "mom_growth_rate": smoothed_change(lags["revenue_lag1"], lags["revenue_lag2"]),
            "store_avg_revenue": mean_over(panel, revenue, before, *more),
            **counts,
            "month_of_year": F.col(month),
        }
    )
    return featured.where(reduce(and_, [F.col(name).isNotNull() for name in lags]))
