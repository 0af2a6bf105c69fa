"""Aggregates whose treatment of NULL differs from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_or_zero(value: Column) -> Column:
    """Sum that is 0, not NULL, when there is no non-NULL value."""
    return F.coalesce(F.sum(value), F.lit(0))


def n_unique(value: Column) -> Column:
    """Exact distinct count in which NULL counts as one value.

    Spark groups by (keys, value) before it counts, so a key that holds a large share of the rows is
    spread over all tasks.
    """
    has_null = F.coalesce(F.max(value.isNull().cast("bigint")), F.lit(0))
    return F.count_distinct(value) + has_null


def n_rows() -> Column:
    return F.count(F.lit(1))
