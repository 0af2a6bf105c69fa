"""Ratios and growth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, on_zero: str = "null") -> Column:
    """``numerator / denominator`` as double.

    Division by zero is NULL by default; ``on_zero="ieee"`` gives inf, -inf or NaN as floating-point
    engines do. Neither fails under ANSI mode.
    """
    top, bottom = numerator.cast("double"), denominator.cast("double")
    quotient = F.try_divide(top, bottom)
    if on_zero == "null":
        return quotient
    if on_zero == "ieee":
        at_zero = (
            F.when(top > 0, F.lit(float("inf")))
            .when(top < 0, F.lit(float("-inf")))
            .when(top == 0, F.lit(float("nan")))
        )
        return F.when(bottom == 0, at_zero).otherwise(quotient)
    raise ValueError(f"on_zero must be 'null' or 'ieee', not {on_zero!r}")


def growth_pct(current: Column, previous: Column, on_zero: str = "null") -> Column:
    """Change from ``previous`` to ``current`` in percent of ``previous``."""
    return ratio(current - previous, previous, on_zero) * F.lit(100.0)


def smoothed_change(current: Column, previous: Column, epsilon: float = 1e-9) -> Column:
    """Relative change with a small constant in the denominator, so a zero base stays finite."""
    return F.try_divide(current - previous, previous + F.lit(epsilon))
