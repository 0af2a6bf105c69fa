"""Sums and means of amounts that do not depend on the order of addition.

A floating-point amount is counted in whole units of 10**-SCALE, which is exact for amounts of up to SCALE
decimal places. The units are summed in two parts, the low bits and the rest, both as 64-bit integers in
generated code, and put together as one decimal per group. A mean divides once, at the end. So every
partitioning, and every engine that adds decimals, gives the same bits.

Amounts that cannot be counted so (NaN, infinite, or of 9e11 and more) are added in floating point, as Spark
does it, and make the sum what that gives. Under ANSI mode, Spark 4's default, sums whose parts pass 64 bits
(from about 1e18 on, or more than 8e12 rows) are an error. Integers and decimals are summed as they are.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tallymart.functions.columns import exact

SCALE = 7
LOW_BITS = 20
MOST = 9e11

# Metadata of a decimal column that holds exact sums of floating-point amounts.
FLOATING = {"floating": True}

_PARTS = ("high", "low", "rest")


def _parts(value: Column) -> tuple[Column, Column, Column]:
    """High and low part of the units, and the amount where it has none."""
    value = value.cast("double")
    fits = F.abs(value) < F.lit(MOST)  # NaN is larger than any number
    units = F.rint(F.when(fits, value) * F.lit(10.0**SCALE)).cast("bigint")
    return F.shiftright(units, LOW_BITS), units.bitwiseAND(F.lit((1 << LOW_BITS) - 1)), F.when(~fits, value)


def _joined(high: Column, low: Column) -> Column:
    """decimal(38,7) of the two summed parts; NULL where nothing was summed."""
    units = high.cast("decimal(22,0)") * F.lit(Decimal(1 << LOW_BITS)) + low.cast("decimal(20,0)")
    return units.cast("decimal(30,0)") * F.lit(Decimal(1).scaleb(-SCALE))


def _with_rest(total: Column, rest: Column) -> Column:
    """An exact total as double, with the floating-point sum of what it leaves out."""
    total = total.cast("double")
    return F.when(rest.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + rest)


def is_floating(df: DataFrame, name: str) -> bool:
    """Whether a column is floating-point, or holds exact sums of one."""
    field = df.schema[name]
    return isinstance(field.dataType, (DoubleType, FloatType)) or bool(field.metadata.get("floating"))


class Total:
    """The exact sum of one column, in one aggregation or in two.

    ``exact`` and ``amount`` sum the column. ``partial`` gives the aggregates of a first aggregation, under names
    that begin with ``name``, and ``amount_again`` the sum of those. A sum of nothing is 0. An amount is a double
    where the column is floating-point, or sums of one; else it has the type of Spark's sum.
    """

    def __init__(self, df: DataFrame, column: str, name: str | None = None):
        self.in_parts = isinstance(df.schema[column].dataType, (DoubleType, FloatType))
        self.floating = is_floating(df, column)
        self.column = exact(column)
        self.name = name or column

    def _sums(self, over: WindowSpec | None = None) -> list[Column]:
        sums = [F.sum(part) for part in (_parts(self.column) if self.in_parts else (self.column,))]
        return sums if over is None else [s.over(over) for s in sums]

    def _amount(self, sums: list[Column]) -> Column:
        if self.in_parts:
            high, low, rest = sums
            return _with_rest(_joined(high, low), rest)
        return sums[0].cast("double") if self.floating else sums[0]

    def exact(self, frame: WindowSpec | None = None) -> Column:
        """Decimal, for a further sum; an amount that has no place in it fails the query."""
        sums = self._sums(frame)
        if not self.in_parts:
            return F.coalesce(sums[0], F.lit(0))
        high, low, rest = sums
        none = F.raise_error(F.lit(f"{self.name} is NaN, infinite, or {MOST:g} or more in some rows")).cast("decimal(38,7)")
        return F.when(rest.isNotNull(), none).otherwise(F.coalesce(_joined(high, low), F.lit(0)))

    def amount(self) -> Column:
        return F.coalesce(self._amount(self._sums()), F.lit(0))

    def partial(self) -> dict[str, Column]:
        return {f"{self.name}_{part}": value for part, value in zip(_PARTS, self._sums())}

    def amount_again(self) -> Column:
        names = _PARTS if self.in_parts else _PARTS[:1]
        return F.coalesce(self._amount([F.sum(f"{self.name}_{part}") for part in names]), F.lit(0))

    def over(self, frame: WindowSpec, more: Column | None = None) -> Column:
        """The amount of a window frame, NULL if it has none; ``more`` is added exactly."""
        sums = self._sums(frame)
        if more is not None:
            if self.in_parts:
                high, low, rest = sums
                return _with_rest(F.coalesce(_joined(high, low), F.lit(0)) + F.coalesce(more, F.lit(0)), rest)
            sums[0] = F.coalesce(sums[0], F.lit(0)) + F.coalesce(more, F.lit(0))
        return self._amount(sums)


def exact_total(df: DataFrame, column: str, frame: WindowSpec | None = None) -> Column:
    """The sum of a column (of a window frame) as decimal (floating-point and decimal columns) or integer, 0 for nothing."""
    return Total(df, column).exact(frame)


def amount_total(df: DataFrame, column: str) -> Column:
    """The sum of a column, as double for a floating-point column, 0 for nothing."""
    return Total(df, column).amount()


def sum_over(df: DataFrame, column: str, frame: WindowSpec) -> Column:
    """Exact sum of a window frame, NULL where it has no non-NULL value; double for a floating-point column."""
    return Total(df, column).over(frame)


def mean_over(
    df: DataFrame, column: str, frame: WindowSpec, more_sum: Column | None = None, more_count: Column | None = None
) -> Column:
    """Mean of the non-NULL values of a window frame, one division of an exact sum.

    ``more_sum`` and ``more_count`` are exact sum and count of values outside the window that belong to the mean.
    """
    count = F.count(exact(column)).over(frame)
    if more_count is not None:
        count = count + F.coalesce(more_count, F.lit(0))
    return F.try_divide(Total(df, column).over(frame, more_sum).cast("double"), count.cast("double"))
