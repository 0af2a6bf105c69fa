"""Running sums, row numbers and lags over a global order, without a task that holds all rows.

Rows are range-partitioned by the order, numbered by partition and written. Totals per partition, one row
each, give every partition its offset; inside a partition a window adds up. So a task holds one range of
the order, and what is broadcast has one row per shuffle partition, however many rows there are.

The ranges come from a sample of the rows, which may turn out otherwise when it is drawn again. Writing
fixes them: totals and rows always speak of the same partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.session import materialize

_PART = "_part"


def _dealt(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn(_PART, F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, str]) -> DataFrame:
    """``df`` with, for each new column, the sum of a column over this row and all rows before it.

    ``order`` should tell all rows apart; rows it does not tell apart come in any order among themselves.
    NULL adds nothing. Sums are those of Spark for the column's type: exact for integers and decimals.
    """
    dealt = _dealt(df, order)
    totals = dealt.groupBy(_PART).agg(*[F.sum(column).alias(out) for out, column in sums.items()])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        F.col(_PART).alias("_offset_of"), *[F.coalesce(F.sum(out).over(before), F.lit(0)).alias(f"_before_{out}") for out in sums]
    )
    inside = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(F.broadcast(offsets), F.col(_PART) == F.col("_offset_of"))
    running = {
        out: F.coalesce(F.sum(column).over(inside), F.lit(0)) + F.col(f"_before_{out}") for out, column in sums.items()
    }
    return placed.withColumns(running).select(*df.columns, *sums)


def numbered(df: DataFrame, order: Sequence[Column | str], out: str = "row_number") -> DataFrame:
    """``df`` with its rows' places in the order, from 1."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sums(ones, order, {out: "_one"}).drop("_one")


def ordered_lag(df: DataFrame, order: Sequence[Column | str], column: str, n: int = 1, out: str | None = None) -> DataFrame:
    """``df`` with the value that ``column`` has ``n`` rows earlier in the order, NULL for the first ``n``.

    Rows are numbered and joined with themselves by number, which spreads evenly. A window without a
    partition key does the same in one task; use that where the rows are few by construction.
    """
    if n < 1:
        raise ValueError(f"n must be positive, not {n}")
    places = materialize(numbered(df, order, "_place"), "places")
    earlier = places.select((F.col("_place") + n).alias("_later"), F.col(column).alias(out or f"{column}_lag{n}"))
    joined = places.join(earlier, F.col("_place") == F.col("_later"), "left")
    return joined.drop("_place", "_later")

