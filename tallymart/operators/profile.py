"""Dimensions, size and missing values of a table, each in one pass without a row shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    ByteType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    ShortType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from tallymart.functions.aggregates import n_rows
from tallymart.functions.columns import exact

# Bytes per value in memory.
_FIXED_WIDTH = {
    BooleanType: 1,
    ByteType: 1,
    ShortType: 2,
    IntegerType: 4,
    FloatType: 4,
    DateType: 4,
    LongType: 8,
    DoubleType: 8,
    TimestampType: 8,
    TimestampNTZType: 8,
    DecimalType: 16,
}


def table_dimensions(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(n_rows().alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def _text_bytes(name: str) -> Column:
    return F.coalesce(F.sum(F.octet_length(exact(name).cast("string"))), F.lit(0))


def column_profile(df: DataFrame, with_bytes: bool = False, with_distinct: bool = False) -> DataFrame:
    """One row per column: position, name, type, rows and NULLs, on request bytes and distinct values.

    One pass. Bytes are those of the values in memory: numbers and dates take their fixed width, text
    its UTF-8 length, nested values that of their text. Distinct values are exact, NULL counts as one; see
    :func:`value_counts`.
    """
    if with_distinct:
        return _distinct_profile(df, with_bytes)
    widths = [_FIXED_WIDTH.get(type(field.dataType)) for field in df.schema.fields]
    measures = [F.count(exact(name)).alias(f"c{i}") for i, name in enumerate(df.columns)]
    if with_bytes:
        measures += [
            _text_bytes(name).alias(f"b{i}")
            for i, name in enumerate(df.columns)
            if widths[i] is None
        ]
    counts = df.agg(n_rows().alias("n_rows"), *measures)

    def line(i: int) -> Column:
        field = df.schema.fields[i]
        values = [
            F.lit(i + 1).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.col("n_rows"),
            (F.col("n_rows") - F.col(f"c{i}")).alias("n_nulls"),
        ]
        if with_bytes:
            size = F.col(f"b{i}") if widths[i] is None else F.col("n_rows") * widths[i]
            values.append(size.cast("bigint").alias("n_bytes"))
        return F.struct(*values)

    return counts.select(F.inline(F.array(*[line(i) for i in range(len(df.columns))])))


def _comparable(df: DataFrame, name: str) -> Column:
    """The value as text, equal for equal values and for no others."""
    kind, value = df.schema[name].dataType, exact(name)
    if isinstance(kind, (FloatType, DoubleType)):
        return (value + F.lit(0.0).cast(kind)).cast("string")  # -0.0 is 0.0
    if isinstance(kind, TimestampType):
        return F.unix_micros(value).cast("string")  # local time repeats an hour each autumn
    if isinstance(kind, BinaryType):
        return F.decode(value, "iso-8859-1")
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))
    return value.cast("string")


def value_counts(df: DataFrame) -> DataFrame:
    """position, value and n of every distinct value of every column, values as text.

    Each row becomes one (position, value) pair per column inside the task that reads it. Pairs are
    counted there first, and only distinct pairs are shuffled, by both, so a column or a value with very
    many rows is one pair per task.
    """
    pairs = [F.struct(F.lit(i).alias("position"), _comparable(df, name).alias("value")) for i, name in enumerate(df.columns, 1)]
    return df.select(F.inline(F.array(*pairs))).groupBy("position", "value").agg(n_rows().alias("n"))


def _distinct_profile(df: DataFrame, with_bytes: bool) -> DataFrame:
    """:func:`column_profile` from the counts of all values: one scan, one shuffle of distinct pairs."""
    counts = value_counts(df)
    held = F.when(F.col("value").isNotNull(), F.col("n"))
    binary = [i for i, field in enumerate(df.schema.fields, 1) if isinstance(field.dataType, BinaryType)]
    length = F.when(F.col("position").isin(binary), F.char_length("value")).otherwise(F.octet_length("value"))
    width = F.coalesce(F.sum(length * F.col("n")), F.lit(0))
    measured = counts.groupBy("position").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(held), F.lit(0)).alias("n_values"),
        n_rows().alias("n_distinct"),
        width.alias("text_bytes"),
    )
    fields = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.lit(_FIXED_WIDTH.get(type(field.dataType))).cast("bigint").alias("width"),
        )
        for i, field in enumerate(df.schema.fields, 1)
    ]
    columns = df.sparkSession.range(1).select(F.inline(F.array(*fields)))
    none = F.lit(0).cast("bigint")
    rows = F.coalesce("n_rows", none)
    out = columns.join(measured, "position", "left").select(
        "position",
        "column_name",
        "data_type",
        rows.alias("n_rows"),
        (rows - F.coalesce("n_values", none)).alias("n_nulls"),
        *([F.coalesce(rows * F.col("width"), "text_bytes", none).alias("n_bytes")] if with_bytes else []),
        F.coalesce("n_distinct", none).alias("n_distinct"),
    )
    return out


def null_report(profiled: DataFrame) -> DataFrame:
    """Share of NULLs per column of a :func:`column_profile`, highest first."""
    share = F.try_divide(F.col("n_nulls"), F.col("n_rows")).alias("missing_proportion")
    return profiled.select("column_name", share).orderBy(
        F.col("missing_proportion").desc(), F.col("column_name")
    )


def over_threshold(report: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Columns of a :func:`null_report` whose share is at least ``threshold``."""
    return report.filter(F.col("missing_proportion") >= F.lit(threshold))


def size_report(profiled: DataFrame) -> DataFrame:
    """Size of the table whose :func:`column_profile` with bytes is given."""
    total = profiled.agg(
        F.max("n_rows").alias("n_rows"), F.sum("n_bytes").cast("double").alias("total_bytes")
    )
    return _size_row(total.withColumn("avg_row_bytes", F.try_divide("total_bytes", "n_rows")))


def _size_row(measured: DataFrame) -> DataFrame:
    mib = F.col("total_bytes") / F.lit(1024.0 * 1024.0)
    return measured.select("n_rows", "avg_row_bytes", "total_bytes", mib.alias("total_mib"))


def null_proportions(df: DataFrame) -> DataFrame:
    """One row per column with its share of NULLs, highest first."""
    return null_report(column_profile(df))


def columns_over_null_threshold(df: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Columns whose share of NULLs is at least ``threshold``."""
    return over_threshold(null_proportions(df), threshold)


def null_heavy_columns(df: DataFrame, threshold: float = 0.10) -> list[str]:
    """Names for :func:`columns_over_null_threshold`: one aggregate, at most one name per column."""
    return [row.column_name for row in columns_over_null_threshold(df, threshold).collect()]


def size_estimate(df: DataFrame, sample_fraction: float | None = None, seed: int = 42) -> DataFrame:
    """One row: rows, mean bytes per row, total bytes and MiB of the values in memory.

    With ``sample_fraction`` the mean comes from a random sample, and only the row count from the
    whole table, which Parquet answers from its footers.
    """
    if sample_fraction is None:
        return size_report(column_profile(df, with_bytes=True))
    sample = df.sample(fraction=sample_fraction, seed=seed)
    mean = size_report(column_profile(sample, with_bytes=True)).select("avg_row_bytes")
    counted = mean.withColumn("n_rows", df.agg(n_rows()).scalar())
    return _size_row(counted.withColumn("total_bytes", F.col("n_rows") * F.col("avg_row_bytes")))


def preview(df: DataFrame, order_by: list[str], n: int = 25) -> DataFrame:
    """The first ``n`` rows in a stated order; each task keeps only its own best ``n``."""
    return df.orderBy(*order_by).limit(n)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact number of distinct values per column, NULL counting as one; one scan for all columns."""
    asked = df if columns is None else df.select(*[exact(name) for name in columns])
    return column_profile(asked, with_distinct=True).select("column_name", "n_distinct")
