"""Temporal train and test sets: the last periods are held out, nothing is shuffled."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.aggregates import n_rows


class Cutoff(NamedTuple):
    year: int
    month: int


def temporal_cutoff(
    df: DataFrame, holdout: int = 3, year: str = "year", month: str = "month"
) -> DataFrame:
    """One row: the first held-out month and how many of the wanted months there are."""
    last = (
        df.select(year, month)
        .distinct()
        .orderBy(F.col(year).desc_nulls_last(), F.col(month).desc_nulls_last())
        .limit(holdout)
    )
    return last.agg(
        F.min(F.struct(F.col(year).alias("y"), F.col(month).alias("m"))).alias("first"),
        n_rows().alias("n_periods"),
    ).select(
        F.col("first.y").alias("cutoff_year"), F.col("first.m").alias("cutoff_month"), "n_periods"
    )


def find_cutoff(
    df: DataFrame, holdout: int = 3, year: str = "year", month: str = "month"
) -> Cutoff:
    """The first held-out month as a value; brings one row to the driver."""
    row = temporal_cutoff(df, holdout, year, month).first()
    if row.n_periods < holdout:
        raise ValueError(f"{row.n_periods} periods in the data, {holdout} needed for the test set")
    return Cutoff(row.cutoff_year, row.cutoff_month)


def before_cutoff(cutoff: Cutoff, year: str = "year", month: str = "month") -> Column:
    """True for training rows. Plain comparisons on both columns, which Parquet scans can use."""
    return (F.col(year) < cutoff.year) | (
        (F.col(year) == cutoff.year) & (F.col(month) < cutoff.month)
    )


def from_cutoff(cutoff: Cutoff, year: str = "year", month: str = "month") -> Column:
    """True for test rows."""
    return (F.col(year) > cutoff.year) | (
        (F.col(year) == cutoff.year) & (F.col(month) >= cutoff.month)
    )


def train_test_split(df: DataFrame, holdout: int = 3) -> tuple[DataFrame, DataFrame, Cutoff]:
    """Training rows, test rows and the cutoff between them."""
    cutoff = find_cutoff(df, holdout)
    return df.filter(before_cutoff(cutoff)), df.filter(from_cutoff(cutoff)), cutoff


def with_split(df: DataFrame, cutoff: Cutoff) -> DataFrame:
    """Add ``split``: ``train`` or ``test``."""
    side = F.when(before_cutoff(cutoff), "train").when(from_cutoff(cutoff), "test")
    return df.withColumn("split", side)


def split_summary(df: DataFrame, label: str = "is_top_quartile") -> DataFrame:
    """Rows and share of positives per side of a frame that has ``split``."""
    return df.groupBy("split").agg(
        n_rows().alias("n_rows"), F.avg(F.col(label).cast("double")).alias("positive_rate")
    )
