"""CSV and Parquet in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

# RFC 4180 quoting: a quote inside a quoted field is doubled.
_CSV_FORMAT = {"header": True, "quote": '"', "escape": '"'}


BAD_ROW = "_bad_row"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | None = None,
    multiline: bool = False,
    bad_rows: str = "fail",
) -> DataFrame:
    """Lazy CSV scan with a header.

    Without ``schema`` every column is text named by the header; types come from the cleaning step,
    so no pass over the data is spent on inference. Every file's header must name the columns in the
    same order, or the query fails.

    A row with too few or too many fields, or with a value that does not fit ``schema``, fails the
    query. With ``bad_rows="quarantine"`` it stays, its text in the column ``_bad_row`` (NULL in good
    rows); nothing is dropped. Columns are not pruned while parsing, because a parser that skips
    fields does not see that a row is malformed.

    An empty field is NULL, with or without quotes. ``multiline`` allows line breaks inside quotes,
    at the price that a file can no longer be split between tasks.
    """
    if bad_rows not in ("fail", "quarantine"):
        raise ValueError(f"bad_rows must be 'fail' or 'quarantine', not {bad_rows!r}")
    reader = spark.read.options(**_CSV_FORMAT, multiLine=multiline, enforceSchema=False, columnPruning=False)
    if bad_rows == "fail":
        reader = reader.option("mode", "FAILFAST")
        return (reader if schema is None else reader.schema(schema)).csv(path)
    known = schema or reader.csv(path).schema
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_ROW)
    return reader.schema(StructType([*known.fields, StructField(BAD_ROW, StringType())])).csv(path)


def write_csv(df: DataFrame, path: str, compression: str = "none", rows_per_file: int = 0) -> None:
    """Write CSV files with a header. A compressed file is read by one task, so it should be given a
    largest number of rows; 0 is no limit."""
    df.write.options(**_CSV_FORMAT, compression=compression, maxRecordsPerFile=rows_per_file).csv(path)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write a table, by default in one folder, or in folders per ``partition_by`` value.

    Partitioned writes are rebalanced first: rows of a value are brought together so that each task
    writes few files, and a value with a large share of the rows is split over several tasks.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)
