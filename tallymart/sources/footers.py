"""What a Parquet table says about itself: rows, NULLs and bytes without reading a column.

Spark answers counts from the footers of Parquet files when an aggregation is pushed into the scan: each
task opens the footers of its files, and no page is read. That needs the newer file source and a setting;
both are set on a session of its own, so the caller's stays as it is.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from tallymart.functions.aggregates import n_rows
from tallymart.functions.columns import exact

_NESTED = (ArrayType, MapType, StructType, VariantType)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that pushes counts into Parquet scans."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``n_rows``, and ``c0``, ``c1``, ... with the non-NULL values of each plain column.

    Lazy. Nested columns are left out, because a footer counts their leaves and not their rows. Where no
    file has a row group, the counts are NULL.
    """
    df = footer_session(spark).read.parquet(path)
    plain = [i for i, field in enumerate(df.schema.fields) if not isinstance(field.dataType, _NESTED)]
    return df.agg(n_rows().alias("n_rows"), *[F.count(exact(df.columns[i])).alias(f"c{i}") for i in plain])


def counted(spark: SparkSession, path: str, column: str) -> tuple[int, int]:
    """Rows of a table and non-NULL values of a plain column, from the footers or else from a scan of the column."""
    df = spark.read.parquet(path)
    try:
        known = footer_counts(spark, path).first()
        rows, values = known["n_rows"], known[f"c{df.columns.index(column)}"]
    except Py4JJavaError:  # a file without statistics
        rows, values = df.agg(n_rows(), F.count(exact(column))).first()
    return rows or 0, values or 0


def footer_profile(spark: SparkSession, path: str) -> DataFrame:
    """position, column_name, data_type, n_rows and n_nulls of every column, as ``profile.column_profile``.

    Plain columns are counted from the footers. Nested ones are scanned, and so is everything where a
    file has no statistics. The counts, one row, come to the driver.
    """
    df = spark.read.parquet(path)
    try:
        known = footer_counts(spark, path).first().asDict()
    except Py4JJavaError:  # a file without statistics; a real fault shows again in the scan
        known = {}
    missing = [i for i in range(len(df.columns)) if f"c{i}" not in known]
    if missing:
        known |= df.agg(n_rows().alias("n_rows"), *[F.count(exact(df.columns[i])).alias(f"c{i}") for i in missing]).first().asDict()
    n = known["n_rows"] or 0
    lines = [
        (i + 1, field.name, field.dataType.simpleString(), n, n - (known[f"c{i}"] or 0))
        for i, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(lines, "position int, column_name string, data_type string, n_rows bigint, n_nulls bigint")


def stored_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, rows, bytes on disk, bytes per row and MiB, from the file listing and the footers.

    The row count comes to the driver.
    """
    rows = footer_counts(spark, path).first()["n_rows"] or 0
    files = footer_session(spark).read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    sizes = files.agg(n_rows().alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("stored_bytes"))
    return sizes.select(
        "n_files",
        F.lit(rows).cast("bigint").alias("n_rows"),
        "stored_bytes",
        F.try_divide(F.col("stored_bytes").cast("double"), F.lit(float(rows))).alias("bytes_per_row"),
        (F.col("stored_bytes") / F.lit(1024.0 * 1024.0)).alias("stored_mib"),
    )
