"""Shared pieces of the text operators: tables, per-batch Arrow maps and hash helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymart.llm import textbatch as tb


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library's source to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(), f"{top.name}-{sc.applicationId}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, str(source.relative_to(top.parent)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; other columns, whatever their names, stay out."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def map_texts(
    df: DataFrame,
    function: Callable[[tb.Texts], dict[str, pa.Array]],
    schema: str,
    text: str = "text",
    slice_bytes: int = tb.SLICE_BYTES,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """``function`` over runs of whole texts; its columns stand beside all columns but the text.

    ``schema`` names the columns that ``function`` returns, one value per text. ``done`` is called at the end
    of a task.
    """
    kept = [c for c in df.columns if c != text]
    out = StructType([df.schema[c] for c in kept] + StructType.fromDDL(schema).fields)
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(text))
                for first, part in tb.slices(tb.from_arrow(column), slice_bytes):
                    rows = batch.slice(first, len(part))
                    made = function(part)
                    columns = [rows.column(rows.schema.get_field_index(c)) if c in kept else made[c] for c in names]
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            if done is not None:
                done()

    return df.mapInArrow(run, out)


def map_rows(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str = ""
) -> DataFrame:
    """``df.mapInArrow`` for rows that keep all columns, whatever their names, and get those of ``added``.

    ``function`` sees the columns as c0, c1, ... and appends the added ones under their names.
    """
    ship(df.sparkSession)
    more = StructType.fromDDL(added).fields if added else []
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    mapped = plain.mapInArrow(function, StructType([*plain.schema.fields, *more]))
    return mapped.toDF(*df.columns, *[f.name for f in more])


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def is_held_out(id_column: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(id_column.cast("string")) % 4 == 2
