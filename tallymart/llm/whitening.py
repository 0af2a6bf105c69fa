"""Whitening of embeddings by principal components.

Entries are made integers, so count, sums and products over all vectors are exact and do not depend on the
partitioning. The sums come first; products are taken of the differences from the rounded mean, and what
the rounding left is subtracted afterwards, again in integers. Only matrices of dimension by dimension
reach the driver, where the eigenvectors are found (module ``eigen``). Projection is one matrix product
per batch of rows.

Every task adds up its own rows and gives one matrix; the scan is cut into a number of tasks that follows
from the cores, so what is shuffled grows with the cluster and the dimension, not with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import ship
from tallymart.llm.eigen import eigen

# Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
TASKS_PER_CORE = 4
BLOCK_ROWS = 8_192
# Components whose share of the largest eigenvalue is at most this carry no variance but rounding.
NO_VARIANCE = 1e-13


class Whitener(NamedTuple):
    """``n`` vectors had integer entries with sums ``base * n + rest``; see :func:`fit`."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float | None]
    loadings: np.ndarray

    @property
    def offset(self) -> np.ndarray:
        """Mean minus ``base``, at most one half."""
        return self.rest / self.n


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows whose vector is not NULL, not empty, and of finite entries only."""
    ship(df.sparkSession)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("vector", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Integer entries of runs of rows, one row per vector, with the run's first row."""
    column = batch.column(batch.schema.get_field_index("vector"))
    if not len(column):
        return
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} entries in one table")
    entries = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)
    if np.abs(entries).max() >= 2.0**52:
        raise OverflowError("an entry is too large for exact sums")
    for first in range(0, len(column), BLOCK_ROWS):
        yield first, entries[first : first + BLOCK_ROWS].astype(np.int64) + SHIFT


def _checked(total: np.ndarray | None, more: np.ndarray) -> np.ndarray:
    """The sum of two arrays; of integers it is exact or an error."""
    if total is None:
        return more
    if total.shape != more.shape:
        raise ValueError("vectors of different lengths in one table")
    if more.dtype == np.int64 and (np.abs(total.astype(float) + more.astype(float)) > 2.0**62).any():
        raise OverflowError("sums over the vectors pass 64 bits")
    return total + more


def _total(df: DataFrame, measure: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray | None:
    """The sum over all rows of ``measure``, a matrix per block of rows; None without rows."""
    sql = "int", f"array<{'bigint' if kind is np.int64 else 'double'}>"

    def as_batch(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"i": pa.array(list(rows), pa.int32()), "sums": [row.tolist() for row in rows.values()]})

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, block in _blocks(batch):
                total = _checked(total, measure(block))
        if total is not None:
            yield as_batch(dict(enumerate(total)))

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[i] = _checked(found.get(i), row.values.to_numpy(zero_copy_only=False).astype(kind))
        if found:
            yield as_batch(found)

    schema = f"i {sql[0]}, sums {sql[1]}"
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select("vector").coalesce(TASKS_PER_CORE * cores).mapInArrow(of_task, schema)
    rows = parts.repartition(cores, "i").mapInArrow(of_rows, schema).collect()
    if not rows:
        return None
    return np.array([r.sums for r in sorted(rows, key=lambda r: r.i)], kind)


def _products(block: np.ndarray) -> np.ndarray:
    """block' * block of integers, exact: in floating point as many rows at a time as 53 bits allow."""
    largest = int(np.abs(block).max(initial=1))
    rows = 2**53 // max(largest * largest, 1)
    if rows < 1:
        return (block.astype(object).T @ block.astype(object)).astype(np.int64)
    total = np.zeros((block.shape[1],) * 2, np.int64)
    for first in range(0, len(block), rows):
        part = block[first : first + rows].astype(float)
        total += (part.T @ part).astype(np.int64)
    return total


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitening of the covariance (divisor n) of all vectors of :func:`usable`; None without any.

    Two passes over the vectors: exact sums, then exact products about the rounded mean.
    """
    sums = _total(rows, lambda block: np.append(len(block), block.sum(axis=0))[None, :], np.int64)
    if sums is None:
        return None
    n, sums = int(sums[0, 0]), sums[0, 1:]
    base = (2 * sums + n) // (2 * n)
    rest = sums - n * base
    products = _total(rows, lambda block: _products(block - base), np.int64)
    wide = products.astype(object) * n - np.outer(rest.astype(object), rest.astype(object))
    # Integers of any size; a double for the head and one for what is left keep 106 bits.
    head = wide.astype(float)
    left = (wide - np.vectorize(int, otypes=[object])(head)).astype(float)
    covariance = (head.astype(np.longdouble) + left) / np.longdouble(n) ** 2
    values, vectors = eigen(covariance)
    values, vectors = values[:components], vectors[:, :components]
    trace = float(np.trace(covariance))
    real = values > NO_VARIANCE * max(values[0], 0)
    scales = np.where(real, np.sqrt(np.where(real, values, 1)), np.nan)
    explained = [max(float(e), 0.0) / trace if trace else None for e in values]
    return Whitener(n, base, rest, values, explained, vectors / scales)


def identity_error(rows: DataFrame, model: Whitener) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all
    rows; over the components with variance, None if there are none."""
    real = np.isfinite(model.loadings[0])
    if not real.any():
        return None
    base, offset, loadings = model.base, model.offset, model.loadings[:, real]

    def measure(block: np.ndarray) -> np.ndarray:
        white = (block - base - offset) @ loadings
        return np.vstack([white.T @ white, white.sum(axis=0)])

    total = _total(rows, measure, np.float64) / model.n
    covariance = total[:-1] - np.outer(total[-1], total[-1])
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def project(rows: DataFrame, model: Whitener) -> DataFrame:
    """vec_id, deviation decimal(38,0) and whitened array<double> of every row.

    ``deviation`` is the sum over dimensions of (n * x - S)^2, exact. It is n^2 a - 2 n b + c with whole
    numbers a, b of the row and c of the table, so it is put together in decimals.
    """
    base, rest, offset, loadings = model.base, model.rest, model.offset, model.loadings
    rest_sizes = np.abs(rest).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for first, block in _blocks(batch):
                centred = block - base
                sizes = np.abs(centred).astype(float)
                if max((sizes * sizes).sum(axis=1).max(), (sizes @ rest_sizes).max()) > 2.0**62:
                    raise OverflowError("a vector lies too far from the mean for an exact deviation")
                white = (centred - offset) @ loadings
                ends = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(block)),
                        pa.array((centred * centred).sum(axis=1)),
                        pa.array(centred @ rest),
                        pa.ListArray.from_arrays(ends, pa.array(white.ravel(), from_pandas=True)),
                    ],
                    ["vec_id", "a", "b", "whitened"],
                )

    projected = rows.mapInArrow(run, "vec_id long, a long, b long, whitened array<double>")
    whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    rest_squared = sum(int(x) ** 2 for x in rest)
    deviation = whole(model.n**2) * F.col("a") - whole(2 * model.n) * F.col("b") + whole(rest_squared)
    return projected.select("vec_id", deviation.cast("decimal(38,0)").alias("deviation"), "whitened")


def whitened_components(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: one row per vector and
    component, numbered from 1 by falling eigenvalue.

    Rows whose vector is NULL, empty, or holds a NULL or non-finite entry are left out; rows that repeat an
    id, or have none, stay. Vectors of different lengths in one table are an error, and so is a deviation
    that passes 64 bits. A component without variance (repeated or too few rows) has NULL as ``whitened``
    and no part in ``identity_error``; without any variance ``explained`` and ``identity_error`` are NULL.
    A table without usable rows gives no rows. Other columns are not read.
    """
    rows = usable(df, id_col, vector_col)
    model = fit(rows, components)
    if model is None:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    shares = F.array(*[F.lit(e).cast("double") for e in model.explained])
    long = project(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return long.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.element_at(shares, F.col("k") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
