"""Session set-up for local runs, and tables written to the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster, use the session it gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallymart")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallymart-"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the configured checkpoint directory.

    Where none is configured, a session in one process (``local[...]``) gets a temporary folder. Any
    other master raises: a temporary folder there is a different disk on every machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallymart-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder to write to, removed when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/tallymart/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    file_system.mkdirs(hadoop_path)
    file_system.deleteOnExit(hadoop_path)
    _written.append(folder)
    return f"{folder}/data"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of the written table.

    Used where a result feeds several branches of a later plan. The source is then read once, every
    branch sees the same bits in its floating-point sums, a lost executor costs a re-read and not a
    recomputation, and (unlike an RDD checkpoint) the branches still get column pruning, filter
    pushdown and real size statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that were materialized inside the block when it ends, not only at the end of
    the application. Results that read them must be written before that."""
    before = len(_written)
    try:
        yield
    finally:
        for folder in _written[before:]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _written[before:]
