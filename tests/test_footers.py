"""Profiles from Parquet footers equal those from a scan, and read no column."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallymart.operators import clean, profile
from tallymart.sources import footers
from tallymart.sources.star import raw_sales

ROOT = "/root/testdata/sf0.001"


@pytest.fixture
def stored(spark, tmp_path):
    rows = [
        (i, None if i % 3 else f"t{i % 5}", float(i) if i % 4 else None, [1, None] if i % 2 else None, None, datetime.date(2020, 1, 1 + i % 9))
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "`a.b` int, `Sale (Dollars)` string, x double, l array<int>, empty string, d date")
    path = str(tmp_path / "t")
    df.repartition(4).write.parquet(path)
    return path


def test_same_as_a_scan(spark, stored):
    want = profile.column_profile(spark.read.parquet(stored)).collect()
    assert footers.footer_profile(spark, stored).collect() == want
    report = profile.null_report(footers.footer_profile(spark, stored)).collect()
    assert report == profile.null_proportions(spark.read.parquet(stored)).collect()


def test_no_column_is_read(spark, stored):
    plan = footers.footer_counts(spark, stored)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(" in plan
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert all(part.startswith("count(") for part in read.split(",") if ":" in part)


def test_the_callers_session_stays(spark, stored):
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    footers.footer_profile(spark, stored)
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before != ""
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_files_without_statistics_are_scanned(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "bare"
    folder.mkdir()
    pq.write_table(pa.table({"x": [1, None, 3], "s": ["a", None, None]}), folder / "p.parquet", write_statistics=False)
    path = str(folder)
    assert footers.footer_profile(spark, path).collect() == profile.column_profile(spark.read.parquet(path)).collect()


def test_stored_size(spark, stored, tmp_path):
    row = footers.stored_size(spark, stored).first()
    files = list((tmp_path / "t").glob("*.parquet"))
    total = sum(f.stat().st_size for f in files)
    assert (row.n_files, row.n_rows, row.stored_bytes) == (len(files), 200, total)
    assert (row.bytes_per_row, row.stored_mib) == (total / 200, total / 2**20)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([], "a int, s string").write.parquet(path)
    assert footers.footer_profile(spark, path).collect() == profile.column_profile(spark.read.parquet(path)).collect()
    assert footers.stored_size(spark, path).first().n_rows == 0


def test_staged_cleaning_equals_cleaning(spark):
    raw = raw_sales(spark, ROOT)
    want = clean.clean_profiled(raw)
    got = clean.clean_profiled(raw, staged=True)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_distinct_in_the_profile(spark):
    rows = [
        (1, 0.0, "a", b"\x00\xff", [1], datetime.datetime(2024, 10, 27, 0, 30)),
        (1, -0.0, "", b"\x00\xfe", [1], datetime.datetime(2024, 10, 27, 1, 30)),
        (2, float("nan"), None, b"\x00\xff", [1, 2], None),
        (None, float("nan"), "a", None, None, datetime.datetime(2024, 10, 27, 1, 30)),
    ]
    df = spark.createDataFrame(rows, "i int, x double, s string, b binary, l array<int>, t timestamp")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # both instants read 02:30 there
    try:
        got = profile.column_profile(df, with_bytes=True, with_distinct=True).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [(r.n_rows, r.n_nulls, r.n_distinct) for r in got] == [(4, 1, 3), (4, 0, 2), (4, 1, 3), (4, 1, 3), (4, 1, 3), (4, 1, 3)]
    plain = profile.column_profile(df, with_bytes=True).collect()
    assert [r[:6] for r in got[:4]] == [r[:6] for r in plain[:4]]
    assert profile.column_profile(df.where("false"), with_distinct=True).agg(F.sum("n_distinct")).first()[0] == 0


def test_distinct_profile_scans_once(spark, stored):
    df = spark.read.parquet(stored)
    plan = profile.column_profile(df, with_distinct=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert plan.count("hashpartitioning(position") == 2  # distinct pairs, then one row per column and task
