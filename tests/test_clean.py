"""Reading, profiling and cleaning."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallymart.operators import clean, profile
from tallymart.sources.readers import read_csv, read_parquet, write_csv, write_parquet
from tallymart.sources.schema import COLUMN_NAMES


def _raw(spark, **values):
    """One raw row; keyword arguments are names after cleaning."""
    row = {name: "1" for name in COLUMN_NAMES.values()}
    row.update(sale_date="01/07/2022", **values)
    schema = StructType([StructField(source, StringType()) for source in COLUMN_NAMES])
    return spark.createDataFrame([tuple(row[name] for name in COLUMN_NAMES.values())], schema)


def test_clean_drops_casts_and_adds_calendar(spark):
    row = clean.clean(_raw(spark, bottles_sold="32767", sale_dollars="12.5", zip_code="50309"))
    assert dict(row.dtypes)["bottles_sold"] == "smallint"
    assert dict(row.dtypes)["sale_dollars"] == "double"
    assert dict(row.dtypes)["zip_code"] == "string"
    assert not {"address", "pack", "vendor_number", "item_number"} & set(row.columns)
    first = row.first()
    assert (first.sale_date, first.weekday) == (datetime.date(2022, 1, 7), 5)
    assert first.is_weekend is True


@pytest.mark.parametrize("bad", ["32768", "x"])
def test_bad_number_fails_or_is_null(spark, bad):
    raw = _raw(spark, bottles_sold=bad)
    with pytest.raises(Exception, match="(?i)cast|overflow"):
        clean.clean(raw).collect()
    lenient = clean.clean(raw, clean.CleaningRules(mode="lenient"))
    assert lenient.first().bottles_sold is None


def test_absent_columns_are_no_error(spark):
    raw = _raw(spark).drop("Zip Code", "Address", "Volume Sold (Liters)")
    assert "volume_liters" not in clean.clean(raw).columns


def test_sparse_columns_are_dropped_at_the_threshold(spark):
    rows = [(None if i < 1 else "v", None if i < 2 else "v") for i in range(10)]
    df = spark.createDataFrame(rows, "ten string, `twenty %` string")
    assert set(profile.null_heavy_columns(df, 0.10)) == {"ten", "twenty %"}
    assert profile.null_heavy_columns(df, 0.15) == ["twenty %"]
    report = [tuple(row) for row in profile.null_proportions(df).collect()]
    assert report == [("twenty %", 0.2), ("ten", 0.1)]


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert [row.missing_proportion for row in profile.null_proportions(df).collect()] == [None, None]
    assert profile.null_heavy_columns(df) == []
    assert profile.size_estimate(df).first().avg_row_bytes is None


def test_size_counts_utf8_bytes(spark):
    df = spark.createDataFrame([("é", 1), (None, 2)], "s string, n int")
    row = profile.size_estimate(df).first()
    assert (row.n_rows, row.total_bytes, row.avg_row_bytes) == (2, 10.0, 5.0)


def test_size_from_a_sample_scales_to_all_rows(spark):
    df = spark.range(100_000)
    row = profile.size_estimate(df, sample_fraction=0.01).first()
    assert (row.n_rows, row.avg_row_bytes, row.total_bytes) == (100_000, 8.0, 800_000.0)


def test_preview_is_ordered(spark):
    df = spark.range(100).repartition(7)
    assert [row.id for row in profile.preview(df, ["id"], 3).collect()] == [0, 1, 2]


def test_csv_keeps_quotes_commas_and_nulls(spark, tmp_path):
    rows = [('5" GLASS, "TALL"', "a,b"), (None, "back\\slash"), ("y", "x")]
    df = spark.createDataFrame(rows, "`Item Description` string, City string")
    path = str(tmp_path / "t.csv")
    write_csv(df, path)
    back = read_csv(spark, path)
    assert back.columns == ["Item Description", "City"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_csv_reads_doubled_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Name,Size\n"THE ""BEST"" GIN",750\n,1\n"",2\n')
    got = [tuple(row) for row in read_csv(spark, str(tmp_path / "t.csv")).collect()]
    assert got == [('THE "BEST" GIN', "750"), (None, "1"), (None, "2")]


def test_csv_with_schema_checks_the_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a\n1,2\n")
    path = str(tmp_path / "t.csv")
    wrong = spark.createDataFrame([], "a int, b int").schema
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, path, wrong).collect()
    right = spark.createDataFrame([], "b int, a int").schema
    assert tuple(read_csv(spark, path, right).first()) == (1, 2)


def test_csv_files_must_agree_on_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,y\n3,4\n")
    rows = read_csv(spark, str(tmp_path))
    assert sorted(r.y for r in rows.select("y").collect()) == ["2", "4"]
    (tmp_path / "c.csv").write_text("y,x\n5,6\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path)).collect()


def test_partitioned_parquet_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).withColumn("year", F.when(F.col("id") < 900, 2020).otherwise(2021))
    write_parquet(df, path, partition_by=["year"])
    back = read_parquet(spark, path)
    assert back.filter("year = 2021").count() == 100
    assert back.count() == 1000
