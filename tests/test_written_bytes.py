"""What the queries write for themselves is no larger than it has to be."""

from tallymart.operators import clean
from tallymart.plans import queries
from tallymart.sources.readers import read_csv, write_csv
from tallymart.sources.schema import COLUMN_NAMES, UNUSED_COLUMNS


def raw(spark):
    values = {"Date": "01/31/2020", "Bottles Sold": "3", "City": 'a "b", c'}
    kinds = clean.CleaningRules().numeric
    row = [values.get(name, "1" if name in kinds else "text") for name in COLUMN_NAMES]
    gap = [None if name == "City" else value for name, value in zip(COLUMN_NAMES, row)]
    return spark.createDataFrame([row] * 25 + [gap] * 2, list(COLUMN_NAMES)).repartition(2)


def test_csv_round_trip_is_compressed_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "raw_sales", lambda spark, root: raw(spark))
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = queries.csv_roundtrip_scan(spark, "")
    files = list((tmp_path / "csv").glob("part-*"))
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    assert got.count() == 27 and got.where("city is null").count() == 2
    write_csv(raw(spark), str(tmp_path / "small"), "gzip", rows_per_file=5)
    assert len(list((tmp_path / "small").glob("part-*"))) >= 6
    assert sorted(map(str, read_csv(spark, str(tmp_path / "small")).collect())) == sorted(map(str, raw(spark).collect()))


def test_columns_that_are_dropped_anyway_are_not_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clean, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = clean.clean_profiled(raw(spark), staged=True)
    assert not set(UNUSED_COLUMNS) & set(spark.read.parquet(str(tmp_path / "raw")).columns)
    assert all(".zstd." in f.name for f in (tmp_path / "raw").glob("part-*"))
    want = clean.clean_profiled(raw(spark))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
