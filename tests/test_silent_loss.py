"""Rows that do not fit must fail or stay, never vanish."""

import shutil
import subprocess
import sys

import pytest
from pyspark.sql import Row

from tallymart import session
from tallymart.operators import clean, evaluate, features, marts, model
from tallymart.plans import queries
from tallymart.sources.readers import read_csv
from tallymart.sources.schema import TRANSACTIONS
from tallymart.sources.star import sales, sales_by

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("row", ["6,7,8,9", "4,5"])
def test_ragged_csv_rows_fail_or_are_kept_apart(spark, tmp_path, row):
    path = tmp_path / "rows.csv"
    path.write_text(f"a,b,c\n1,2,3\n{row}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(path)).select("a").collect()
    rows = read_csv(spark, str(path), bad_rows="quarantine").collect()
    assert sorted(r._bad_row or "" for r in rows) == ["", row]


def test_declared_schema_parses_numbers(spark, tmp_path):
    path = tmp_path / "sales.csv"
    header = ",".join(f'"{f.name}"' for f in TRANSACTIONS.fields)
    path.write_text(header + "\n" + ",".join("12" for _ in TRANSACTIONS.fields) + "\n")
    row = read_csv(spark, str(path), TRANSACTIONS).first()
    assert row["Bottles Sold"] == 12 and row["Sale (Dollars)"] == 12.0 and row["City"] == "12"


def test_nan_month_removes_no_rows(spark):
    rows = [("s", "c", "k", 2020, m, float("nan") if m == 2 else float(m)) for m in range(1, 8)]
    panel = spark.createDataFrame(rows, "store_name string, city string, county string, year int, month int, monthly_revenue double")
    found = features.store_features(panel, transactions=None, skus=None)
    assert sorted(r.month for r in found.collect()) == [4, 5, 6, 7]


SCORED = [Row(is_top_quartile=1, prediction=1, probability=0.9), Row(is_top_quartile=0, prediction=0, probability=0.1)]


@pytest.mark.parametrize("bad", [(1, None, 0.5), (None, 1, 0.5), (2, 1, 0.5), (0, 3, 0.5)])
@pytest.mark.parametrize("report", [evaluate.classification_report, evaluate.confusion_matrix, evaluate.breakout_lift])
def test_reports_reject_rows_they_cannot_count(spark, report, bad):
    rows = [(1, 1, 0.9), (0, 0, 0.1), bad]
    df = spark.createDataFrame(rows, "is_top_quartile int, prediction int, probability double")
    with pytest.raises(Exception, match="not 0 or 1"):
        report(df).collect()


@pytest.mark.parametrize("bad", [(1, None), (1, float("nan")), (None, 0.5), (2, 0.5)])
def test_area_rejects_rows_it_cannot_rank(spark, bad):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), bad], "is_top_quartile int, probability double")
    with pytest.raises(Exception, match="NULL or NaN"):
        evaluate.auc_roc(df)


def test_null_label_is_no_class(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "is_top_quartile int")
    with pytest.raises(Exception, match="is NULL"):
        model.class_weights(df).collect()


def test_dangling_keys_leave_all_totals_equal(spark, tmp_path):
    """A line whose part, supplier or order is missing is in every mart."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders"):
        shutil.copy(f"{ROOT}/{name}.parquet", tmp_path / f"{name}.parquet")
    for name, key in (("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")):
        table = spark.read.parquet(f"{ROOT}/{name}.parquet")
        table.where(f"{key} % 5 <> 1").write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet.d"))
        (tmp_path / f"{name}.parquet").unlink()
        shutil.move(str(tmp_path / f"{name}.parquet.d"), str(tmp_path / f"{name}.parquet"))
    shutil.copy(f"{ROOT}/lineitem.parquet", tmp_path / "lineitem.parquet")
    root = str(tmp_path)
    lines = spark.read.parquet(f"{root}/lineitem.parquet")
    total = round(lines.agg({"l_extendedprice": "sum"}).first()[0], 2)
    columns = ("city", "county", "category_name", "sale_date", "item_description", "sale_dollars")
    rows = sales(spark, root, columns)
    summed = {
        "summary": marts.sales_summary(sales_by(spark, root, [], ["sale_dollars", "volume_gallons", "bottles_sold"]), rows="n_rows"),
        "cities": marts.top_cities(sales_by(spark, root, ["city"], ["sale_dollars"]), 10**6),
        "counties": marts.top_counties(rows, 10**6),
        "categories": marts.top_categories(rows, 10**6),
        "products": marts.top_products_revenue(sales_by(spark, root, ["item_description"], ["sale_dollars"]), 10**6),
        "quarters": marts.quarterly_sales(clean.add_calendar(rows)),
    }
    for name, df in summed.items():
        column = "total_sales" if "total_sales" in df.columns else "total_revenue"
        assert round(df.agg({column: "sum"}).first()[0], 2) == total, name


def test_sums_per_key_refuse_columns_of_orders(spark):
    with pytest.raises(ValueError, match="orders"):
        sales_by(spark, ROOT, ["sale_date"], ["sale_dollars"])


def test_needed_column_with_many_nulls_is_named(spark):
    raw = spark.createDataFrame([("01/02/2020", None), ("01/03/2020", "x")], "Date string, City string")
    rules = clean.CleaningRules(drop=(), numeric={}, text=("City",))
    assert "city" not in clean.clean_profiled(raw, rules).columns
    with pytest.raises(ValueError, match="City"):
        clean.clean_profiled(raw, rules, required=["City"])


def test_source_column_with_a_dot(spark):
    raw = spark.createDataFrame([("01/02/2020", "7")], "Date string, `Vol. (L)` string")
    rules = clean.CleaningRules(drop=(), numeric={"Vol. (L)": "double"}, text=(), names={"Date": "sale_date"})
    assert clean.clean(raw, rules).first()["Vol. (L)"] == 7.0


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_tables_are_released(spark):
    with session.released_tables(spark):
        kept = session.materialize(spark.range(5), "five")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert kept.count() == 5
    with pytest.raises(FileNotFoundError):
        open(path, "rb")


_FIT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from tallymart.operators import features, model
from tallymart.session import local_session
spark = local_session({cores})
spark.sparkContext.setLogLevel("ERROR")
n = F.col("id")
rows = spark.range(3000).repartition({parts}).select(
    *[F.concat(F.lit(k), (n % 40).cast("string")).alias(k) for k in ("store_name", "city", "county")],
    (n / 12).cast("int").alias("year"), (n % 12).cast("int").alias("month"),
    *[(F.pmod(F.xxhash64(n, F.lit(f)), F.lit(1000)) / 10.0).alias(f) for f in features.FEATURES],
).withColumn("is_top_quartile", (F.col("revenue_lag1") + F.col("revenue_lag2") > 110).cast("int"))
fit = model.fit_forest(rows, trees=8, max_depth=4)
print("RESULT", [round(float(x), 12) for x in fit.model.featureImportances.toArray()],
      sorted(round(r.probability, 10) for r in fit.predict(rows.limit(200).orderBy("store_name", "year", "month")).select("probability").collect())[:5])
"""


def test_forest_does_not_depend_on_cores_or_partitioning():
    found = set()
    for cores, parts in ((2, 3), (4, 11)):
        code = _FIT.format(repo=sys.path[0] if "tallymart" in sys.path[0] else str(session.__file__).rsplit("/tallymart/", 1)[0], cores=cores, parts=parts)
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
        line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
        assert line, out.stderr[-2000:]
        found.add(line[0].split("]")[0])
    assert len(found) == 1


def test_queries_read_no_cached_schema(spark, tmp_path):
    for columns in ("1 AS o_orderkey", "1 AS o_orderkey, 2 AS extra"):
        spark.sql(f"SELECT {columns}").write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
        found = queries.table(spark, str(tmp_path), "orders").columns
    assert found == ["o_orderkey", "extra"]
