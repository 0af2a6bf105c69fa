"""Results stay whole when one store and one product each hold a third of all rows.

Broadcasts are off and the skew limits low, so the joins shuffle and split hot partitions as they
would on large data.
"""

import shutil

import duckdb
import pytest

import __spark_entry__ as entry_point
from test_oracle import TABLES, _sorted_rows

ROOT = "/root/testdata/sf0.01"
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.files.maxPartitionBytes": "128KB",
    "spark.sql.files.openCostInBytes": "16KB",
}


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("hot")
    db = duckdb.connect()
    for name in TABLES:
        target = f"{root}/{name}.parquet"
        if name == "lineitem":
            db.execute(
                f"""COPY (SELECT * REPLACE (
                    CASE WHEN (l_orderkey * 7 + l_linenumber) % 3 = 1 THEN 17 ELSE l_partkey END
                      AS l_partkey,
                    CASE WHEN (l_orderkey * 5 + l_linenumber) % 3 = 0 THEN 42 ELSE l_suppkey END
                      AS l_suppkey)
                    FROM '{ROOT}/lineitem.parquet') TO '{target}' (ROW_GROUP_SIZE 10000)"""
            )
        else:
            shutil.copy(f"{ROOT}/{name}.parquet", target)
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{target}'")
    old = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield str(root), db
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize(
    "name",
    [
        "categorize_by_lookup",
        "category_distribution",
        "top_categories",
        "top_products_volume",
        "top_cities",
        "city_efficiency",
        "weekday_weekend",
        "group_quantile_nearest",
        "store_month_panel",
        "breakout_labels",
    ],
)
def test_hot_keys(spark, hot, name):
    root, db = hot
    frame = entry_point.queries()[name](spark, root)
    got = _sorted_rows(frame.columns, [tuple(row) for row in frame.collect()])
    result = db.execute(entry_point.oracle_sql()[name])
    assert got == _sorted_rows([c[0] for c in result.description], result.fetchall())


def test_hot_join_partitions_are_split(spark, hot):
    root, _ = hot
    frame = entry_point.queries()["city_efficiency"](spark, root)
    frame.collect()
    assert "SortMergeJoin(skew=true)" in frame._jdf.queryExecution().executedPlan().toString()
