"""The whole analysis from a raw CSV file, against the registered queries on the same data."""

import pytest

from tallymart.plans import analysis, queries
from tallymart.session import scratch_path
from tallymart.sources.readers import read_csv, write_csv
from tallymart.sources.star import raw_sales

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reports(spark):
    path = scratch_path(spark, "raw-csv")
    write_csv(raw_sales(spark, ROOT), path)
    return analysis.analyse(read_csv(spark, path), trees=20)


def _rows(df, digits=2):
    def plain(value):
        return round(value, digits) if isinstance(value, float) else value

    return [tuple(plain(value) for value in row) for row in df.collect()]


@pytest.mark.parametrize(
    "name",
    [
        "category_distribution",
        "uncategorized_audit",
        "category_mapping_pairs",
        "distinct_categories",
        "sales_summary",
        "quarterly_sales",
        "top_categories",
        "top_products_revenue",
        "top_products_volume",
        "top_cities",
        "split_summary",
    ],
)
def test_reports_equal_the_registered_queries(spark, reports, name):
    expected = _rows(queries.registry()[name](spark, ROOT))
    assert sorted(_rows(reports[name]), key=str) == sorted(expected, key=str)


def test_every_report_has_rows(reports):
    for name, report in reports.items():
        assert report.count() > 0, name


def test_profile_describes_the_raw_file(reports):
    rows = {r.column_name: r for r in reports["column_profile"].collect()}
    assert len(rows) == 24 and rows["Invoice/Item Number"].n_rows == 6000
    top = reports["null_proportions"].first()
    assert top.column_name == "Store Location" and top.missing_proportion > 0.1


def test_models_are_compared(reports):
    rows = {r.model: r for r in reports["model_comparison"].collect()}
    assert set(rows) == {"logistic regression", "random forest"}
    assert all(0.0 <= r.auc <= 1.0 for r in rows.values())
    assert rows["random forest"].n_positive == rows["logistic regression"].n_positive
