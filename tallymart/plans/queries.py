"""The registered queries: each operator run over the whole star-schema tables under ``root``.

Sums of money are rounded to cents; they, means and ratios are exact sums divided once, so every engine
gets the same bits. Only means and deviations of features that are quotients themselves are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.calendar import parse_date
from tallymart.functions.text import relabel
from tallymart.operators import categorize as cat
from tallymart.operators import clean as cleaning
from tallymart.operators import distinct_sets, evaluate, features, labels, marts, model, panel, panel_store, profile, split, trees
from tallymart.plans import analysis
from tallymart.session import materialize, scratch_path
from tallymart.sources import footers
from tallymart.sources.readers import read_csv, write_csv, write_parquet
from tallymart.sources.star import keyed_sales, raw_sales, sales, sales_by, table

Query = Callable[[SparkSession, str], DataFrame]

# The native key of an invoice line.
INVOICE = ("order_key", "order_line")

_REGISTRY: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _cents(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in columns})


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# --- sources and profiling -----------------------------------------------------------------------

_PROFILED = (
    "invoice_item",
    "sale_date",
    "store_name",
    "city",
    "county",
    "store_location",
    "category_name",
    "item_description",
    "bottles_sold",
    "sale_dollars",
    "volume_liters",
)


def _profiled(spark: SparkSession, root: str) -> DataFrame:
    return sales(spark, root, _PROFILED)


@_query
def csv_roundtrip_scan(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_csv(raw_sales(spark, root), path, compression="gzip", rows_per_file=1_000_000)
    rows = cleaning.clean(read_csv(spark, path))
    return _cents(rows, "volume_liters", "volume_gallons").select(
        "invoice_item",
        "sale_date",
        "store_name",
        "city",
        "county",
        "category_name",
        "item_description",
        "bottles_sold",
        "sale_dollars",
        "volume_liters",
        "volume_gallons",
    )


@_query
def column_profile(spark: SparkSession, root: str) -> DataFrame:
    return profile.column_profile(_profiled(spark, root), with_distinct=True)


@_query
def preview_rows(spark: SparkSession, root: str) -> DataFrame:
    return profile.preview(table(spark, root, "orders"), ["o_orderkey"], 25)


@_query
def table_dimensions(spark: SparkSession, root: str) -> DataFrame:
    return profile.table_dimensions(_profiled(spark, root))


@_query
def size_estimate(spark: SparkSession, root: str) -> DataFrame:
    return profile.size_estimate(_profiled(spark, root))


@_query
def null_proportions(spark: SparkSession, root: str) -> DataFrame:
    return profile.null_proportions(_profiled(spark, root))


@_query
def columns_over_null_threshold(spark: SparkSession, root: str) -> DataFrame:
    return profile.columns_over_null_threshold(_profiled(spark, root), 0.10)


def _stored(spark: SparkSession, root: str) -> str:
    """Path of the profiled columns as a written table."""
    path = scratch_path(spark, "profiled")
    write_parquet(_profiled(spark, root), path)
    return path


@_query
def footer_profile(spark: SparkSession, root: str) -> DataFrame:
    return footers.footer_profile(spark, _stored(spark, root))


@_query
def footer_null_proportions(spark: SparkSession, root: str) -> DataFrame:
    return profile.null_report(footers.footer_profile(spark, _stored(spark, root)))


@_query
def stored_size(spark: SparkSession, root: str) -> DataFrame:
    """Rows and files of the order lines; bytes on disk are what the writer made of them."""
    return footers.stored_size(spark, f"{root}/lineitem.parquet").select("n_rows", (F.col("stored_bytes") > 0).alias("has_bytes"))


@_query
def distinct_counts(spark: SparkSession, root: str) -> DataFrame:
    columns = ("store_name", "city", "county", "store_location", "category_name", "item_description")
    return profile.distinct_counts(sales(spark, root, columns), columns)


# --- cleaning ------------------------------------------------------------------------------------


@_query
def clean_sales(spark: SparkSession, root: str) -> DataFrame:
    cleaned = cleaning.clean_profiled(raw_sales(spark, root), staged=True)
    return _cents(cleaned, "volume_liters", "volume_gallons")


@_query
def parse_dates(spark: SparkSession, root: str) -> DataFrame:
    lines = sales(spark, root, ["invoice_item", "sale_date"])
    text = lines.select("invoice_item", F.date_format("sale_date", "MM/dd/yyyy").alias("date_text"))
    return text.withColumn("sale_date", parse_date(F.col("date_text")))


@_query
def calendar_features(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders")
    dates = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("sale_date"))
    return cleaning.add_calendar(dates)


# --- categories ----------------------------------------------------------------------------------


@_query
def categorize(spark: SparkSession, root: str) -> DataFrame:
    lines = sales(spark, root, ["invoice_item", "category_name", "sale_dollars"])
    return cat.categorize(lines)


@_query
def categorize_by_lookup(spark: SparkSession, root: str) -> DataFrame:
    lines = sales(spark, root, ["invoice_item", "category_name", "sale_dollars"])
    return cat.categorize_by_lookup(lines)


@_query
def distinct_categories(spark: SparkSession, root: str) -> DataFrame:
    return cat.distinct_values(sales(spark, root, ["category"]), "category")


@_query
def category_distribution(spark: SparkSession, root: str) -> DataFrame:
    return cat.category_distribution(sales_by(spark, root, ["category_name"]), weight="n_rows")


@_query
def uncategorized_audit(spark: SparkSession, root: str) -> DataFrame:
    return cat.uncategorized_audit(sales_by(spark, root, ["category_name"]), weight="n_rows")


@_query
def category_mapping_pairs(spark: SparkSession, root: str) -> DataFrame:
    return cat.category_mapping_pairs(sales_by(spark, root, ["category_name"]))


# --- marts ---------------------------------------------------------------------------------------


@_query
def sales_summary(spark: SparkSession, root: str) -> DataFrame:
    sums = sales_by(spark, root, [], ["sale_dollars", "volume_gallons", "bottles_sold"])
    return _cents(marts.sales_summary(sums, rows="n_rows"), "total_revenue", "total_volume_gallons")


@_query
def yearly_summary(spark: SparkSession, root: str) -> DataFrame:
    lines = sales(spark, root, ["sale_date", "sale_dollars", "volume_gallons", "bottles_sold"])
    yearly = marts.yearly_summary(cleaning.add_calendar(lines))
    return _cents(yearly, "revenue", "volume_gallons")


@_query
def quarterly_sales(spark: SparkSession, root: str) -> DataFrame:
    lines = cleaning.add_calendar(sales(spark, root, ["sale_date", "sale_dollars"]))
    return _cents(marts.quarterly_sales(lines), "total_revenue")


@_query
def top_categories(spark: SparkSession, root: str) -> DataFrame:
    lines = sales_by(spark, root, ["category_name"], ["sale_dollars"])
    return _cents(marts.top_categories(lines, 10), "total_revenue")


@_query
def top_categories_display(spark: SparkSession, root: str) -> DataFrame:
    return marts.with_money_text(top_categories(spark, root), "total_revenue")


@_query
def top_products_revenue(spark: SparkSession, root: str) -> DataFrame:
    lines = sales_by(spark, root, ["item_description"], ["sale_dollars"])
    return _cents(marts.top_products_revenue(lines, 20), "total_revenue")


@_query
def top_products_volume(spark: SparkSession, root: str) -> DataFrame:
    lines = sales_by(spark, root, ["item_description"], ["volume_liters"])
    return _cents(marts.top_products_volume(lines, 20), "total_volume")


@_query
def top_counties(spark: SparkSession, root: str) -> DataFrame:
    # The test data has five counties, so three make a real cut.
    lines = sales_by(spark, root, ["county"], ["sale_dollars"])
    return _cents(marts.top_counties(lines, 3), "total_revenue")


@_query
def top_cities(spark: SparkSession, root: str) -> DataFrame:
    lines = sales_by(spark, root, ["city"], ["sale_dollars"])
    return _cents(marts.top_cities(lines, 20), "total_sales")


@_query
def weekday_weekend(spark: SparkSession, root: str) -> DataFrame:
    lines = cleaning.add_calendar(sales(spark, root, ["sale_date", "sale_dollars"]))
    return _cents(marts.weekday_weekend(lines), "total_sales")


@_query
def city_efficiency(spark: SparkSession, root: str) -> DataFrame:
    lines = sales(spark, root, ["city", *INVOICE, "sale_dollars"])
    efficiency = marts.city_efficiency(lines, 20, invoice=INVOICE)
    return _cents(efficiency, "total_sales")


# --- panel and features --------------------------------------------------------------------------

_MEASURES = ("bottles_sold", "sale_dollars", "volume_liters")
_PANEL_INPUT = (*INVOICE, "sale_date", "store_name", "city", "county", "item_description", *_MEASURES)


# What the labels need: no item, so no join with the parts, and no distinct count.
_REVENUE_INPUT = ("sale_date", "store_name", "city", "county", "sale_dollars")


def _panel(spark: SparkSession, root: str, store: str = "supplier") -> DataFrame:
    lines = cleaning.add_calendar(sales(spark, root, _PANEL_INPUT, store))
    return panel.store_month_panel(lines, invoice=INVOICE)


def _revenue_panel(spark: SparkSession, root: str) -> DataFrame:
    lines = cleaning.add_calendar(sales(spark, root, _REVENUE_INPUT))
    return panel.store_month_panel(lines, invoice=None, item=None, bottles=None, liters=None)


def _features(spark: SparkSession, root: str) -> DataFrame:
    """Written once per query, because thresholds and labels read it several times."""
    return materialize(features.store_features(_panel(spark, root)), "features")


def _revenue_features(spark: SparkSession, root: str) -> DataFrame:
    """The features that come from revenue alone, for queries that use no others."""
    rows = features.store_features(_revenue_panel(spark, root), transactions=None, skus=None)
    rows = rows.select(*panel.PANEL_KEYS, "monthly_revenue", "revenue_rolling3")
    return materialize(rows, "revenue-features")


def _revenue_cohort(spark: SparkSession, root: str) -> DataFrame:
    return labels.breakout_labels(_revenue_features(spark, root))


def _stored_revenue_cohort(spark: SparkSession, root: str) -> DataFrame:
    return materialize(_revenue_cohort(spark, root), "revenue-cohort")


def _cohort(spark: SparkSession, root: str) -> DataFrame:
    return labels.breakout_labels(_features(spark, root))


def _stored_cohort(spark: SparkSession, root: str) -> DataFrame:
    """The cohort as a written table, for queries that read it again and again."""
    return materialize(_cohort(spark, root), "cohort")


def _rounded_panel(df: DataFrame) -> DataFrame:
    return _cents(df, "monthly_revenue", "total_liters")


def _rounded_features(df: DataFrame) -> DataFrame:
    return _cents(_rounded_panel(df), "revenue_lag1", "revenue_lag2", "revenue_lag3")


@_query
def store_month_panel(spark: SparkSession, root: str) -> DataFrame:
    return _rounded_panel(_panel(spark, root))


_ROLLED_UP = ("city", "year", "quarter")


def _place() -> Column:
    """A number that brings lines of a month, of a city in it and of a store in that together, nothing more."""
    city = F.shiftleft(F.pmod(F.hash("city"), F.lit(1 << 16)).cast("bigint"), 24)
    store = F.pmod(F.hash("store_name"), F.lit(1 << 24)).cast("bigint")
    return F.shiftleft(features.month_number().cast("bigint"), 40) + city + store


@_query
def distinct_rollups(spark: SparkSession, root: str) -> DataFrame:
    """Distinct invoice lines and items per city and quarter, from the sets of the store-months."""
    lines = cleaning.add_calendar(sales(spark, root, (*INVOICE, "sale_date", "store_name", "city", "county", "item_description")))
    lines = lines.withColumn("place", _place())
    lines = materialize(lines.select(*panel.PANEL_KEYS, "quarter", *INVOICE, "item_description", "place"), "set-lines")
    keys = (*panel.PANEL_KEYS, "quarter")
    counts = []
    for value, out in ((INVOICE, "num_transactions"), (("item_description",), "unique_skus")):
        ids = distinct_sets.dense_ids(lines, value, near=("place",))
        sets = materialize(distinct_sets.distinct_sets(lines, keys, value, ids), "sets")
        counts.append(distinct_sets.set_sizes(sets, _ROLLED_UP, out))
    return counts[0].join(counts[1], list(_ROLLED_UP))


@_query
def panel_stats(spark: SparkSession, root: str) -> DataFrame:
    return panel.panel_stats(_revenue_panel(spark, root))


@_query
def store_features(spark: SparkSession, root: str) -> DataFrame:
    return _rounded_features(features.store_features(_panel(spark, root)))


@_query
def store_features_sparse(spark: SparkSession, root: str) -> DataFrame:
    """Customers as stores: their months have gaps, which the lags step over."""
    return _rounded_features(features.store_features(_panel(spark, root, "customer")))


@_query
def store_features_calendar(spark: SparkSession, root: str) -> DataFrame:
    """Customers as stores, with lags by calendar month: only rows with three months of sales before them."""
    return _rounded_features(features.store_features(_panel(spark, root, "customer"), lag="months"))


@_query
def value_relabel(spark: SparkSession, root: str) -> DataFrame:
    """Mean of every panel and feature column, under its display name where it has one."""
    names = ("monthly_revenue", "total_bottles", *features.FEATURES)
    rows = features.store_features(_panel(spark, root))
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names])
    long = means.unpivot([], list(names), "feature", "mean_value")
    labelled = long.withColumn("feature_label", relabel(F.col("feature"), features.FEATURE_LABELS))
    return _rounded(labelled, 6, "mean_value")


# --- labels and split ----------------------------------------------------------------------------


@_query
def monthly_thresholds(spark: SparkSession, root: str) -> DataFrame:
    return _cents(labels.monthly_thresholds(_revenue_features(spark, root)), "q75")


@_query
def group_quantile_nearest(spark: SparkSession, root: str) -> DataFrame:
    """Median sale per county, straight from the lines: few groups, each with very many values."""
    lines = sales(spark, root, ["county", "sale_dollars"])
    return labels.group_quantile_nearest(
        lines, ["county"], "sale_dollars", 0.5, "median_sale", accuracy=10_000
    )


def _county_quantile(spark: SparkSession, root: str, q: float, method: str) -> DataFrame:
    lines = sales(spark, root, ["county", "sale_dollars"])
    return labels.group_quantile(lines, ["county"], "sale_dollars", q, "quantile", method, accuracy=10_000)


@_query
def group_quantile_linear(spark: SparkSession, root: str) -> DataFrame:
    """Ninth decile of the sale per county, between the two neighbouring sales."""
    return _county_quantile(spark, root, 0.9, "linear")


@_query
def group_quantile_disc(spark: SparkSession, root: str) -> DataFrame:
    """Median sale per county as a sale that occurs, the lower of two."""
    return _county_quantile(spark, root, 0.5, "disc")


@_query
def quartile_labels(spark: SparkSession, root: str) -> DataFrame:
    labelled = labels.quartile_labels(_revenue_features(spark, root))
    return _cents(labelled, "monthly_revenue", "q75").select(
        "store_name", "city", "county", "year", "month", "monthly_revenue", "q75", "is_top_quartile"
    )


@_query
def breakout_labels(spark: SparkSession, root: str) -> DataFrame:
    return _rounded_features(_cents(_cohort(spark, root), "q75"))


@_query
def temporal_cutoff(spark: SparkSession, root: str) -> DataFrame:
    return split.temporal_cutoff(_revenue_cohort(spark, root))


def _split_cohort(spark: SparkSession, root: str) -> DataFrame:
    cohort = _stored_revenue_cohort(spark, root)
    return split.with_split(cohort, split.find_cutoff(cohort))


@_query
def train_test_split(spark: SparkSession, root: str) -> DataFrame:
    return _cents(_split_cohort(spark, root), "monthly_revenue").select(
        "split", "store_name", "city", "county", "year", "month", "monthly_revenue", "is_top_quartile"
    )


@_query
def split_summary(spark: SparkSession, root: str) -> DataFrame:
    return split.split_summary(_split_cohort(spark, root))


# --- models and evaluation -----------------------------------------------------------------------


@_query
def class_weights(spark: SparkSession, root: str) -> DataFrame:
    train, _, _ = split.train_test_split(_stored_revenue_cohort(spark, root))
    return model.class_weights(train)


@_query
def standardized_features(spark: SparkSession, root: str) -> DataFrame:
    """Test rows on the scale of the training rows."""
    train, test, _ = split.train_test_split(_stored_cohort(spark, root))
    scaled = model.Scaler.fit(train).transform(test)
    return _rounded(scaled.select(*panel.PANEL_KEYS, *features.FEATURES), 9, *features.FEATURES)


def _rule_scores(spark: SparkSession, root: str) -> DataFrame:
    """A score without a model: recent mean revenue, flagged where it is in the month's top quarter."""
    cohort = _stored_revenue_cohort(spark, root)
    return labels.quartile_labels(
        cohort, "revenue_rolling3", threshold="rolling_q75", label="prediction"
    )


@_query
def classification_report(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.classification_report(_rule_scores(spark, root))


@_query
def breakout_lift(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.breakout_lift(_rule_scores(spark, root))


@_query
def confusion_matrix(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.confusion_matrix(_rule_scores(spark, root))


@_query
def auc_roc(spark: SparkSession, root: str) -> DataFrame:
    """Area for recent mean revenue as the score."""
    cohort = _stored_revenue_cohort(spark, root)
    return evaluate.auc_roc(cohort, "revenue_rolling3")


_SCORE_COLUMNS = (*panel.PANEL_KEYS, model.LABEL, "prediction", "probability")


@_query
def logistic_scores(spark: SparkSession, root: str) -> DataFrame:
    train, test, _ = split.train_test_split(_stored_cohort(spark, root))
    return model.fit_logistic(train).predict(test).select(*_SCORE_COLUMNS)


@_query
def forest_scores(spark: SparkSession, root: str) -> DataFrame:
    train, test, _ = split.train_test_split(_stored_cohort(spark, root))
    return model.fit_forest(train).predict(test).select(*_SCORE_COLUMNS)


@_query
def feature_importances(spark: SparkSession, root: str) -> DataFrame:
    train, _, _ = split.train_test_split(_stored_cohort(spark, root))
    return model.feature_importances(model.fit_forest(train), train)


FOREST_DEPTH = 8


@_query
def forest_node_scores(spark: SparkSession, root: str) -> DataFrame:
    """The forest's scores by walking its table of nodes."""
    train, test, _ = split.train_test_split(_stored_cohort(spark, root))
    fit = model.fit_forest(train, max_depth=FOREST_DEPTH)
    nodes = materialize(trees.forest_nodes(spark, fit), "nodes")
    scores = trees.node_scores(test, nodes, fit.features, panel.PANEL_KEYS, FOREST_DEPTH)
    return scores.select(*panel.PANEL_KEYS, "probability", "prediction")


@_query
def forest_node_importances(spark: SparkSession, root: str) -> DataFrame:
    """The forest's importances as sums over its table of nodes."""
    train, _, _ = split.train_test_split(_stored_cohort(spark, root))
    fit = model.fit_forest(train, max_depth=FOREST_DEPTH)
    nodes = materialize(trees.forest_nodes(spark, fit), "nodes")
    return trees.node_importances(nodes, fit.features)


@_query
def refreshed_panel(spark: SparkSession, root: str) -> DataFrame:
    """Features of a panel stored without the returned lines of a year, then refreshed with them."""
    lines, places = keyed_sales(spark, root)
    late = (F.col("year") == 1998) & F.col("store_location").isNull()
    lines = cleaning.add_calendar(lines).withColumn("late", late)
    lines = panel.mark_invoices(lines, "late", ("place", "year", "month"), INVOICE)
    lines = lines.select("place", "item", "year", "month", "late", "invoice_mark", *_MEASURES)
    lines = materialize(lines, "panel-lines")
    options = {"places": places, "item": "item", "invoice_mark": "invoice_mark"}
    panel_path, path = scratch_path(spark, "panel-store"), scratch_path(spark, "feature-store")
    panel_store.write_panel(lines.where(~F.col("late")), panel_path, **options)
    panel_store.write_features(spark, panel_path, path)
    changed = panel_store.changed_months(lines.where("late"))
    if changed:
        panel_store.refresh_panel(lines, panel_path, changed, **options)
        panel_store.refresh_features(spark, panel_path, path, min(changed))
    return _rounded_features(spark.read.parquet(path))


@_query
def model_comparison(spark: SparkSession, root: str) -> DataFrame:
    train, test, _ = split.train_test_split(_stored_cohort(spark, root))
    return analysis.model_comparison(analysis.fit_models(train, test))
