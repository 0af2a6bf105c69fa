"""The whole analysis of one raw transactions table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.operators import categorize, clean, evaluate, features, labels, marts, model, panel
from tallymart.operators import profile, split
from tallymart.session import materialize


class Models(NamedTuple):
    logistic: model.LogisticFit
    forest: model.ForestFit
    logistic_scores: DataFrame
    forest_scores: DataFrame


def profile_reports(profiled: DataFrame) -> dict[str, DataFrame]:
    """What the raw table looks like, from its column profile with bytes."""
    return {
        "column_profile": profiled,
        "size_estimate": profile.size_report(profiled),
        "null_proportions": profile.null_report(profiled),
    }


def sales_reports(sales: DataFrame, invoice_is_unique: bool = False) -> dict[str, DataFrame]:
    """Audits and marts over the cleaned table. Each report is lazy and scans only its columns."""
    return {
        "distinct_categories": categorize.distinct_values(sales, "category"),
        "category_distribution": categorize.category_distribution(sales),
        "uncategorized_audit": categorize.uncategorized_audit(sales),
        "category_mapping_pairs": categorize.category_mapping_pairs(sales),
        "sales_summary": marts.sales_summary(sales),
        "yearly_summary": marts.yearly_summary(sales),
        "quarterly_sales": marts.quarterly_sales(sales),
        "top_categories": marts.top_categories(sales),
        "top_products_revenue": marts.top_products_revenue(sales),
        "top_products_volume": marts.top_products_volume(sales),
        "top_counties": marts.top_counties(sales),
        "top_cities": marts.top_cities(sales),
        "weekday_weekend": marts.weekday_weekend(sales),
        "city_efficiency": marts.city_efficiency(sales, invoice_is_unique=invoice_is_unique),
    }


def breakout_cohort(months: DataFrame) -> DataFrame:
    """Labelled store-months of stores that were below the threshold in their month before.

    The features are written once, because thresholds and labels read them several times.
    """
    return labels.breakout_labels(materialize(features.store_features(months), "features"))


def fit_models(train: DataFrame, test: DataFrame, trees: int = 300) -> Models:
    """Both classifiers fitted on ``train``, with their scores of ``test``.

    The scores are written once; several reports read them.
    """
    logistic = model.fit_logistic(train)
    forest = model.fit_forest(train, trees=trees)
    logistic_scores = materialize(logistic.predict(test), "logistic-scores")
    forest_scores = materialize(forest.predict(test), "forest-scores")
    return Models(logistic, forest, logistic_scores, forest_scores)


def model_comparison(models: Models) -> DataFrame:
    """One row per model: how well it finds breakouts, and its area under the ROC curve."""

    def line(name: str, scores: DataFrame) -> DataFrame:
        area = evaluate.auc_roc(scores).select("auc").scalar()
        return evaluate.breakout_lift(scores).select(F.lit(name).alias("model"), "*", area.alias("auc"))

    return line("logistic regression", models.logistic_scores).union(
        line("random forest", models.forest_scores)
    )


def analyse(
    raw: DataFrame,
    rules: clean.CleaningRules | None = None,
    invoice_is_unique: bool = False,
    trees: int = 300,
    null_threshold: float = 0.10,
) -> dict[str, DataFrame]:
    """Every report of the analysis by name, from a raw table of ``sources.schema`` columns.

    The raw table is read twice: once for its profile, which decides on the columns to drop, and
    once to write the cleaned table all other reports start from.
    """
    rules = rules or clean.CleaningRules()
    profiled = materialize(profile.column_profile(raw, with_bytes=True), "profile")
    over = profile.over_threshold(profile.null_report(profiled), null_threshold).collect()
    sparse = [row.column_name for row in over if row.column_name != rules.date]
    sales = materialize(clean.clean(raw, rules, also_drop=sparse), "sales")
    months = panel.store_month_panel(sales, invoice_is_unique=invoice_is_unique)
    months = materialize(months, "panel")
    cohort = materialize(breakout_cohort(months), "cohort")
    train, test, cutoff = split.train_test_split(cohort)
    models = fit_models(train, test, trees)
    return {
        **profile_reports(profiled),
        **sales_reports(sales, invoice_is_unique),
        "panel_stats": panel.panel_stats(months),
        "temporal_cutoff": split.temporal_cutoff(cohort),
        "split_summary": split.split_summary(split.with_split(cohort, cutoff)),
        "logistic_report": evaluate.classification_report(models.logistic_scores),
        "forest_report": evaluate.classification_report(models.forest_scores),
        "forest_confusion_matrix": evaluate.confusion_matrix(models.forest_scores),
        "feature_importances": model.feature_importances(models.forest, cohort),
        "model_comparison": model_comparison(models),
    }
