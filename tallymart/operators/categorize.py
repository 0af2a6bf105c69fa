"""Ordered rules that sort free category text into major categories."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.aggregates import n_rows
from tallymart.session import materialize


class Rule(NamedTuple):
    label: str
    words: str  # alternatives, separated by "|", searched anywhere and in any case


# The first rule that matches decides, so the order is part of the meaning.
LIQUOR_RULES = (
    Rule("WHISKEY", "WHISKEY|WHISKIES|WHISKY|BOURBON|SCOTCH"),
    Rule("VODKA", "VODKA"),
    Rule("RUM", "RUM"),
    Rule("TEQUILA & MEZCAL", "TEQUILA|MEZCAL"),
    Rule("GIN", "GIN"),
    Rule("BRANDY & COGNAC", "BRANDY|BRANDIES|COGNAC"),
    Rule("SCHNAPPS", "SCHNAPPS"),
    Rule("LIQUEURS & CORDIALS", "AMARETTO|CORDIAL|LIQUEUR|ANISETTE|CREME|ROCK & RYE|TRIPLE SEC"),
    Rule("SPECIALTY & OTHER SPIRITS", "AMERICAN ALCOHOL|AMERICAN DISTILLED SPIRITS|DISTILLED SPIRITS SPECIALTY|IMPORTED DISTILLED SPIRITS|NEUTRAL GRAIN SPIRITS"),
    Rule("READY-TO-DRINK", "COCKTAIL|RTD"),
    Rule("CRAFT/LOCAL", "IOWA DISTILLER"),
    Rule("ADMINISTRATIVE/NON-PRODUCT", "DECANTERS|DELISTED|SPECIAL ORDER|HIGH PROOF BEER|HOLIDAY VAP|TEMPORARY"),
)
UNCATEGORIZED = "UNCATEGORIZED"


def major_category(
    text: Column, rules: Sequence[Rule] = LIQUOR_RULES, default: str = UNCATEGORIZED
) -> Column:
    """Label of the first matching rule; ``default`` for no match and for NULL."""
    label = F.lit(default)
    for rule in reversed(rules):
        label = F.when(text.rlike(f"(?iu){rule.words}"), F.lit(rule.label)).otherwise(label)
    return label


def categorize(
    df: DataFrame,
    text: str = "category_name",
    label: str = "major_category",
    rules: Sequence[Rule] = LIQUOR_RULES,
    default: str = UNCATEGORIZED,
) -> DataFrame:
    """Add the label row by row; a narrow projection."""
    return df.withColumn(label, major_category(F.col(text), rules, default))


def categorize_by_lookup(
    df: DataFrame,
    text: str = "category_name",
    label: str = "major_category",
    rules: Sequence[Rule] = LIQUOR_RULES,
    default: str = UNCATEGORIZED,
) -> DataFrame:
    """Same result as :func:`categorize`, running the rules once per distinct text.

    Costs a second scan of one column and a join, so it pays off for long rule lists over few
    distinct texts. These are written to the shared folder when this is called, so Spark knows their
    size before it plans the join: few texts are broadcast and the rows of ``df`` stay where they
    are. The join is null-safe.
    """
    names = df.select(F.col(text).alias("_text")).distinct()
    lookup = materialize(categorize(names, "_text", label, rules, default), "category-texts")
    return df.join(lookup, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def by_category(
    df: DataFrame,
    measures: dict[str, Column],
    text: str = "category_name",
    label: str = "major_category",
    rules: Sequence[Rule] = LIQUOR_RULES,
    default: str = UNCATEGORIZED,
) -> DataFrame:
    """Sums or counts per major category, classifying after a first aggregation by text.

    ``measures`` are aggregates that add up (sums, counts). Only one row per distinct text reaches
    the rules, and the aggregation by text combines in the map tasks.
    """
    per_text = df.groupBy(text).agg(*[agg.alias(name) for name, agg in measures.items()])
    return (
        categorize(per_text, text, label, rules, default)
        .groupBy(label)
        .agg(*[F.sum(name).alias(name) for name in measures])
    )


def _rows(weight: str | None) -> Column:
    """Row count, or the sum of the column that holds it where rows are already counted."""
    return n_rows() if weight is None else F.sum(weight)


def category_distribution(
    df: DataFrame, text: str = "category_name", weight: str | None = None
) -> DataFrame:
    """Rows per major category, most frequent first."""
    counts = by_category(df, {"n_sales": _rows(weight)}, text)
    return counts.orderBy(F.col("n_sales").desc(), F.col("major_category"))


def uncategorized_audit(
    df: DataFrame, text: str = "category_name", weight: str | None = None
) -> DataFrame:
    """Category texts no rule matches, with their row counts, most frequent first."""
    counts = df.groupBy(text).agg(_rows(weight).alias("n_sales"))
    left_over = categorize(counts, text).filter(F.col("major_category") == F.lit(UNCATEGORIZED))
    return left_over.select(text, "n_sales").orderBy(
        F.col("n_sales").desc(), F.col(text).asc_nulls_first()
    )


def category_mapping_pairs(df: DataFrame, text: str = "category_name") -> DataFrame:
    """Each distinct category text with its label."""
    return categorize(df.select(text).distinct(), text).orderBy(
        "major_category", F.col(text).asc_nulls_first()
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order, NULL first."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_first())
