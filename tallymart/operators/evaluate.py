"""Quality of a binary prediction. Each report is one small aggregate over the scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.operators.prefix import running_sums

# Display names of class 0 and class 1.
CLASS_NAMES = ("Bottom 75%", "Top Quartile")


def _binary(column: str) -> Column:
    return F.coalesce(F.col(column).isin(0, 1), F.lit(False))


def _all_binary(count: Column, bad: Column, columns: tuple[str, ...]) -> Column:
    """``count``, or an error if any row of the aggregate was neither 0 nor 1."""
    message = F.lit(f"{' or '.join(columns)} is NULL, NaN or not 0 or 1 in some rows")
    return F.when(bad > 0, F.raise_error(message)).otherwise(count)


def _cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row with the four cells: tn, fp, fn, tp. A row that fits none of them fails the query."""

    def cell(actual: int, predicted: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(prediction) == predicted))

    bad = F.count_if(~(_binary(label) & _binary(prediction)))
    cells = {"tn": cell(0, 0), "fp": cell(0, 1), "fn": cell(1, 0), "tp": cell(1, 1)}
    counts = df.agg(*[value.alias(name) for name, value in cells.items()], bad.alias("bad"))
    return counts.select(
        *[_all_binary(F.col(name), F.col("bad"), (label, prediction)).alias(name) for name in cells]
    )


def _rate(part: Column, whole: Column) -> Column:
    """``part / whole``; 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_matrix(
    df: DataFrame, label: str = "is_top_quartile", prediction: str = "prediction"
) -> DataFrame:
    """One row per actual class, one column per predicted class.

    A row whose label or prediction is NULL, NaN or another class fails the query.
    """
    counts = df.groupBy(F.col(label).alias("actual")).agg(
        *[F.count_if(F.col(prediction) == k).alias(f"predicted_{k}") for k in (0, 1)],
        F.count_if(~(_binary(label) & _binary(prediction))).alias("bad"),
    )
    return counts.select(
        "actual",
        *[
            _all_binary(F.col(f"predicted_{k}"), F.col("bad"), (label, prediction)).alias(f"predicted_{k}")
            for k in (0, 1)
        ],
    ).orderBy("actual")


def classification_report(
    df: DataFrame,
    label: str = "is_top_quartile",
    prediction: str = "prediction",
    class_names: tuple[str, str] = CLASS_NAMES,
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, plain and weighted means.

    The accuracy row carries the accuracy under ``f1_score``, as printed reports do.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    measures = _cells(df, label, prediction).select(
        *[
            measure
            for name, hit, wrongly, missed in (("0", tn, fn, fp), ("1", tp, fp, fn))
            for measure in (
                _rate(hit, hit + wrongly).alias(f"precision_{name}"),
                _rate(hit, hit + missed).alias(f"recall_{name}"),
                _rate(2 * hit, 2 * hit + wrongly + missed).alias(f"f1_{name}"),
                (hit + missed).alias(f"support_{name}"),
            )
        ],
        _rate(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        (tn + fp + fn + tp).alias("total"),
    )

    def line(position: int, name: str, values: list[Column], support: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("row_name"),
            values[0].alias("precision"),
            values[1].alias("recall"),
            values[2].alias("f1_score"),
            support.alias("support"),
        )

    kinds = ("precision", "recall", "f1")
    total = F.col("total")
    per_class = {i: [F.col(f"{kind}_{i}") for kind in kinds] for i in (0, 1)}
    plain = [(a + b) / F.lit(2.0) for a, b in zip(per_class[0], per_class[1])]
    weighted = [
        _rate(a * F.col("support_0") + b * F.col("support_1"), total)
        for a, b in zip(per_class[0], per_class[1])
    ]
    none = F.lit(None).cast("double")
    lines = [
        line(1, class_names[0], per_class[0], F.col("support_0")),
        line(2, class_names[1], per_class[1], F.col("support_1")),
        line(3, "accuracy", [none, none, F.col("accuracy")], total),
        line(4, "macro avg", plain, total),
        line(5, "weighted avg", weighted, total),
    ]
    return measures.select(F.inline(F.array(*lines))).orderBy("position")


def breakout_lift(
    df: DataFrame, label: str = "is_top_quartile", prediction: str = "prediction"
) -> DataFrame:
    """One row on class 1: flagged rows, positives, hits, rates, and lift over the base rate."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rates = _cells(df, label, prediction).select(
        (tp + fp).alias("n_flagged"),
        (tp + fn).alias("n_positive"),
        tp.alias("n_hits"),
        _rate(tp + fn, tn + fp + fn + tp).alias("base_rate"),
        _rate(tp, tp + fp).alias("precision"),
        _rate(tp, tp + fn).alias("recall"),
        _rate(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )
    return rates.withColumn("lift", F.try_divide("precision", "base_rate"))


def auc_roc(df: DataFrame, score: str = "probability", label: str = "is_top_quartile") -> DataFrame:
    """One row: size of both classes and the exact area under the ROC curve, ties counting half.

    Rows are combined per score in the map tasks. A running sum over the sorted scores gives the negatives
    below each, so the area is twice a whole number over another, divided once. The area is NULL unless
    both classes occur. A NULL or NaN score, or a label other than 0 and 1, fails the query.
    """
    y = F.col(label).cast("double")
    rows = df.select(F.col(score).cast("double").alias("score"), y.alias("y"))
    usable = F.col("score").isNotNull() & ~F.isnan("score") & _binary("y")
    message = F.lit(f"NULL or NaN {score}, or a {label} other than 0 and 1, in some rows")
    checked = rows.select("y", F.when(usable, F.col("score")).otherwise(F.raise_error(message)).alias("score"))
    per_score = checked.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    ranked = running_sums(per_score, ["score"], {"upto": "neg"})
    # Twice the negatives below, ties counting half: those before this score twice, its own once.
    below = (F.lit(2) * F.col("upto") - F.col("neg")).cast("decimal(19,0)")
    sums = ranked.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_positive"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_negative"),
        F.sum(F.col("pos").cast("decimal(19,0)") * below).alias("won"),
    )
    pairs = F.lit(2).cast("decimal(1,0)") * F.col("n_positive").cast("decimal(18,0)") * F.col("n_negative").cast("decimal(18,0)")
    return sums.select("n_positive", "n_negative", F.try_divide(F.col("won").cast("double"), pairs.cast("double")).alias("auc"))
