"""Class weights, scaling, logistic regression and random forest on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tallymart.functions.aggregates import n_rows
from tallymart.functions.text import relabel
from tallymart.operators import forest
from tallymart.operators.features import FEATURE_LABELS, FEATURES
from tallymart.operators.panel import PANEL_KEYS

LABEL = "is_top_quartile"


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row per class: rows and balanced weight, all rows / (classes * rows of the class).

    A NULL label is no class and fails the query. The window has no partition key; its input is one
    row per class.
    """
    known = F.when(F.col(label).isNull(), F.raise_error(F.lit(f"{label} is NULL in some rows")))
    df = df.select(known.otherwise(F.col(label)).alias(label))
    everything = Window.partitionBy()
    total = F.sum("n_rows").over(everything)
    classes = F.count(F.lit(1)).over(everything)
    return (
        df.groupBy(label)
        .agg(n_rows().alias("n_rows"))
        .withColumn("class_weight", total / (classes * F.col("n_rows")))
    )


def with_class_weight(
    df: DataFrame, label: str = LABEL, out: str = "class_weight"
) -> tuple[DataFrame, int]:
    """``df`` with each row's balanced weight, and its number of rows.

    Brings one row per class to the driver.
    """
    return _weighted(df, class_weights(df, label).collect(), label, out)


def _weighted(df: DataFrame, classes: Sequence[Row], label: str, out: str = "class_weight") -> tuple[DataFrame, int]:
    weight = F.lit(None).cast("double")
    for row in classes:
        weight = F.when(F.col(label) == row[label], F.lit(row.class_weight)).otherwise(weight)
    return df.withColumn(out, weight), sum(row.n_rows for row in classes)


@dataclass(frozen=True)
class Scaler:
    """Means and population standard deviations of the training columns."""

    means: Mapping[str, float]
    scales: Mapping[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] = FEATURES) -> Scaler:
        """One aggregate over ``df``; one row with two numbers per column comes to the driver."""
        row = df.agg(
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
        ).first()
        # A constant column is centred and not scaled.
        return cls(
            {c: row[f"mean_{c}"] for c in columns}, {c: row[f"std_{c}"] or 1.0 for c in columns}
        )

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Standardised columns, under their own names or as new columns with ``prefix``."""
        return df.withColumns(
            {
                prefix + c: (F.col(c) - F.lit(mean)) / F.lit(self.scales[c])
                for c, mean in self.means.items()
            }
        )


# Fixed by the data, so that a fit does not depend on the machine: enough tasks for small clusters,
# and tasks within memory however many rows there are.
LEAST_TASKS = 16
ROWS_PER_TASK = 1_000_000
# A forest keeps a count per row and tree, about 4 bytes: 1.3 kB a row for 300 trees, 0.4 GB a task.
FOREST_ROWS_PER_TASK = 300_000
# From more rows on, a forest is grown from blocks of bins: the library would keep 25 GB for 20 million rows.
FOREST_MANY_ROWS = LEAST_TASKS * FOREST_ROWS_PER_TASK


def _training_set(df: DataFrame, keys: Sequence[str], n_rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows spread evenly and kept for the passes of an iterative fit.

    The forest draws its bootstrap by partition and place of a row. Hashing on ``keys``, which must be
    unique per row, and sorting by them gives the same rows in the same places on every machine, from
    every input partitioning, and when a lost partition is computed again. (Split candidates come from
    a sample of the rows that MLlib bounds and draws by the seed.)
    """
    return _dealt(df, keys, n_rows, rows_per_task).persist(StorageLevel.MEMORY_AND_DISK)


def _dealt(df: DataFrame, keys: Sequence[str], n_rows: int, rows_per_task: int) -> DataFrame:
    partitions = max(LEAST_TASKS, math.ceil(n_rows / rows_per_task))
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def _scores(predicted: DataFrame, kept: Sequence[str]) -> DataFrame:
    return predicted.select(
        *kept,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability"),
    )


@dataclass(frozen=True)
class LogisticFit:
    scaler: Scaler
    model: LogisticRegressionModel
    features: tuple[str, ...]

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the predicted class and the probability of class 1."""
        return _scores(self.model.transform(_scaled_vector(df, self.scaler, self.features)), df.columns)


def _scaled_vector(df: DataFrame, scaler: Scaler, features: Sequence[str]) -> DataFrame:
    scaled = [f"_scaled_{c}" for c in features]
    assembler = VectorAssembler(inputCols=scaled, outputCol="_features", handleInvalid="error")
    return assembler.transform(scaler.transform(df, "_scaled_")).drop(*scaled)


def fit_logistic(
    train: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    keys: Sequence[str] = PANEL_KEYS,
    c: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-8,
) -> LogisticFit:
    """L2 logistic regression on standardised features with balanced class weights.

    ``c`` is the inverse penalty on the summed loss. Spark averages the loss over the weights, so
    its penalty is 1 / (c * sum of weights), and balanced weights sum to the number of rows.
    """
    scaler = Scaler.fit(train, features)
    weighted, n = with_class_weight(train, label)
    weighted = weighted.select(*keys, *features, label, "class_weight")
    rows = _training_set(_scaled_vector(weighted, scaler, features), keys, n)
    try:
        estimator = LogisticRegression(
            featuresCol="_features",
            labelCol=label,
            weightCol="class_weight",
            regParam=1.0 / (c * n),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
            tol=tol,
        )
        return LogisticFit(scaler, estimator.fit(rows), tuple(features))
    finally:
        rows.unpersist()


@dataclass(frozen=True)
class ForestFit:
    model: RandomForestClassificationModel
    features: tuple[str, ...]

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the predicted class and the probability of class 1."""
        return _scores(self.model.transform(_plain_vector(df, self.features)), df.columns)


def _plain_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="_features", handleInvalid="error"
    )
    return assembler.transform(df)


def fit_forest(
    train: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    keys: Sequence[str] = PANEL_KEYS,
    trees: int = 300,
    max_depth: int = 8,
    min_leaf: int = 10,
    max_bins: int = 128,
    seed: int = 42,
) -> ForestFit:
    """Random forest with balanced class weights.

    Beyond ``FOREST_MANY_ROWS`` rows the same algorithm runs over blocks of bins (``forest``), with draws of its own.
    """
    classes = class_weights(train, label).collect()
    weighted, n = _weighted(train, classes, label)
    weighted = weighted.select(*keys, *features, label, "class_weight")
    estimator = RandomForestClassifier(
        featuresCol="_features",
        labelCol=label,
        weightCol="class_weight",
        numTrees=trees,
        maxDepth=max_depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        maxBins=max_bins,
        # A row's places in all trees would take as much memory again, and be written anew at every level.
        # Walking a tree is a few comparisons, and the fit is the same.
        cacheNodeIds=False,
        seed=seed,
    )
    weights = {row[label]: row.class_weight for row in classes}
    if n > FOREST_MANY_ROWS and forest.can_grow(estimator, list(weights)):
        plain = weighted.drop("class_weight")
        dealt = _dealt(plain, keys, n, FOREST_ROWS_PER_TASK)
        grown = forest.fit(estimator, plain, dealt, features, keys, [weights[0], weights[1]], n)
        return ForestFit(grown, tuple(features))
    rows = _training_set(_plain_vector(weighted, features), keys, n, FOREST_ROWS_PER_TASK)
    try:
        return ForestFit(estimator.fit(rows), tuple(features))
    finally:
        rows.unpersist()


def feature_importances(fit: ForestFit, df: DataFrame) -> DataFrame:
    """Gini importance per feature with its display name, highest first.

    ``df`` only lends its session; the rows are the model's, one per feature.
    """
    rows = list(zip(fit.features, [float(v) for v in fit.model.featureImportances.toArray()]))
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.withColumn("feature_label", relabel(F.col("feature"), FEATURE_LABELS)).orderBy(
        F.col("importance").desc(), "feature"
    )
