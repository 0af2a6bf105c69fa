"""A fitted forest as a table of nodes: scores by walking the levels with joins, importances as sums.

The table holds all there is to a forest, so scores can be explained row by row (which leaf of which tree),
compared between forests, and checked without the library that fitted it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.columns import exact
from tallymart.operators.model import ForestFit
from tallymart.session import scratch_path


def forest_nodes(spark: SparkSession, fit: ForestFit) -> DataFrame:
    """One row per node: tree, node, parent, is_leaf, feature, threshold, left, right, gain, weight, share.

    ``weight`` is the summed weight of the training rows that came to the node, ``share`` that of class 1 among
    them. A row goes ``left`` if its feature is at most the threshold. The root is node 0.
    """
    path = scratch_path(spark, "forest")
    fit.model.write().overwrite().save(path)
    stored = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    name = F.element_at(F.array(*[F.lit(f) for f in fit.features]), F.col("split.featureIndex") + 1)
    weight = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    leaf = F.col("leftChild") < 0
    nodes = stored.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        leaf.alias("is_leaf"),
        F.when(~leaf, name).alias("feature"),
        F.when(~leaf, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(~leaf, F.col("leftChild")).alias("left"),
        F.when(~leaf, F.col("rightChild")).alias("right"),
        F.when(~leaf, F.col("gain")).alias("gain"),
        weight.alias("weight"),
        F.try_divide(F.col("impurityStats")[1], weight).alias("share"),
    )
    parents = nodes.where(~F.col("is_leaf")).select(
        "tree", F.col("node").alias("parent"), F.explode(F.array("left", "right")).alias("node")
    )
    return nodes.join(parents, ["tree", "node"], "left")


def leaves(df: DataFrame, nodes: DataFrame, features: Sequence[str], keys: Sequence[str], depth: int) -> DataFrame:
    """keys, tree, node and share: the leaf of every tree that each row comes to.

    Each row becomes one per tree, and each of ``depth`` levels is a join with the nodes. Their number follows
    from the trees and their depth, not from the data; Spark broadcasts them by their size.
    """
    trees = nodes.agg(F.max("tree")).first()[0] + 1
    # By number: a look-up by name would compare texts for every row, tree and level.
    values = F.array(*[exact(f).cast("double") for f in features])
    number = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int") - 1
    at = df.select(*keys, values.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    at = at.withColumn("node", F.lit(0))
    steps = nodes.select("tree", "node", "is_leaf", number.alias("number"), "threshold", "left", "right")
    for _ in range(depth):
        below = F.when(F.get("_x", F.col("number")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        stepped = at.join(steps, ["tree", "node"])
        at = stepped.select(*keys, "_x", "tree", F.when(F.col("is_leaf"), F.col("node")).otherwise(below).alias("node"))
    ended = at.join(nodes.select("tree", "node", "is_leaf", "share"), ["tree", "node"])
    unfinished = F.raise_error(F.lit(f"a tree is deeper than {depth} levels"))
    return ended.select(*keys, "tree", "node", F.when(F.col("is_leaf"), F.col("share")).otherwise(unfinished).alias("share"))


def node_scores(df: DataFrame, nodes: DataFrame, features: Sequence[str], keys: Sequence[str], depth: int) -> DataFrame:
    """keys, prediction and probability: the mean share of class 1 over the leaves a row comes to."""
    scored = leaves(df, nodes, features, keys, depth).groupBy(*keys).agg(F.avg("share").alias("probability"))
    return scored.select(*keys, (F.col("probability") > 0.5).cast("int").alias("prediction"), "probability")


def node_importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature and importance: each tree's gains times weights, as shares of the tree, then of all trees."""
    inner = nodes.where(~F.col("is_leaf"))
    per_tree = inner.groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gained"))
    totals = per_tree.groupBy("tree").agg(F.sum("gained").alias("total"))
    shares = per_tree.join(totals, "tree").groupBy("feature").agg(F.sum(F.try_divide("gained", "total")).alias("share"))
    every = nodes.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    filled = every.join(shares, "feature", "left").select("feature", F.coalesce("share", F.lit(0.0)).alias("share"))
    whole = filled.agg(F.sum("share")).scalar()
    return filled.select("feature", F.try_divide("share", whole).alias("importance")).orderBy(F.col("importance").desc(), "feature")
