"""Connected components of a link table: union-find inside tasks, then min-hooking between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.session import materialize

_LINK = "node long, parent long"


def _task_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's links, batch by batch: at most one row per node and batch leaves."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "parent"]
        )


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node but the smallest of its component, from links (a, b) of longs.

    ``component`` is the smallest node that can be reached. Each task first reduces its links to a
    forest. Then every node hooks to its smallest neighbour and hands its other neighbours to that
    one, until each node has one parent; at last parents are doubled until all point to a root. Each
    round is one aggregation and one join on the node, written to the shared folder. Only two counts
    per round reach the driver.
    """
    edges = links.select("a", "b").where("a <> b").mapInArrow(_task_forest, _LINK)
    forest = materialize(edges, "forest")
    while True:
        sizes = forest.agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes")).first()
        if sizes.n == sizes.nodes:
            break
        smallest = forest.groupBy("node").agg(F.min("parent").alias("least"))
        handed = forest.join(smallest, "node").where("parent > least").select(F.col("parent").alias("node"), F.col("least").alias("parent"))
        forest = materialize(smallest.select("node", F.col("least").alias("parent")).union(handed).distinct(), "forest")
    while True:
        up = forest.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        longer = materialize(
            forest.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")),
            "forest",
        )
        forest = longer.select("node", "parent")
        if not longer.where("moved").limit(1).count():
            return forest.withColumnRenamed("parent", "component")
