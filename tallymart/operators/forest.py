"""A random forest over many rows, grown from blocks that hold one byte per row and feature.

The algorithm is that of Spark ML: split candidates from a bounded sample, Poisson bootstrap, a random subset of
features per node, Gini gain, equal leaves merged; the result is a model of the library. The library keeps a count
per row and tree as an object on disk or in memory, and walks maps of objects for each. Here the counts are drawn
again at every level, from the seed, the tree and the block, and NumPy counts the classes per node, feature and
bin. A level is one pass over the blocks; what is shuffled is a table of counts per tree and task, whatever the
number of rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.columns import exact
from tallymart.session import materialize, scratch_path

# What runs in the executors goes there as code, so that they need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Columns of numbers of a block stay in the cache of a core.
BLOCK_ROWS = 65_536
# Trees counted in one task: their tables are in memory together, about 1 MB a tree at depth 8.
TREES_PER_TASK = 25
# Nodes are places in arrays of two to the power of the depth.
DEEPEST = 12
MOST_BINS = 256
_BLOCK = "part int, piece int, n int, bins binary, classes binary"
_COUNTS = "tree int, counts binary"
_BEST = (
    "tree int, node int, feature int, bin int, gain double, left0 bigint, left1 bigint, total0 bigint, total1 bigint"
)
_NODE = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, "
    "rawCount bigint, gain double, leftChild int, rightChild int, "
    "split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def can_grow(estimator: RandomForestClassifier, classes: Sequence[int]) -> bool:
    """Whether ``fit`` knows these settings and classes."""
    return (
        sorted(classes) == [0, 1]
        and 1 <= estimator.getMaxDepth() <= DEEPEST
        and estimator.getMaxBins() <= MOST_BINS
        and estimator.getFeatureSubsetStrategy() in ("sqrt", "all")
    )


def fit(
    estimator: RandomForestClassifier,
    rows: DataFrame,
    dealt: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    weights: Sequence[float],
    n_rows: int,
) -> RandomForestClassificationModel:
    """The model of ``estimator`` on ``rows``; ``weights`` are those of class 0 and 1.

    ``dealt`` are the same rows, dealt to tasks and sorted: the bootstrap follows from the place of a row.
    """
    label, depth, seed = estimator.getLabelCol(), estimator.getMaxDepth(), estimator.getSeed() % 2**64
    thresholds = split_candidates(rows, features, keys, label, weights, n_rows, estimator.getMaxBins(), seed)
    blocks = materialize(binned_blocks(dealt, features, label, thresholds), "forest-blocks")
    picked = math.ceil(math.sqrt(len(features))) if estimator.getFeatureSubsetStrategy() == "sqrt" else len(features)
    grown = Grown.roots(estimator.getNumTrees(), depth, len(features), picked, seed)
    least, bagged = estimator.getMinInstancesPerNode(), estimator.getBootstrap()
    for level in range(depth):
        if not grown.open.any():
            break
        grown.split(level, best_splits(blocks, grown, level, thresholds, weights, least, seed if bagged else None), weights)
    return _as_model(rows.sparkSession, estimator, grown, thresholds, weights, len(features))


# --- split candidates and blocks -----------------------------------------------------------------


def split_candidates(
    rows: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    label: str,
    weights: Sequence[float],
    n_rows: int,
    max_bins: int,
    seed: int,
) -> list[np.ndarray]:
    """Ascending thresholds per feature, as the library finds them, from a sample of the size it takes.

    The sample, about the greater of ``max_bins`` squared and 10,000 rows, comes to the driver. It follows from the
    keys and the seed.
    """
    wanted = max(max_bins**2, 10_000)
    if wanted < n_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(str(seed)), *keys), F.lit(n_rows)) < wanted)
    sample = _plain(rows, features, label).toArrow()
    weight = np.asarray(weights)[sample.column(len(features)).to_numpy()]
    return [_thresholds(sample.column(i).to_numpy(), weight, min(max_bins, n_rows)) for i in range(len(features))]


def _plain(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Features and label under plain names; a feature that is NULL or NaN fails the query."""

    def known(name: str):
        value = exact(name).cast("double")
        missing = F.raise_error(F.lit(f"{name} is NULL or NaN in some rows"))
        return F.when(value.isNull() | F.isnan(value), missing).otherwise(value)

    return rows.select(*[known(f).alias(f"x{i}") for i, f in enumerate(features)], exact(label).cast("int").alias("y"))


def _thresholds(values: np.ndarray, weight: np.ndarray, max_bins: int) -> np.ndarray:
    """Middles between neighbouring values: all of them, or those nearest to equal steps of weight."""
    distinct, place = np.unique(values, return_inverse=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) < max_bins:
        return middles
    seen = np.cumsum(np.bincount(place, weight))
    stride = weight.sum() / max_bins
    target, found = stride, []
    for i, middle in enumerate(middles):
        if abs(seen[i] - target) < abs(seen[i + 1] - target):
            found.append(middle)
            target += stride
    return np.array(found)


def binned_blocks(
    dealt: DataFrame, features: Sequence[str], label: str, thresholds: Sequence[np.ndarray], block_rows: int | None = None
) -> DataFrame:
    """One row per block: task and piece, rows, the bins of each feature after the other, and the classes."""
    most = block_rows or BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            made = np.concatenate(held, axis=1)
            columns = [[part], [piece], [made.shape[1]], [made[:-1].tobytes()], [made[-1].tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "piece", "n", "bins", "classes"]
            )

        for batch in batches:
            binned = np.empty((len(thresholds) + 1, batch.num_rows), np.uint8)
            for i, cuts in enumerate(thresholds):
                binned[i] = np.searchsorted(cuts, batch.column(i).to_numpy(), side="left")
            binned[-1] = batch.column(len(thresholds)).to_numpy()
            held.append(binned)
            n += batch.num_rows
            if n >= most:
                yield block()
                piece, held, n = piece + 1, [], 0
        if n:
            yield block()

    return _plain(dealt, features, label).mapInArrow(run, _BLOCK)


# --- counting and choosing -----------------------------------------------------------------------


def _poisson_tables() -> tuple[np.ndarray, np.ndarray]:
    """Cumulated probabilities of Poisson(1), and the count for each 16-bit cell of the unit; 255 where it needs more bits."""
    at_most = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(25)])
    edges = np.arange(65537) / 65536
    low, high = np.searchsorted(at_most, edges[:-1], "right"), np.searchsorted(at_most, edges[1:], "left")
    return at_most, np.where(low == high, low, 255).astype(np.uint8)


def bootstrap(n: int, at_most: np.ndarray, cells: np.ndarray, *seed: int) -> np.ndarray:
    """How often each of ``n`` rows is drawn: Poisson with mean 1, the same for the same ``seed``."""
    raw = np.random.PCG64(seed)
    drawn = raw.random_raw(n // 4 + 1).view(np.uint16)[:n]
    counts = cells.take(drawn)
    unsure = np.flatnonzero(counts == 255)
    finer = (raw.random_raw(len(unsure)) >> np.uint64(11)) * 2.0**-53
    counts[unsure] = np.searchsorted(at_most, (drawn[unsure] + finer) / 65536, "right")
    return counts


@dataclass(frozen=True)
class TreePlan:
    """What a task needs of one tree at one level. Nodes are numbered from 1, the children of i are 2 i and 2 i + 1."""

    tree: int
    feature: np.ndarray  # of the nodes above; a leaf sends all rows left
    bin: np.ndarray
    slot: np.ndarray  # number among the open nodes of the level, or -1
    picked: np.ndarray  # (open nodes, features of a node)


class Buffers:
    """Arrays that are used again from tree to tree, as new ones cost more than the work on them."""

    def __init__(self) -> None:
        self.size = 0

    def of(self, n: int) -> list[np.ndarray]:
        if n > self.size:
            self.size, self.held = n, [np.empty(n, kind) for kind in (np.int64, np.int64, np.int64, np.uint8, np.uint8)]
        return [b[:n] for b in self.held]


def _count(
    plan: TreePlan, level: int, x: np.ndarray, classes: np.ndarray, counts: np.ndarray, n_bins: int, buffers: Buffers
) -> np.ndarray:
    """Rows per picked feature, class, open node and bin; each row counts as often as ``counts`` says."""
    n, open_nodes = len(classes), len(plan.picked)
    at = np.flatnonzero(counts)
    place, node, cells, value, cut = buffers.of(len(at))
    # No index can lie outside, and only without that check NumPy writes into the buffer.
    node.fill(1)
    start = plan.feature * n
    for _ in range(level):
        start.take(node, out=place, mode="clip")
        place += at
        x.take(place, out=value, mode="clip")
        plan.bin.take(node, out=cut, mode="clip")
        np.greater(value, cut, out=cut.view(bool))
        node += node
        node += cut
    node -= 1 << level
    slot = plan.slot.take(node, out=node, mode="clip")
    if (plan.slot < 0).any():
        kept = slot >= 0
        at, slot = at[kept], slot[kept]
        place, _, cells, value, _ = buffers.of(len(at))
    weight = counts.take(at).astype(np.float64)
    np.copyto(cells, classes.take(at))
    cells *= open_nodes
    cells += slot
    cells *= n_bins
    out = []
    for starts in np.ascontiguousarray(plan.picked.T) * n:
        starts.take(slot, out=place, mode="clip")
        place += at
        x.take(place, out=value, mode="clip")
        np.add(cells, value, out=place)
        out.append(np.bincount(place, weight, 2 * open_nodes * n_bins))
    return np.array(out)


def _counting(plans: Sequence[TreePlan], level: int, n_bins: int, seed: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, tables, buffers = {}, _poisson_tables(), Buffers()
        for batch in batches:
            for part, piece, n, bins, classes in zip(*batch.columns):
                x, y = np.frombuffer(bins.as_buffer(), np.uint8), np.frombuffer(classes.as_buffer(), np.uint8)
                for plan in plans:
                    if seed is None:
                        drawn = np.ones(n.as_py(), np.uint8)
                    else:
                        drawn = bootstrap(n.as_py(), *tables, seed, 1, plan.tree, part.as_py(), piece.as_py())
                    counted = _count(plan, level, x, y, drawn, n_bins, buffers)
                    if plan.tree in sums:
                        sums[plan.tree] += counted
                    else:
                        sums[plan.tree] = counted
        for tree, counted in sums.items():
            # Sums of whole numbers, exact in floating point; they fit 32 bits but for a task of a billion rows.
            small = counted.max() < 2**32
            columns = [pa.array([tree], pa.int32()), pa.array([counted.astype("<u4" if small else "<u8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "counts"])

    return run


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    return 1.0 - (a / total) * (a / total) - (b / total) * (b / total)


def _choosing(plans: Mapping[int, TreePlan], level: int, n_splits: np.ndarray, n_bins: int, weights: Sequence[float], least: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        plan = plans[tree]
        open_nodes, picks = plan.picked.shape
        cells = picks * 2 * open_nodes * n_bins
        counts = np.zeros(cells, np.int64)
        for value in table.column("counts"):
            buffer = value.as_buffer()
            counts += np.frombuffer(buffer, "<u4" if buffer.size == 4 * cells else "<u8").astype(np.int64)
        counts = counts.reshape(picks, 2, open_nodes, n_bins).transpose(2, 0, 1, 3)
        left = counts.cumsum(axis=3)
        total = left[..., -1:]
        left = left[..., :-1]
        right = total - left
        (l0, r0, t0), (l1, r1, t1) = ((left[:, :, c] * weights[c], right[:, :, c] * weights[c], total[:, :, c] * weights[c]) for c in (0, 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = _gini(t0, t1) - (l0 + l1) / (t0 + t1) * _gini(l0, l1) - (r0 + r1) / (t0 + t1) * _gini(r0, r1)
        there = np.arange(n_bins - 1) < n_splits[plan.picked][..., None]
        enough = (left.sum(axis=2) >= least) & (right.sum(axis=2) >= least)
        gain = np.where(there & enough & (gain >= 0), gain, -np.inf).reshape(open_nodes, -1)
        best = gain.argmax(axis=1)
        nodes = np.arange(open_nodes)
        pick, cut = np.divmod(best, n_bins - 1)
        chosen, whole = left[nodes, pick, :, cut], total[:, 0, :, 0]
        return pa.table(
            {
                "tree": pa.array(np.full(open_nodes, tree, np.int32)),
                "node": pa.array((np.flatnonzero(plan.slot >= 0) + (1 << level)).astype(np.int32)),
                "feature": pa.array(plan.picked[nodes, pick].astype(np.int32)),
                "bin": pa.array(cut.astype(np.int32)),
                "gain": pa.array(gain[nodes, best]),
                "left0": pa.array(chosen[:, 0]),
                "left1": pa.array(chosen[:, 1]),
                "total0": pa.array(whole[:, 0]),
                "total1": pa.array(whole[:, 1]),
            }
        )

    return run


def best_splits(
    blocks: DataFrame,
    grown: Grown,
    level: int,
    thresholds: Sequence[np.ndarray],
    weights: Sequence[float],
    least: int,
    seed: int | None,
) -> pa.Table:
    """One row per open node of the level, its best split and counts; they come to the driver, as the model does."""
    plans = grown.plans(level)
    n_splits = np.array([len(t) for t in thresholds])
    n_bins = max(2, n_splits.max() + 1)
    groups = [plans[i : i + TREES_PER_TASK] for i in range(0, len(plans), TREES_PER_TASK)]
    counts = None
    for group in groups:
        part = blocks.mapInArrow(_counting(group, level, n_bins, seed), _COUNTS)
        counts = part if counts is None else counts.union(part)
    choosing = _choosing({p.tree: p for p in plans}, level, n_splits, n_bins, weights, least)
    return counts.groupBy("tree").applyInArrow(choosing, _BEST).toArrow()


# --- the trees in the driver ---------------------------------------------------------------------


@dataclass(frozen=True)
class Grown:
    """All trees as arrays of (tree, node): open and split nodes, their splits, gains and counts per class."""

    picked: np.ndarray
    open: np.ndarray
    inner: np.ndarray
    failed: np.ndarray  # looked at, without any split that leaves enough rows
    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    counts: np.ndarray

    @classmethod
    def roots(cls, trees: int, depth: int, n_features: int, n_picked: int, seed: int) -> Grown:
        shape = (trees, 2 << depth)
        picked = np.empty((*shape, n_picked), np.int64)
        for tree in range(trees):
            order = np.random.PCG64((seed, 0, tree)).random_raw(shape[1] * n_features).reshape(shape[1], n_features)
            picked[tree] = np.sort(order.argsort(axis=1, kind="stable")[:, :n_picked], axis=1)
        flags = [np.zeros(shape, bool) for _ in range(3)]
        flags[0][:, 1] = True
        return cls(picked, *flags, np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape), np.zeros((*shape, 2), np.int64))

    def plans(self, level: int) -> list[TreePlan]:
        first = 1 << level
        plans = []
        for tree in np.flatnonzero(self.open.any(axis=1)):
            here = self.open[tree, first : 2 * first]
            slot = np.where(here, here.cumsum() - 1, -1)
            bins = np.where(self.inner[tree, :first], self.bin[tree, :first], 255).astype(np.uint8)
            plans.append(TreePlan(int(tree), self.feature[tree, :first], bins, slot, self.picked[tree, first : 2 * first][here]))
        return plans

    def split(self, level: int, best: pa.Table, weights: Sequence[float]) -> None:
        """Take over the splits of a level and open the children that can be split again."""
        tree, node, feature, cut, gain, left0, left1, total0, total1 = (c.to_numpy() for c in best.columns)
        self.open[:] = False
        self.counts[tree, node] = np.stack([total0, total1], axis=1)
        self.failed[tree, node] = np.isinf(gain)
        self.inner[tree, node] = gain > 0
        kept = gain > 0
        tree, node, left0, left1 = tree[kept], node[kept], left0[kept], left1[kept]
        self.feature[tree, node], self.bin[tree, node], self.gain[tree, node] = feature[kept], cut[kept], gain[kept]
        for child, a, b in ((2 * node, left0, left1), (2 * node + 1, total0[kept] - left0, total1[kept] - left1)):
            self.counts[tree, child] = np.stack([a, b], axis=1)
            mixed = np.abs(_gini(a * weights[0], b * weights[1])) >= np.finfo(float).eps
            self.open[tree, child] = mixed & (4 << level < self.open.shape[1])


def _as_model(
    spark: SparkSession,
    estimator: RandomForestClassifier,
    grown: Grown,
    thresholds: Sequence[np.ndarray],
    weights: Sequence[float],
    n_features: int,
) -> RandomForestClassificationModel:
    """A model of the library: it writes a forest of bare roots with all settings, whose nodes are replaced."""
    rows = [(Vectors.dense([0.0] * n_features), label, 1.0) for label in (0, 1)]
    named = spark.createDataFrame(rows, [estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getWeightCol()])
    path = scratch_path(spark, "forest")
    estimator.fit(named).write().overwrite().save(path)
    nodes = [(tree, node) for tree in range(len(grown.open)) for node in _nodes(grown, tree, thresholds, weights)]
    spark.createDataFrame(nodes, _NODE, verifySchema=False).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def _nodes(grown: Grown, tree: int, thresholds: Sequence[np.ndarray], weights: Sequence[float]) -> list[tuple]:
    """The library's rows of a tree: parents before children, left before right, equal leaves merged."""
    found: list[tuple] = []

    def prediction(node: int) -> float:
        a, b = grown.counts[tree, node] * weights
        return float(b > a)

    def whole(node: int) -> float | None:
        """The one prediction of all leaves under the node, if there is only one."""
        if not grown.inner[tree, node]:
            return prediction(node)
        left, right = whole(2 * node), whole(2 * node + 1)
        return left if left == right else None

    def add(node: int) -> int:
        place = len(found)
        found.append(())
        stats = grown.counts[tree, node] * weights
        inner = whole(node) is None
        failed = grown.failed[tree, node]
        left, right, gain, split = -1, -1, -1.0, (-1, [], -1)
        if inner:
            left, right = add(2 * node), add(2 * node + 1)
            feature = int(grown.feature[tree, node])
            gain, split = float(grown.gain[tree, node]), (feature, [float(thresholds[feature][grown.bin[tree, node]])], -1)
        impurity = -1.0 if failed else float(_gini(*stats))
        raw = int(grown.counts[tree, node].sum())
        found[place] = (place, prediction(node), impurity, [float(s) for s in stats], raw, gain, left, right, split)
        return place

    add(1)
    return found
