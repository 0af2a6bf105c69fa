"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find grouping.

Texts with the same shingle set are one class from the start, so copies never meet each other. Classes
that share a band key are candidates. A bucket with few classes offers all its pairs. A larger one first
offers only the pairs with its centre, the class that shares large buckets with others most often, and most
classes are grouped by that. What is left are buckets that still hold several components: their classes
are dealt to blocks, blocks that share a bucket meet once, and a product of matrices gives the sizes of all
intersections between two blocks. Only links that join components leave a task, so a large group of near
copies costs products of small blocks and no row per pair. Every pair of a bucket is thus compared or
already in one component.

With 40 bands of 5 slots, a pair at similarity 0.8 misses all buckets with probability below 2e-7.
Linked are the pairs whose full shingle sets pass the threshold; shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import textbatch as tb
from tallymart.llm.common import binary_column, id_and_text, list_column, map_texts
from tallymart.llm.components import connected_components
from tallymart.llm.superminhash import band_keys, signatures
from tallymart.session import materialize

SLOTS, BANDS = 200, 40
SMALL_BUCKET = 8
BLOCK_SETS, BLOCK_SHINGLES = 400, 1 << 16
COLUMNS_AT_ONCE = 4096


def shingle_sets(texts: tb.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and how many each has.

    A text with fewer words than ``size`` has its whole word sequence as its only shingle; a text
    without words has none. ASCII letters are lower-cased.
    """
    words = tb.words(texts)
    hashes = tb.span_hashes(tb.LOWER[texts.data], words.starts, words.ends)
    grams, at = tb.ngram_hashes(hashes, words.bounds, size)
    owner = np.searchsorted(words.bounds, at, "right") - 1
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array(
            [int(tb.mix(np.concatenate([hashes[words.bounds[i] : words.bounds[i + 1]], [np.uint64(counts[i])]]) * np.arange(3, 2 * counts[i] + 4, 2, dtype=np.uint64)).sum()) for i in short],
            np.uint64,
        )
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
    return grams, np.bincount(owner, minlength=len(texts))


def _signed(texts: tb.Texts, size: int) -> dict[str, pa.Array]:
    grams, counts = shingle_sets(texts, size)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    keys = band_keys(signatures(grams, counts, SLOTS), BANDS)
    spread = tb.mix(grams ^ np.uint64(0xA24BAED4963EE407))
    return {
        "n_shingles": pa.array(counts, pa.int64()),
        "set_a": pa.array(tb.per_text(grams.view(np.int64), bounds), pa.int64()),
        "set_b": pa.array(tb.per_text(spread.view(np.int64), bounds), pa.int64()),
        "bands": list_column(keys.view(np.int64).ravel(), np.full(len(texts), BANDS), pa.int64()),
    }


def _packed(texts: tb.Texts, size: int) -> dict[str, pa.Array]:
    grams, counts = shingle_sets(texts, size)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return {"shingles": binary_column([grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])])}


def _linked(percent: int):
    """Tasks over pairs with both shingle sets: the pairs that the threshold links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(batch.schema.get_field_index(c)) for c in ("shingles_a", "shingles_b"))
            linked = []
            for i in range(len(batch)):
                a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            pairs = batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            yield pairs

    return run


def _sets(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id and shingles of every different set that the documents ``ids`` have."""
    wanted = texts.join(ids.hint("merge"), "doc_id", "left_semi")  # the same plan at every size
    sets = materialize(map_texts(wanted, lambda t: _packed(t, size), "shingles binary"), "sets")
    return sets.where("doc_id is not null").dropDuplicates(["doc_id", "shingles"])


def linked_pairs(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets pass the threshold.

    Sets are made once per text. Joins go by one side at a time. A text with very many pairs makes one large
    key in the second join, which adaptive execution splits, since only the other side's row is repeated.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = _sets(texts, ids, size)
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"shingles_{name}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    return materialize(both.mapInArrow(_linked(percent), "a long, b long"), "linked")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by products of 0-1 matrices."""
    keys = np.concatenate([*left, *right])
    _, column = np.unique(keys, return_inverse=True)
    row_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    row_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    column_a, column_b = column[: len(row_a)], column[len(row_a) :]
    n = int(column.max()) + 1
    both = (np.bincount(column_a, minlength=n) > 0) & (np.bincount(column_b, minlength=n) > 0)
    place = np.cumsum(both) - 1
    total = np.zeros((len(left), len(right)), np.float32)
    in_a, in_b = both[column_a], both[column_b]
    row_a, column_a, row_b, column_b = row_a[in_a], place[column_a[in_a]], row_b[in_b], place[column_b[in_b]]
    for low in range(0, int(both.sum()), COLUMNS_AT_ONCE):
        matrices = []
        for rows, columns, height in ((row_a, column_a, len(left)), (row_b, column_b, len(right))):
            some = (columns >= low) & (columns < low + COLUMNS_AT_ONCE)
            matrix = np.zeros((height, COLUMNS_AT_ONCE), np.float32)
            matrix[rows[some], columns[some] - low] = 1
            matrices.append(matrix)
        total += matrices[0] @ matrices[1].T
    return total.astype(np.int64)


def _joined_components(parts_a: np.ndarray, parts_b: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links between components that join all that linked sets join, without a circle."""
    at_a, at_b = np.nonzero(linked)
    pairs = np.unique(np.stack([parts_a[at_a], parts_b[at_b]], axis=1), axis=0).tolist()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _between_blocks(percent: int):
    """Tasks over pairs of blocks: links between components, at most one per component of the two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(len(batch)):
                sides = []
                for name in ("members_a", "members_b"):
                    members = batch.column(batch.schema.get_field_index(name))[i].values
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.field("shingles")]
                    sides.append((members.field("component").to_numpy(), sets))
                (parts_a, sets_a), (parts_b, sets_b) = sides
                common = _shared(sets_a, sets_b)
                either = np.array([len(x) for x in sets_a])[:, None] + np.array([len(x) for x in sets_b])[None, :] - common
                linked = (100 * common >= percent * either) & (parts_a[:, None] != parts_b[None, :])
                found += _joined_components(parts_a, parts_b, linked)
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links_between_components(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components with linked classes in one bucket.

    ``rows`` are the members (bucket, class, n_shingles, component) of buckets with several components. Each
    class goes into one block, with others of its largest bucket; classes of that bucket's main component
    are in blocks of their own. Two blocks meet if any bucket has classes in both, unless both are of one
    component, and all their sets are compared at once. Blocks hold a bounded number of sets and shingles
    on average, and every pair of classes in a bucket is in one component or in blocks that meet.
    """
    sizes = rows.groupBy("bucket", "component").count()
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("size"))
    placed = rows.join(main.hint("merge"), "bucket")
    homes = placed.groupBy("class").agg(
        F.max_by(F.struct("bucket", "main"), F.struct("size", "bucket")).alias("home"),
        F.max("n_shingles").alias("n_shingles"),
        F.max("component").alias("component"),
    )
    whole = F.when(F.col("component") == F.col("home.main"), F.col("component"))
    homes = materialize(homes.select("class", "component", "n_shingles", F.col("home.bucket").alias("home"), whole.alias("whole")), "homes")
    key = F.concat_ws(":", "home", F.coalesce(F.col("whole").cast("string"), F.lit("rest")))
    homes = homes.withColumn("key", key)
    counts = homes.groupBy("key").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks")
    )
    number = F.pmod(F.xxhash64("class", F.lit(31)), F.col("blocks"))
    dealt = homes.join(counts.hint("merge"), "key")
    dealt = materialize(dealt.select("class", "component", "whole", F.concat_ws(":", "key", number).alias("block")), "dealt")

    sets = _sets(texts, dealt.select(F.col("class").alias("doc_id")).distinct(), size)
    member = F.struct("component", "shingles")
    members = sets.withColumnRenamed("doc_id", "class").join(dealt.hint("merge"), "class")
    blocks = materialize(members.groupBy("block").agg(F.collect_list(member).alias("members")), "blocks")

    held = rows.select("bucket", "class").join(dealt.hint("merge"), "class").select("bucket", "block", "whole").distinct()
    held = materialize(held, "held")
    other = held.select("bucket", F.col("block").alias("other"), F.col("whole").alias("whole_b"))
    meeting = held.join(other.hint("merge"), "bucket").where("block <= other and not coalesce(whole = whole_b, false)")
    meeting = materialize(meeting.select("block", "other").distinct(), "meeting")
    first = blocks.select("block", F.col("members").alias("members_a"))
    second = blocks.select(F.col("block").alias("other"), F.col("members").alias("members_b"))
    both = meeting.join(first.hint("merge"), "block").join(second.hint("merge"), "other").select("members_a", "members_b")
    return materialize(both.mapInArrow(_between_blocks(percent), "a long, b long"), "between")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Two documents are linked if their sets of ``size``-word shingles share ``percent`` per cent of
    their union or more; ``component_id`` is the smallest id reachable, and the document with that id
    is kept. NULL and empty texts have no shingles and stay alone; rows with the same id count as one
    document; a row without id is kept, with NULL component. Other columns are not read.
    """
    texts = id_and_text(docs, id_col, text_col)
    texts = texts.withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = materialize(
        map_texts(texts, lambda t: _signed(t, size), "n_shingles long, set_a long, set_b long, bands array<long>"),
        "signatures",
    )
    key = ["n_shingles", "set_a", "set_b"]
    with_set = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(with_set.groupBy(*key).agg(F.min("doc_id").alias("class"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("class", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(buckets.hint("merge"), "bucket"), "members")

    close = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    in_small = (
        members.where(f"size <= {SMALL_BUCKET}")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("class", "n_shingles"))).alias("all"))
        .select(F.explode(F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (y["class"] > x["class"]) & close(x["n_shingles"], y["n_shingles"])), lambda y: F.struct(x["class"].alias("a"), y["class"].alias("b")))))).alias("pair"))
        .select("pair.*")
    )
    large = members.where(f"size > {SMALL_BUCKET}").select("bucket", "class", "n_shingles")
    large = large.join(large.groupBy("class").count().hint("merge"), "class")
    most = large.groupBy("bucket").agg(F.max_by("class", F.struct("count", -F.col("class"))).alias("centre"))
    large = materialize(large.drop("count").join(most.hint("merge"), "bucket"), "large")
    to_centre = large.where("class <> centre").select(F.col("centre").alias("a"), F.col("class").alias("b"))
    pairs = materialize(in_small.union(to_centre).distinct(), "pairs")
    links = linked_pairs(pairs, texts, size, percent)
    found = connected_components(links)

    labelled = large.join(found.withColumnRenamed("node", "class"), "class", "left")
    labelled = labelled.select("bucket", "class", "n_shingles", F.coalesce("component", "class").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_rows = materialize(labelled.join(mixed.select("bucket").hint("merge"), "bucket"), "open")
    if open_rows.limit(1).count():
        found = connected_components(links.union(links_between_components(open_rows, texts, size, percent)))

    named = classes.select(*key, "class").join(found.withColumnRenamed("node", "class"), "class", "left")
    named = named.select(*key, F.coalesce("component", "class").alias("component_id"))
    rows = signed.select("doc_id", *key).join(named, key, "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
