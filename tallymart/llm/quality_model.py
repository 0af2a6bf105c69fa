"""Text classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Features of a text are its words, word pairs, and the same for word shapes (runs of one character
class written once: ``THE!!`` is ``A!``), and which of the last words each word echoes, hashed into a
fixed table of weights. A feature's value is its share of the text's features (a little less in very
short texts, which so lean to the bias), so a score does not depend on the length. The bias is fixed to
the log odds of the labels, the score of an empty text. Scoring is one sparse dot
product per text: weights are gathered by hash and averaged.

Training uses at most ``train_rows`` labelled texts. They are dealt to ``shards`` tasks; each runs the
sequential updates on its share, and the weight vectors are averaged. What reaches the driver is one
vector of ``2 ** BITS`` floats per shard, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm import textbatch as tb
from tallymart.llm.common import id_and_text, map_rows, map_texts

BITS = 18
TRAIN_ROWS = 8192
SHARDS = 4
EPOCHS = 2
SCALE = 16.0
DAMPING = 4
ECHO = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = ord("0")
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")


def _shape_hashes(texts: tb.Texts, words: tb.Spans) -> np.ndarray:
    """Hash of each word's shape: classes of its characters, repeats of a class written once."""
    shapes = _SHAPE[texts.data]
    keep = ~tb.SPACE[texts.data]
    keep[1:] &= shapes[1:] != shapes[:-1]
    keep[words.starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return tb.span_hashes(shapes[keep], place[words.starts], place[words.ends])


def _echoes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word, a bit for each of the ECHO words before it in the text that is the same word."""
    bits = np.zeros(len(hashes), np.uint64)
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in range(1, min(ECHO, len(hashes) - 1) + 1):
        same = (hashes[k:] == hashes[:-k]) & (place[k:] >= k)
        bits[k:] |= same.astype(np.uint64) << np.uint64(k - 1)
    return bits


def features(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Slots in the weight table of every feature occurrence, text by text, and their number per text."""
    words = tb.words(texts)
    owners, slots = [], []
    kinds = (tb.span_hashes(texts.data, words.starts, words.ends), _shape_hashes(texts, words))
    for kind, hashes in enumerate(kinds):
        for n in (1, 2):
            grams, at = tb.ngram_hashes(hashes, words.bounds, n)
            salted = tb.mix(grams + np.uint64(2 * kind + n))
            slots.append((salted >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(np.searchsorted(words.bounds, at, "right") - 1)
    echo = _echoes(kinds[0], words.bounds)
    slots.append((tb.mix(echo + np.uint64(99)) >> np.uint64(64 - BITS)).astype(np.int64))
    owners.append(words.owner)
    owner, slot = np.concatenate(owners), np.concatenate(slots)
    order = np.argsort(owner, kind="stable")
    return slot[order], np.bincount(owner, minlength=len(texts))


class Ftrl:
    """Per-coordinate FTRL-proximal state of a logistic regression with a fixed bias."""

    def __init__(self, bias: float) -> None:
        self.bias = bias
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int, importance: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x + self.bias, -30, 30)))
        g = importance * (p - label) * x
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


def _train(rows: list[tuple[bytes, int]]) -> np.ndarray:
    """Weights, and as the last value the bias: the log odds of label 1 among the rows, within (0.05, 0.95)."""
    offsets = np.concatenate([[0], np.cumsum([len(text) for text, _ in rows])]).astype(np.int64)
    texts = tb.Texts(np.frombuffer(b"".join(text for text, _ in rows), np.uint8), offsets)
    labels = np.array([label for _, label in rows])
    share = np.array([max((labels == k).sum(), 1) for k in (0, 1)])
    importance = len(labels) / (2.0 * share)
    prior = min(max(labels.mean(), 0.05), 0.95)
    examples = []
    for _, part in tb.slices(texts):
        slot, counts = features(part)
        for some in np.split(slot, np.cumsum(counts)[:-1]):
            at, times = np.unique(some, return_counts=True)
            examples.append((at, SCALE * times / (len(some) + DAMPING)))
    model = Ftrl(np.log(prior / (1 - prior)))
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            model.update(*examples[i], int(labels[i]), importance[labels[i]])
    return np.append(model.weights(), model.bias).astype(np.float32)


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One weight vector per shard; a task may hold several shards or none."""
    shards: dict[int, list[tuple[int, bytes, int]]] = {}
    for batch in batches:
        texts = tb.from_arrow(batch.column(batch.schema.get_field_index("text")))
        shard, ids, labels = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "doc_id", "label"))
        for k in range(len(batch)):
            shards.setdefault(shard[k], []).append((ids[k], texts.text(k), labels[k]))
    for shard, rows in sorted(shards.items()):
        weights = _train([(text, label) for _, text, label in sorted(rows)])
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([weights.tobytes()], pa.binary())], ["shard", "weights"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most ``train_rows`` labelled texts, picked by a hash of the id.

    ``docs`` has doc_id and text, ``labels`` doc_id and label (0 or 1; others are left out); only ids
    where ``usable`` holds are read. Without any labelled text all weights are 0 and every score is 0.5. The picked ids are
    broadcast: their number is ``train_rows`` at most. Of an id with several texts the first in byte order
    teaches. Shards follow from the id alone, so the weights do not depend on partitions.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    picked = (
        labels.where(usable & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .orderBy(order, "doc_id", "label").limit(train_rows)
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(SHARDS)).cast("int"))
    )
    rows = docs.where("text is not null").join(F.broadcast(picked), "doc_id")
    taught = rows.groupBy("shard", "doc_id", "label").agg(F.min("text").alias("text"))
    shards = taught.repartitionById(SHARDS, F.col("shard")).mapInArrow(_trainer, "shard int, weights binary").collect()
    found = [np.frombuffer(row.weights, np.float32) for row in sorted(shards)]
    return np.mean(found, axis=0) if found else np.zeros((1 << BITS) + 1, np.float32)


def _scores(texts: tb.Texts, table: np.ndarray) -> np.ndarray:
    slot, counts = features(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    running = np.concatenate([[0.0], np.cumsum(table[slot].astype(np.float64))])
    dot = SCALE * (running[bounds[1:]] - running[bounds[:-1]]) / (counts + DAMPING) + table[1 << BITS]
    return 1.0 / (1.0 + np.exp(-np.clip(dot, -30, 30)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` (with a column text) without the text, with ``score``: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return map_texts(docs, lambda texts: {"score": pa.array(_scores(texts, sent.value), pa.float64())}, "score double")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores ``threshold`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in tb.slices(tb.from_arrow(batch.column(place))):
                yield batch.slice(first, len(part)).filter(pa.array(_scores(part, sent.value) >= threshold))

    return map_rows(docs, run)


def quality_scores(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``, learnt from ``labels`` (doc_id, label).

    NULL and empty texts have no features and get the score of the bias. Every row is scored alone, so
    ids may be NULL or repeat. Other columns are not read.
    """
    texts = id_and_text(docs)
    scored = score(texts, fit(texts, labels, usable))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
