"""Benchmark decontamination: BM25 over an index of test items, block-max WAND, overlap verification.

The test items are indexed; every passage of every training text is a query. A contribution of a term
to an item is its BM25 weight divided by the item's score against itself, so 1 means that all of the
item is there, and one threshold serves all items. Passages are windows of words, twice as long as the
longest item and overlapping by half, so an occurrence always lies within one.

Most passages are ruled out in bulk. Of each item, the terms of least weight that together stay below
half the threshold are non-essential: a passage can only reach the threshold if the item's essential
terms in it make up the rest. The passages left run through block-max WAND, which returns every item at or above the
threshold. Those are verified: the trigrams of the item's question (all but its last sentence) and of
its answer (the last sentence) must occur in the passage to a large part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import textbatch as tb
from tallymart.llm.common import id_and_text, list_column, map_rows, ship
from tallymart.session import materialize

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.5
MIN_ITEM_WORDS = 5
POSTING_BLOCK = 16
INDEX_BYTES = 16 << 20
MIN_STRIDE = 64

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capital letters (two bytes from C3) made small."""
    small = tb.LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    small[capital] += 32
    return small


def words_of(texts: tb.Texts) -> tuple[tb.Spans, np.ndarray]:
    """Runs of letters, digits and non-ASCII characters, and their hashes."""
    folded = tb.Texts(fold(texts.data), texts.offsets)
    spans = tb.runs(folded, _WORD[folded.data])
    return spans, tb.span_hashes(folded.data, spans.starts, spans.ends)


def _hashes(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return words_of(tb.Texts(data, np.array([0, len(data)])))[1].tolist()


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence answers; a single sentence is cut after two thirds."""
    cuts = [m.end() for m in re.finditer(r"[.?!]\s+(?=\S)", text)]
    if cuts:
        return text[: cuts[-1]], text[cuts[-1] :]
    words = text.split()
    cut = len(words) - max(len(words) // 3, 1)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _grams(words: list[int]) -> set[tuple[int, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _share(wanted: set[tuple[int, ...]], words: list[int], seen: dict[int, set]) -> float:
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    if n not in seen:
        seen[n] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return len(wanted & seen[n]) / len(wanted)


class Postings:
    """One term: items in ascending order, contributions, and per block the last item and the maximum."""

    def __init__(self, entries: list[tuple[int, float]]):
        self.items = [i for i, _ in entries]
        self.weights = [w for _, w in entries]
        self.top = max(self.weights)
        edges = [*range(0, len(entries), POSTING_BLOCK), len(entries)]
        self.last = [self.items[b - 1] for _, b in pairwise(edges)]
        self.best = [max(self.weights[a:b]) for a, b in pairwise(edges)]


class Statistics(NamedTuple):
    """Of a whole benchmark: items that count, their words, the longest of them, and items per term."""

    n: int
    n_words: int
    longest: int
    frequency: dict[int, int]

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Statistics:
        found = [words for words in (_hashes(text) for _, text in items) if len(words) >= MIN_ITEM_WORDS]
        frequency = Counter(term for words in found for term in set(words))
        return cls(len(found), sum(map(len, found)), max(map(len, found), default=0), dict(frequency))


class Index:
    """BM25 index of items, with contributions as shares of an item's score against itself.

    ``whole`` are the statistics of all items where ``items`` is a block of them, so that an item's scores do
    not depend on the block it is in.
    """

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None):
        whole = whole or Statistics.of(items)
        terms = {i: _hashes(text) for i, text in items}
        self.ids = sorted(i for i, words in terms.items() if len(words) >= MIN_ITEM_WORDS)
        texts = dict(items)
        self.question, self.answer = [], []
        counts: list[dict[int, int]] = []
        for i in self.ids:
            question, answer = split_item(texts[i])
            self.question.append(_grams(_hashes(question)))
            self.answer.append(_grams(_hashes(answer)))
            count: dict[int, int] = {}
            for term in terms[i]:
                count[term] = count.get(term, 0) + 1
            counts.append(count)
        n, frequency = whole.n, whole.frequency
        lengths = [len(terms[i]) for i in self.ids]
        self.stride = max(MIN_STRIDE, whole.longest)
        mean = whole.n_words / max(n, 1)
        idf = {t: math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) for count in counts for t in count}
        entries: dict[int, list[tuple[int, float]]] = {}
        essential: dict[int, list[tuple[int, float]]] = {}
        least: list[float] = []
        for item, count in enumerate(counts):
            norm = K1 * (1 - B + B * lengths[item] / mean)
            weights = {t: idf[t] * tf * (K1 + 1) / (tf + norm) for t, tf in count.items()}
            whole = sum(weights.values())
            spare = 0.0
            for term, weight in sorted(weights.items(), key=lambda x: (x[1], x[0])):
                share = weight / whole
                entries.setdefault(term, []).append((item, share))
                if spare + share < THRESHOLD / 2:
                    spare += share
                else:
                    essential.setdefault(term, []).append((item, share))
            least.append(THRESHOLD - spare)
        self.postings = {t: Postings(e) for t, e in entries.items()}
        order = sorted(essential)
        self.essential = np.array(order, np.uint64)
        # Per essential term the items it is essential for; per item what its essential terms must add up to.
        self.first = np.concatenate([[0], np.cumsum([len(essential[t]) for t in order])]).astype(np.int64)
        self.item = np.array([i for t in order for i, _ in essential[t]], np.int64)
        self.share = np.array([s for t in order for _, s in essential[t]])
        self.least = np.array(least)
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.essential >> np.uint64(44)).astype(np.int64)] = True

    def search(self, query: set[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose contributions from the query's terms reach ``threshold``."""
        lists = [self.postings[t] for t in query if t in self.postings]
        at = [0] * len(lists)
        end = len(self.ids)
        found = []
        need = threshold - 1e-9  # sums in another order may differ in the last bits
        live = list(range(len(lists)))
        while live:
            live.sort(key=lambda k: lists[k].items[at[k]])
            total, pivot = 0.0, -1
            for place, k in enumerate(live):
                total += lists[k].top
                if total >= need:
                    pivot = place
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            ahead = live[: pivot + 1]
            bound, reach = 0.0, end
            for k in ahead:
                block = at[k] // POSTING_BLOCK
                while block < len(lists[k].last) and lists[k].last[block] < item:
                    block += 1
                if block < len(lists[k].last):
                    bound += lists[k].best[block]
                    reach = min(reach, lists[k].last[block] + 1)
            if bound >= need:
                target = item
                if lists[ahead[0]].items[at[ahead[0]]] == item:
                    score = sum(lists[k].weights[at[k]] for k in ahead)
                    if score >= need:
                        found.append((item, score))
                    target = item + 1
            else:  # no item before the end of these blocks, or before the next list, can reach it
                following = lists[live[pivot + 1]].items[at[live[pivot + 1]]] if pivot + 1 < len(live) else end
                target = max(min(reach, following), item + 1)
            for k in ahead:
                items, i = lists[k].items, at[k]
                while i < len(items) and items[i] < target:
                    i += 1
                at[k] = i
            live = [k for k in live if at[k] < len(lists[k].items)]
        return found

    def verify(self, item: int, words: list[int], seen: dict[int, set]) -> tuple[float, float] | None:
        question = _share(self.question[item], words, seen)
        answer = _share(self.answer[item], words, seen)
        return (question, answer) if question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP else None

    def passages(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and word range of the passages that the bulk bound leaves."""
        near = np.flatnonzero(self.hint[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.essential, hashes[near]), max(len(self.essential) - 1, 0))
        hit = self.essential[place] == hashes[near] if len(self.essential) else np.zeros(0, bool)
        near, term = near[hit], place[hit]
        counts = np.diff(bounds)
        windows = -(-counts // self.stride)
        base = np.cumsum(windows) - windows
        owner = np.searchsorted(bounds, near, "right") - 1
        window = (near - bounds[owner]) // self.stride
        earlier = window > 0
        key = np.concatenate([base[owner] + window, (base[owner] + window - 1)[earlier]])
        term = np.concatenate([term, term[earlier]])
        key, term = np.divmod(np.unique(key * max(len(self.essential), 1) + term), max(len(self.essential), 1))
        times = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        pairs, where = np.unique(np.repeat(key, times) * max(len(self.ids), 1) + self.item[at], return_inverse=True)
        sums = np.bincount(where, weights=self.share[at], minlength=len(pairs))
        key, item = np.divmod(pairs, max(len(self.ids), 1))
        left = np.unique(key[sums >= self.least[item] - 1e-9])
        text = np.searchsorted(base + windows, left, "right")
        low = bounds[text] + (left - base[text]) * self.stride
        return text, low, np.minimum(low + 2 * self.stride, bounds[text + 1])

    def matches(self, texts: tb.Texts) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item) -> best verified (score, question overlap, answer overlap)."""
        spans, hashes = words_of(texts)
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for text, low, high in zip(*self.passages(hashes, spans.bounds)):
            words = hashes[low:high].tolist()
            seen: dict[int, set] = {}
            for item, score in self.search(set(words)):
                if (overlap := self.verify(item, words, seen)) is not None:
                    key = (int(text), self.ids[item])
                    found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (score, *overlap))
        return found


_MATCH = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _matcher(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = sent.value
        for batch in batches:
            ids = batch.column(0)
            for first, part in tb.slices(tb.from_arrow(batch.column(1))):
                found = sorted(index.matches(part).items())
                columns = [
                    ids.take(pa.array([first + text for (text, _), _ in found], pa.int64())),
                    pa.array([names[item] for (_, item), _ in found], pa.int64()),
                    *(pa.array([values[k] for _, values in found], pa.float64()) for k in range(3)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, hashes = words_of(tb.from_arrow(batch.column(1)))
        terms = list_column(hashes.view(np.int64), spans.counts, pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, terms], ["item_id", "text", "terms"])


def _indexes(benchmark: DataFrame) -> Iterator[tuple[Index, dict[int, int | None]]]:
    """Indexes of blocks of items, each of about INDEX_BYTES of text, and the item ids of their numbers.

    Each distinct (item_id, text) has a number of its own, so items may share an id or have none. The
    statistics are taken once over all items; a block gets those of its own terms.
    """
    ship(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    termed = items.mapInArrow(_item_terms, "item_id long, text string, terms array<long>").where(F.size("terms") >= MIN_ITEM_WORDS)
    items = materialize(termed.withColumn("number", F.monotonically_increasing_id()), "items")
    whole = items.agg(
        F.count("*").alias("n"), F.sum(F.size("terms")).alias("words"), F.max(F.size("terms")).alias("longest"),
        F.sum(F.octet_length("text")).alias("bytes"),
    ).first()
    if not whole.n:
        return
    each = items.select(F.explode(F.array_distinct("terms")).alias("term"))
    frequency = materialize(each.groupBy("term").agg(F.count("*").alias("n")), "item-terms")
    blocks = -(-whole.bytes // INDEX_BYTES)
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block)
        rows = some.select("number", "item_id", "text").orderBy("number").collect()
        own = some.select(F.explode("terms").alias("term")).distinct()
        counts = {r.term % (1 << 64): r.n for r in frequency.join(own, "term").collect()}
        index = Index([(r.number, r.text) for r in rows], Statistics(whole.n, whole.words, whole.longest, counts))
        yield index, {r.number: r.item_id for r in rows}


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document (doc_id, text) and benchmark item (item_id, text) that it contains.

    An index is broadcast, so items go in blocks of bounded size, and every text is searched once per
    block; statistics are those of all items in every block. Items of fewer than MIN_ITEM_WORDS words are
    no evidence and match nothing, nor do NULL or empty texts and items. Every different item counts, also
    without an id (NULL in the result) or with one that others have. Repeated documents give repeated
    matches, repeated items do not. Other columns are not read.
    """
    texts = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).where("text is not null")
    found = [texts.mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(block)), _MATCH) for block in _indexes(benchmark)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], _MATCH)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text contains no benchmark item."""
    place = docs.columns.index(text_col)

    def cleaner(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, _ = sent.value
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for first, part in tb.slices(tb.from_arrow(batch.column(place))):
                    keep[[first + text for text, _ in index.matches(part)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in _indexes(benchmark):
        docs = map_rows(docs, cleaner(docs.sparkSession.sparkContext.broadcast(block)))
    return docs
