"""Collocations: phrases of two or three words whose parts occur together more often than apart.

Counting. Each task counts the phrases of a few megabytes of text at a time, deals them to buckets by the
hash of the whole phrase, and hands on one compressed, sorted run per bucket. A bucket holds the phrases
of a fixed amount of text on average, and no word, pair or language has a bucket to itself, so hot ones
do not make a large task. A task that merges a bucket's runs drops phrases below the least count at
once. That loses nothing: every part of a phrase occurs at least as often as the phrase.

Streams. What is left is one stream of phrases of one to three words with their counts. In prefix order
(first word, second, third) each phrase comes after its first word and after its first two words, so
one walk over the sorted stream in step with itself puts the counts of the left parts beside every
phrase, without a table in memory. Sorted again in suffix order (last word first), the same walk gives
the counts of the right parts. Both orders are range partitions over all three words, so a word that
begins a third of all phrases is spread over many tasks. A partition may begin behind the word or the
pair its first phrases belong to; these are at most two keys per partition, and are looked up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm import textbatch as tb
from tallymart.llm.common import ship
from tallymart.session import materialize

MIN_COUNT = 10
SHARE = 50
TOP = 2_000
UNKNOWN = "und"

SLICE_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
HELD_PHRASES = 500_000

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True

_RUN = "bucket long, lang string, phrases binary, counts binary"
_KEYS = ["k1", "k2", "k3"]


def _vocabulary(data: np.ndarray, inside: np.ndarray, words: tb.Spans) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order, and the number of each word of the texts in that order."""
    offsets = np.zeros(len(words.starts) + 1, np.int32)
    np.cumsum(words.ends - words.starts, out=offsets[1:])
    column = pa.Array.from_buffers(pa.binary(), len(words.starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = column.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def count_phrases(texts: tb.Texts) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """Phrases of one to three words, each with a line feed behind it, their counts, and their hashes.

    The phrase without words stands for the number of words. Phrases stay inside a piece of a text.
    """
    data = tb.LOWER[texts.data]
    inside = ~_GAP[data]
    words = tb.runs(texts, inside)
    if not len(words.starts):
        return None
    vocabulary, ids = _vocabulary(data, inside, words)
    size = len(vocabulary)
    piece = np.cumsum(_BREAK[data])[words.starts] + words.owner
    joined = piece[1:] == piece[:-1]
    ones = np.bincount(ids, minlength=size)
    at = np.flatnonzero(joined)
    pairs, pair_of, twos = np.unique(ids[at] * size + ids[at + 1], return_inverse=True, return_counts=True)
    ahead = np.flatnonzero(np.append(joined, False)[at + 1])
    triples, threes = np.unique(pair_of[ahead] * size + ids[at[ahead] + 2], return_counts=True)

    last = pc.binary_join_element_wise(vocabulary, b"", b"\n")
    take = lambda column, index: column.take(pa.array(index))
    first, second, third = pairs // size, pairs % size, triples % size
    heads = pc.binary_join_element_wise(take(vocabulary, first), take(vocabulary, second), b" ")
    phrases = pa.concat_arrays([
        pa.array([b"\n"], pa.binary()),
        last,
        pc.binary_join_element_wise(take(vocabulary, first), take(last, second), b" "),
        pc.binary_join_element_wise(take(heads, triples // size), take(last, third), b" "),
    ])

    _, ends, raw = vocabulary.buffers()
    ends = np.frombuffer(ends, np.int32)[: size + 1].astype(np.int64)
    word_hash = tb.span_hashes(np.frombuffer(raw, np.uint8)[: ends[-1]], ends[:-1], ends[1:])
    step = np.uint64(0x9E3779B97F4A7C15)
    pair_hash = tb.mix(word_hash[first] * step + word_hash[second])
    triple_hash = tb.mix(pair_hash[triples // size] * step + word_hash[third])
    counts = np.concatenate([[len(ids)], ones, twos, threes])
    return phrases, counts, np.concatenate([[np.uint64(0)], word_hash, pair_hash, triple_hash])


def _runs(buckets: int):
    """Tasks over (lang, text): one row per slice of text, language and bucket."""

    def counted(lang: str, texts: tb.Texts) -> Iterator[tuple[int, str, bytes, bytes]]:
        found = count_phrases(texts)
        if found is None:
            return
        phrases, counts, hashes = found
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        phrases = phrases.take(pa.array(order))
        counts, bucket = counts[order].astype("<u4"), bucket[order]
        _, ends, raw = phrases.buffers()
        ends, raw = np.frombuffer(ends, np.int32), memoryview(raw)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        press = zstandard.ZstdCompressor(level=3).compress
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(bucket[low]), lang, press(raw[ends[low] : ends[high]]), press(counts[low:high].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                column = batch.column(1).filter(pc.equal(langs.indices, code))
                for _, part in tb.slices(tb.from_arrow(column), SLICE_BYTES):
                    rows = list(counted(lang, part))
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.binary()))],
                            ["bucket", "lang", "phrases", "counts"],
                        )

    return run


def _opened(phrases: bytes, counts: bytes) -> pa.Table:
    data = np.frombuffer(zstandard.decompress(phrases), np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.table({"phrase": column, "f": np.frombuffer(zstandard.decompress(counts), "<u4").astype(np.int64)})


def _summed(parts: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(parts).group_by("phrase").aggregate([("f", "sum")])
    return pa.table({"phrase": total["phrase"], "f": total["f_sum"]})


def _merged(min_count: int):
    """Tasks over runs sorted by bucket and language: the phrases of each bucket with their counts."""

    def finished(lang: str, parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        total = _summed(parts)
        total = total.filter(pc.greater_equal(total["f"], min_count))
        for part in total.combine_chunks().to_batches():
            names = pc.binary_slice(part.column("phrase"), 0, -1).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), names, part.column("f")], ["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, held = None, [], 0
        for batch in batches:
            for bucket, lang, phrases, counts in zip(*(batch.column(i) for i in range(4))):
                key = bucket.as_py(), lang.as_py()
                if current is not None and key != current:
                    yield from finished(current[1], parts)
                    parts, held = [], 0
                current = key
                parts.append(_opened(phrases.as_py(), counts.as_py()))
                held += len(parts[-1])
                if held > HELD_PHRASES and len(parts) > 1:
                    parts = [_summed(parts)]
                    held = min(len(parts[0]), HELD_PHRASES // 2)
        if current is not None:
            yield from finished(current[1], parts)

    return run


def phrase_counts(texts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase and f of all phrases of up to three words in (lang, text) that occur often enough.

    The empty phrase has the number of words of the language.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + total // BUCKET_BYTES
    runs = texts.select("lang", "text").mapInArrow(_runs(buckets), _RUN)
    dealt = runs.repartition(min(buckets, 100_000), "bucket").sortWithinPartitions("bucket", "lang")
    return dealt.mapInArrow(_merged(min_count), "lang string, phrase string, f long")


def _filled(values: np.ndarray, known: np.ndarray, carried: int | None) -> tuple[pa.Array, int | None]:
    """Each value replaced by the last known one at or before it; ``carried`` stands before the first."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    out = np.where(at >= 0, values[at], carried or 0)
    missing = (at < 0) & (carried is None)
    last = int(values[at[-1]]) if len(at) and at[-1] >= 0 else carried
    return pa.array(out, pa.int64(), mask=missing), last


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beside every phrase of a sorted partition the counts of its first key and of its first two keys."""
    outer = inner = None
    for batch in batches:
        names = batch.schema.names
        counts = batch.column(names.index("f")).to_numpy(zero_copy_only=False)
        size = 1 + sum(batch.column(names.index(k)).is_valid().to_numpy(zero_copy_only=False).astype(int) for k in _KEYS[1:])
        first, outer = _filled(counts, size == 1, outer)
        both, inner = _filled(counts, size == 2, inner)
        yield pa.RecordBatch.from_arrays([*batch.columns, first, both], [*names, "outer", "inner"])


def lockstep(stream: DataFrame, keys: list[Column], outer: str, inner: str) -> DataFrame:
    """``stream`` (lang, f, ...) with the counts of the phrases made of its first key and first two keys.

    ``keys`` are three columns; phrases of fewer words have NULL in the last ones, and sort first.
    """
    keyed = stream.withColumns(dict(zip(_KEYS, keys)))
    dealt = keyed.repartitionByRange("lang", *_KEYS).sortWithinPartitions("lang", *_KEYS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    walked = materialize(dealt.mapInArrow(_walk, f"{schema}, outer long, inner long"), "walked")

    def looked_up(depth: int, name: str) -> DataFrame:
        """The keys that a partition began without: at most one per partition, so they are broadcast."""
        names = ["lang", *_KEYS[:depth]]
        pending = walked.where(F.col(name).isNull() & F.col(f"k{depth + 1}").isNotNull()).select(*names).distinct()
        whole = walked.where(F.col(f"k{depth}").isNotNull() & F.col(f"k{depth + 1}").isNull())
        return F.broadcast(whole.select(*names, F.col("f").alias(f"late_{name}")).join(F.broadcast(pending), names, "left_semi"))

    done = walked.join(looked_up(1, "outer"), ["lang", "k1"], "left").join(looked_up(2, "inner"), ["lang", "k1", "k2"], "left")
    return done.select(
        *stream.columns,
        F.coalesce("outer", "late_outer").alias(outer),
        F.when(F.col("k3").isNotNull(), F.coalesce("inner", "late_inner")).alias(inner),
    )


def _score(l: Column, r: Column) -> Column:
    """floor(1000000 * f * f / (l * r)), in whole decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(1_000_000).cast("decimal(7,0)") * (wide(F.col("f")) * wide(F.col("f")))
    return F.call_function("div", top, wide(l) * wide(r))


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    min_count: int = MIN_COUNT,
    share: int = SHARE,
    top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two or three words.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks
    and tabs. A phrase with count ``a`` of ``min_count`` or more is scored by its weakest cut into a left part
    of count l and a right part of count r: 1000000 * a * a / (l * r), rounded down. A phrase inside a longer
    one that has at least ``share`` percent of its count is dropped. Ties go to the higher count, then the
    phrase in byte order. NULL texts are empty, NULL languages are ``und``; repeated rows count each. A
    language without such phrases, and an empty table, give no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN))
    texts = docs.select(lang.alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    counts = materialize(phrase_counts(texts, min_count), "phrase_counts")

    word = F.split("phrase", " ")
    stream = counts.where(F.col("phrase") != "").withColumn("size", F.size(word))
    left = lockstep(stream, [F.get(word, F.lit(i)) for i in range(3)], "left_1", "left_2")
    both = lockstep(left, [F.get(word, F.col("size") - i) for i in (1, 2, 3)], "right_1", "right_2")

    tail = lambda n: F.substring_index("phrase", " ", n)
    triples = both.where(F.col("size") == 3)
    inside = [
        triples.where(F.lit(100) * F.col("f") >= F.lit(share) * F.col(f"{side}_2")).select("lang", tail(n).alias("phrase"))
        for side, n in (("left", 2), ("right", -2))
    ]
    dropped = inside[0].unionAll(inside[1]).distinct()

    def cut(l: str, r: str, k: int) -> Column:
        return F.struct(_score(F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))

    lowest = F.when(F.col("size") == 2, cut("left_1", "right_1", 1)).otherwise(
        F.least(cut("left_1", "right_2", 1), cut("left_2", "right_1", 2))
    )
    kept = both.where("size > 1").join(dropped, ["lang", "phrase"], "left_anti")
    scored = kept.select("lang", "phrase", F.col("f").alias("a"), lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = counts.where(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
