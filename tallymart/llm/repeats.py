"""Exact removal of repeated byte strings, by suffix buckets with cover samples.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too. So only suffixes
up to that depth matter, and the work is done bucket by bucket, never on one array of all suffixes:

1. Every string of ``LENGTH`` bytes is represented by one anchor in it, the GRAM-byte gram of least
   hash (winnowing). Equal strings have equal anchors at equal places, so an anchor's value names a
   bucket of suffixes, and buckets with one anchor occurrence are dropped. A bucket in which the
   anchor represents the very same run of strings everywhere is settled: all of them repeat.
2. Around each anchor of the other buckets, cover samples stand every COVER bytes. Each represents the COVER suffixes
   before it, which all contain the block behind the sample (the core). The rank of a sample is the
   class of its core over the whole corpus.
3. Two suffixes of a bucket are equal if their samples' ranks are equal and the few bytes before and
   after the core are. These bytes are compared directly; long ties are settled by the rank alone.

Samples with the same rank and the same surrounding bytes are one class, counted by partial
aggregation, so copies never meet; suffixes are compared one by one only where a rank has several
classes. All grouping is by key with partial sums, joins may be split, and no task holds a bucket.
Blocks and bytes are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import textbatch as tb
from tallymart.llm.common import id_and_text, list_column, map_texts
from tallymart.session import materialize as _materialize

LENGTH = 200
GRAM = 48
COVER = 32

_GRAMS = LENGTH - GRAM + 1  # grams in a string
_CORE = LENGTH - COVER + 1  # bytes in all strings of a sample
_SIDE = COVER - 1
_PLACE_BITS = np.uint64(28)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return _materialize(df, name, compression="zstd")


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring keys, from prefix and suffix minima of blocks."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: tb.Texts) -> tuple[np.ndarray, ...]:
    """Value, place, first string and number of strings of every anchor, and anchors per text.

    Places and strings are byte positions within the text. The strings of one anchor are neighbours.
    """
    none = np.zeros(0, np.int64)
    n = len(texts.data)
    if n >= 1 << int(_PLACE_BITS):
        raise ValueError(f"a text of {n} bytes: places are held in {int(_PLACE_BITS)} bits, so texts must be under 256 MiB")
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none, np.zeros(len(texts), np.int64)
    at = np.arange(n - GRAM + 1)
    grams = tb.span_hashes(texts.data, at, at + GRAM)
    # Of equal hashes the last counts, so the place stands in the lower bits, turned round.
    keys = (grams >> _PLACE_BITS << _PLACE_BITS) | (np.uint64(2**28 - 1) - at.astype(np.uint64))
    least = _sliding_least(keys, _GRAMS)
    chosen = (2**28 - 1 - (least & np.uint64(2**28 - 1)).astype(np.int64))
    string = np.arange(len(chosen))
    owner = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))[: len(chosen)]
    inside = string + LENGTH <= texts.offsets[owner + 1]
    string, chosen, owner = string[inside], chosen[inside], owner[inside]
    if not len(string):
        return none.astype(np.uint64), none, none, none, np.zeros(len(texts), np.int64)
    new = np.ones(len(string), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(string)))
    base = texts.offsets[owner[first]]
    return grams[chosen[first]], chosen[first] - base, string[first] - base, times, np.bincount(owner[first], minlength=len(texts))


def _scan(texts: tb.Texts) -> dict[str, pa.Array]:
    value, place, first, times, counts = anchors(texts)
    packed = place << 16 | (place - first) << 8 | times
    start = np.repeat(texts.offsets[:-1], counts) + first
    runs = tb.span_hashes(texts.data, start, start + times - 1 + LENGTH) if len(start) else value
    digests = [hashlib.sha256(texts.data[a:b]).hexdigest() for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
    return {
        "n_bytes": pa.array(np.diff(texts.offsets), pa.int64()),
        "text_sha256": pa.array(digests, pa.string()),
        "values": list_column(value.view(np.int64), counts, pa.int64()),
        "packed": list_column(packed, counts, pa.int64()),
        "runs": list_column(runs.view(np.int64), counts, pa.int64()),
    }


def _samples(data: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, present strings (bit t: the one starting t bytes before), core hash and side bytes of samples."""
    place, back, times = packed >> 16, packed >> 8 & 255, packed & 255
    first = place - back
    found = []
    for k in range(-(-_GRAMS // COVER)):
        start = place - COVER * k
        low = np.maximum(start - (first + times - 1), 0)  # least and most distance of a string before it
        high = np.minimum(start - first, _SIDE)
        some = (low <= high) & (high >= 0)
        mask = ((np.int64(1) << (high[some] + 1)) - 1) & ~((np.int64(1) << low[some]) - 1)
        found.append((start[some], mask))
    start, mask = (np.concatenate(x) for x in zip(*found))
    core = tb.span_hashes(data, start, start + _CORE)
    padded = np.concatenate([np.zeros(_SIDE, np.uint8), data, np.zeros(_SIDE, np.uint8)])
    side = np.arange(_SIDE)
    left = padded[start[:, None] + side]
    right = padded[start[:, None] + _SIDE + _CORE + side]
    return start, mask, core, left, right


def _fixed_binary(rows: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * _SIDE)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


_SAMPLE = "row_key long, start int, present long, core long, before binary, after binary"


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tb.from_arrow(batch.column(1))
        for i in range(len(batch)):
            anchor = np.asarray(batch.column(2)[i].values)
            packed = anchor[anchor & 1 == 0] >> 1
            if not len(packed):
                continue
            start, mask, core, left, right = _samples(texts.data[texts.offsets[i] : texts.offsets[i + 1]], packed)
            keys = np.full(len(start), batch.column(0)[i].as_py(), np.int64)
            columns = [
                pa.array(keys), pa.array(start, pa.int32()), pa.array(mask), pa.array(core.view(np.int64)),
                _fixed_binary(left), _fixed_binary(right),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row_key", "start", "present", "core", "before", "after"])


def removed_bytes(size: int, anchor: np.ndarray, starts: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Flags of the bytes covered by repeated strings.

    These are the runs of settled anchors (bit 0 set), and ``starts - t`` for every bit ``t`` of ``masks``.
    """
    change = np.zeros(size + 1, np.int64)
    packed = anchor[anchor & 1 == 1] >> 1
    first = (packed >> 16) - (packed >> 8 & 255)
    np.add.at(change, first, 1)
    np.add.at(change, first + (packed & 255) - 1 + LENGTH, -1)
    for t in range(COVER):
        at = starts[masks >> t & 1 == 1] - t
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tb.from_arrow(batch.column(1))
        sizes, removed, spans, digests = [], [], [], []
        for i in range(len(batch)):
            data = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
            anchor, starts, masks = (np.asarray(batch.column(k)[i].values) for k in (2, 3, 4))
            gone = removed_bytes(len(data), anchor, starts.astype(np.int64), masks)
            sizes.append(len(data))
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            digests.append(hashlib.sha256(data[~gone]).hexdigest())
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The scanned rows that share no anchor, and (row_key, doc_id, text, anchor, starts, masks) of those that do.

    See :func:`removed_bytes` for what the lists say. Tables are written with strong compression, as
    they and the shuffles are what bounds the size of a run.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    keyed = texts.withColumn("row_key", F.xxhash64("doc_id", "text"))
    scanned = materialize(map_texts(keyed, _scan, "n_bytes long, text_sha256 string, `values` array<long>, packed array<long>, runs array<long>"), "anchors")
    each = scanned.select("row_key", F.explode(F.arrays_zip("values", "packed", "runs")).alias("a"))
    occurrences = each.select("row_key", F.col("a.values").alias("value"), F.col("a.packed").alias("packed"))
    buckets = each.groupBy(F.col("a.values").alias("value")).agg(
        F.count("*").alias("n"), F.min("a.runs").alias("low"), F.max("a.runs").alias("high")
    )
    buckets = buckets.where("n > 1").select("value", F.when(F.col("low") == F.col("high"), 1).otherwise(0).alias("settled"))
    held = occurrences.join(buckets.hint("merge"), "value").select("row_key", (F.col("packed") * 2 + F.col("settled")).alias("anchor"))
    held = held.groupBy("row_key").agg(F.collect_set("anchor").alias("anchor"))
    candidates = materialize(keyed.join(held.hint("merge"), "row_key").select("row_key", "doc_id", "text", "anchor"), "candidates")

    samples = candidates.select("row_key", "text", "anchor").mapInArrow(_sampler, _SAMPLE)
    samples = samples.withColumn("around", F.xxhash64("present", "before", "after"))
    classes = samples.groupBy("core", "around").agg(
        F.count("*").alias("times"), F.first("present").alias("present"), F.first("before").alias("before"), F.first("after").alias("after")
    )
    classes = materialize(classes, "classes")
    mixed = classes.groupBy("core").agg(F.count("*").alias("n"), F.min("times").alias("least")).where("n > 1 and least = 1").select("core")
    offsets = F.expr(f"filter(sequence(0, {_SIDE}), t -> (shiftright(present, t) & 1L) = 1L)")
    strings = (
        classes.join(mixed.hint("merge"), "core")
        .select("core", "around", "times", "before", "after", F.explode(offsets).alias("t"))
        .select("core", "around", "times", "t", F.xxhash64("core", "t", F.expr(f"substring(before, {_SIDE} - t + 1, t)"), F.expr(f"substring(after, 1, {_SIDE} - t)")).alias("string"))
    )
    strings = materialize(strings, "strings")
    again = strings.groupBy("string").agg(F.sum("times").alias("n")).where("n > 1").select("string")
    found = strings.join(again.hint("merge"), "string").groupBy("core", "around").agg(F.expr("bit_or(shiftleft(1L, t))").alias("mask"))
    whole = classes.where("times > 1").select("core", "around", F.col("present").alias("mask"))
    single = found.join(classes.where("times = 1").select("core", "around"), ["core", "around"], "left_semi")
    repeated = whole.union(single.select("core", "around", "mask"))
    marks = samples.select("row_key", "start", "core", "around").join(repeated.hint("merge"), ["core", "around"])
    marks = marks.select("row_key", F.struct("start", "mask").alias("m")).groupBy("row_key").agg(F.collect_set("m").alias("m"))
    marks = marks.select("row_key", F.transform("m", lambda m: m["start"]).alias("starts"), F.transform("m", lambda m: m["mask"]).alias("masks"))
    rest = scanned.join(candidates.select("row_key").distinct().hint("merge"), "row_key", "left_anti")
    return rest, candidates.join(marks.hint("merge"), "row_key", "left").withColumns(
        {"starts": F.coalesce("starts", F.array().cast("array<int>")), "masks": F.coalesce("masks", F.array().cast("array<long>"))}
    )


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    NULL counts as empty. Texts under LENGTH bytes keep all. Rows that repeat, also with the same id, are
    copies: each loses what the other has. Ids may be NULL. Other columns are not read.
    """
    rest, hit = repeated_strings(docs, id_col, text_col)
    cut = hit.select("doc_id", "text", "anchor", "starts", "masks").mapInArrow(_cutter, _RESULT)
    none = F.lit(0).cast("long")
    return cut.union(rest.select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("text_sha256").alias("kept_sha256")))
