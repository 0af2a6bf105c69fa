"""Vectorised work on the bytes of many texts at once, for use inside Spark tasks.

A ``Texts`` is a run of UTF-8 texts in one byte array. Words, lines and their 64-bit hashes come from
whole-array NumPy operations, so no Python code runs per word. Words are maximal runs of characters
other than the six ASCII white-space bytes; a word, line or n-gram never crosses from one text into
the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """Texts ``i`` at ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.offsets = offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def from_arrow(column: pa.Array) -> Texts:
    """The bytes of a string or binary column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = int(offsets[-1]) if len(offsets) else 0
    data = np.frombuffer(data, dtype=np.uint8)[:size] if data is not None and size else np.zeros(0, np.uint8)
    return Texts(data, offsets)


def slices(texts: Texts, most: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """Runs of whole texts of about ``most`` bytes (a longer text stands alone), with their first index."""
    offsets, n, first = texts.offsets, len(texts), 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        low, high = offsets[first], offsets[last]
        yield first, Texts(texts.data[low:high], offsets[first : last + 1] - low)
        first = last


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        if size > 4 * SLICE_BYTES:
            return both[0], both[1]
        _powers, _inverses = both
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[starts:ends]``, from one running polynomial sum."""
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.multiply(_BYTE_CODES[data], powers[: len(data)], out=sums[1:])
    np.add.accumulate(sums, out=sums)
    value = (sums[ends] - sums[starts]) * inverses[starts]
    return mix(value + (ends - starts).astype(np.uint64))


class Spans:
    """Byte spans in reading order; those of text ``i`` are ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        self.starts, self.ends, self.bounds = starts, ends, bounds

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def runs(texts: Texts, inside: np.ndarray) -> Spans:
    """Maximal runs of bytes where ``inside`` holds, cut at the borders of texts."""
    n = len(inside)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = texts.offsets[:-1]
    edges = edges[edges < n]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = texts.offsets[1:]
    last = last[last > 0] - 1
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    return Spans(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, texts.offsets))


def words(texts: Texts) -> Spans:
    return runs(texts, ~SPACE[texts.data])


def lines(texts: Texts) -> Spans:
    """The \\n-split lines of every text, empty ones left out."""
    return runs(texts, texts.data != 10)


def ngram_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each text, and for each the index of its first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    value = hashes[:size].copy()
    for k in range(1, n):
        value = mix(value * np.uint64(_BASE) + hashes[k : k + size])
    whole = np.ones(size, bool)
    for edge in range(1, n):
        cut = bounds[1:-1] - edge
        cut = cut[(cut >= 0) & (cut < size)]
        whole[cut] = False
    at = np.flatnonzero(whole)
    return value[at], at


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's spans."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
