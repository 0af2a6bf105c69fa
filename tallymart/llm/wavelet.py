"""Token ids as wavelet matrices: one succinct, compressed file per shard of documents.

A wavelet matrix stores ``n`` ids as bit planes, highest bit first. Plane by plane the ids are
stably split into those with a 0 and those with a 1. With running counts of ones, a token is read by
following one bit per plane, and the same walk answers how often a token occurs before a position
(rank), in total (count), and where its k-th occurrence is (select), all without unpacking the ids.

A shard holds whole documents in ascending id order, at most ``SHARD_TOKENS`` tokens unless one
document alone is longer. Shards are written by Spark as rows of Parquet files in the shared folder,
so a lost task leaves nothing behind that counts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm import textbatch as tb
from tallymart.llm.chunks import TokenizersEncoder
from tallymart.llm.common import id_and_text
from tallymart.session import materialize

SHARD_TOKENS = 1 << 20
SLICE_BYTES = 8 << 20
BLOCK = 512
END = 0

_MAGIC = b"WVM1"


class WaveletMatrix:
    """Ids below ``2 ** bits`` with access, rank, select, count and decoding."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.bits, self.planes, self.zeros = n, len(planes), planes, zeros
        self._ones: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(int(ids.max()).bit_length() if len(ids) else 0, 1)
        left = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for k in range(bits - 1, -1, -1):
            ones = ((left >> k) & 1).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            low = left[~ones]
            zeros.append(len(low))
            left = np.concatenate([low, left[ones]])
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, each undoes one stable split."""
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits):
            plane = self.bits - 1 - k
            ones = np.unpackbits(self.planes[plane], count=self.n, bitorder="little").view(bool)
            before = np.empty_like(ids)
            before[~ones] = ids[: self.zeros[plane]]
            before[ones] = ids[self.zeros[plane] :] | ids.dtype.type(1 << k)
            ids = before
        return ids

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i >> 3]) >> (i & 7) & 1

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before position ``i``: a block count plus the bits of part of one block."""
        if plane not in self._ones:
            padded = np.zeros(-(-max(len(self.planes[plane]), 1) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(self.planes[plane])] = self.planes[plane]
            counts = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1)
            self._ones[plane] = np.concatenate([[0], np.cumsum(counts)])
        block = i // BLOCK
        bits = np.unpackbits(self.planes[plane][block * BLOCK // 8 : (i + 7) // 8], bitorder="little")
        return int(self._ones[plane][block] + bits[: i - block * BLOCK].sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit = self._bit(plane, i)
            ones = self._rank1(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        low, high = 0, stop
        for plane in range(self.bits):
            a, b = self._rank1(plane, low), self._rank1(plane, high)
            if token >> (self.bits - 1 - plane) & 1:
                low, high = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, stop: int) -> int:
        """Occurrences of ``token`` before position ``stop``."""
        if token >> self.bits:
            return 0
        low, high = self._range(token, stop)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for plane in range(self.bits - 1, -1, -1):
            one = i >= self.zeros[plane]
            target = i - self.zeros[plane] if one else i
            low, high = 0, self.n
            while low < high:  # the smallest prefix with more than `target` such bits ends after the wanted one
                middle = (low + high) // 2
                ones = self._rank1(plane, middle + 1)
                if (ones if one else middle + 1 - ones) > target:
                    high = middle
                else:
                    low = middle + 1
            i = low
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def to_bytes(self) -> bytes:
        """Header, then each plane, compressed where that makes it shorter."""
        pack = zstandard.ZstdCompressor(level=1)
        parts = [_MAGIC, struct.pack("<QI", self.n, self.bits)]
        for plane, zeros in zip(self.planes, self.zeros):
            raw = plane.tobytes()
            small = pack.compress(raw)
            body = small if len(small) < len(raw) else raw
            parts += [struct.pack("<QQ?", zeros, len(body), body is small), body]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> WaveletMatrix:
        data = memoryview(data)
        if bytes(data[:4]) != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits = struct.unpack_from("<QI", data, 4)
        at, planes, zeros = 16, [], []
        unpack = zstandard.ZstdDecompressor()
        for _ in range(bits):
            zero, size, packed = struct.unpack_from("<QQ?", data, at)
            at += 17
            body = data[at : at + size]
            planes.append(np.frombuffer(unpack.decompress(body) if packed else body, np.uint8))
            zeros.append(zero)
            at += size
        return cls(n, planes, zeros)


_SHARD = "part int, shard int, doc_ids array<long>, n_tokens array<int>, total long, matrix binary"


def _writer(make_encoder: Callable[[], TokenizersEncoder]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        ids: list = []
        sizes: list[int] = []
        tokens: list[np.ndarray] = []
        shard, held, part = 0, 0, 0

        def flush() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(tokens))
            row = [
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([held], pa.int64()), pa.array([matrix.to_bytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "doc_ids", "n_tokens", "total", "matrix"])

        for batch in batches:
            texts = tb.from_arrow(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            part = batch.column(2)[0].as_py() if len(batch) else part
            for first, piece in tb.slices(texts, SLICE_BYTES):
                flat, counts = encoder.encode_flat(piece)
                ends = np.cumsum(counts + 1)
                ended = np.full(len(flat) + len(counts), END, np.uint32)
                text = np.ones(len(ended), bool)
                text[ends - 1] = False
                ended[text] = flat
                for k, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                    if tokens and held + b - a > SHARD_TOKENS:
                        yield flush()
                        ids, sizes, tokens, held, shard = [], [], [], 0, shard + 1
                    ids.append(doc_ids[first + k])
                    sizes.append(b - a)
                    tokens.append(ended[a:b])
                    held += b - a
        if tokens:
            yield flush()

    return run


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append id 0, and write shards in ascending id order; return the scan of them.

    ``tokenizer`` is the path of a file for the tokenizers library, present on every machine. Texts are
    range-partitioned by id; NULL texts count as empty, and NULL ids come first.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    return materialize(dealt.mapInArrow(_writer(lambda: TokenizersEncoder.shared(tokenizer)), _SHARD), "shards")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            matrix = WaveletMatrix.from_bytes(row["matrix"].as_buffer())
            data = matrix.decode().astype("<u4").view(np.uint8)
            sizes = np.asarray(row["n_tokens"].values)
            ends = np.cumsum(sizes.astype(np.int64))
            view = memoryview(data)
            crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends)]
            columns = [
                row["doc_ids"].values, pa.array(row["before"].as_py() + ends - sizes, pa.int64()),
                pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the written matrices.

    The only global step is a running sum over one number per shard.
    """
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("part", "shard", "total")
    before = before.select("part", "shard", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("before"))
    placed = shards.select("part", "shard", "doc_ids", "n_tokens", "matrix").join(before, ["part", "shard"])
    return placed.select("doc_ids", "n_tokens", "matrix", "before").mapInArrow(
        _reader, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
