"""Exact byte-level BPE in linear time: longest matches with backtracking over compatible neighbours.

The vocabulary's byte strings, read as Latin-1, go into an Aho-Corasick automaton, whose trie gives the
longest match at a place. From the left, the longest token is taken whose pairing with the token before
it could come out of the merges; if none fits, the last token is given up for the next shorter one. Places that were given up are never entered again, so the work is linear.

Two neighbours are compatible if no merge across their border would have come before the merges that
formed them. That is decided by undoing the later of the two tokens' merges step by step, and
remembered for each pair.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallymart.llm import textbatch as tb
from tallymart.llm.chunks import SLICE_BYTES, ChunkCache, split_ids
from tallymart.llm.common import id_and_text, map_rows, map_texts

PAIRS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file with a base64 token and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder for ranks where the rank of a token is the order of its merge."""

    _open: dict[tuple[str, str], "ByteBpe"] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.cache = ChunkCache()
        size = max(ranks.values()) + 1
        self.token: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.place = np.cumsum(self.length) - self.length
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.unreachable: set[int] = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = parts
                    self.merged[parts[0], parts[1]] = rank
                else:
                    self.unreachable.add(rank)
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.named: dict[str, int] = {}
        for token, rank in ranks.items():
            if rank not in self.unreachable:
                self.named[token.decode("latin-1")] = rank
        for name, rank in self.named.items():
            self.automaton.add_word(name, rank)
        self.automaton.make_automaton()
        # For each token the longest token that is a proper prefix of it, or -1.
        self.shorter = [-1] * size
        for name, rank in self.named.items():
            self.shorter[rank] = next((self.named[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in self.named), -1)
        self.sizes = self.length.tolist()
        self.most = int(self.length.max())

    @classmethod
    def shared(cls, path: str, pattern: str) -> ByteBpe:
        """One per Python worker, file and pattern; what it remembers lasts for a task."""
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(read_ranks(path), pattern)
        return cls._open[path, pattern]

    def _merge(self, token: bytes, below: int) -> list[int]:
        """The token after all merges of lower rank, by repeated search; used once per vocabulary entry."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] >= below:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges can leave token ``a`` right before token ``b``."""
        key = (a, b)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            found = self.fits[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        limit = len(self.token)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b or self.left[b] == b:
                if self.right[a] != a:
                    limit, a = a, self.right[a]
                elif self.left[b] != b:
                    limit, b = b + 1, self.left[b]
                else:
                    return True
            else:
                limit, b = b + 1, self.left[b]

    def forget(self) -> None:
        self.cache.clear()
        self.fits.clear()

    def _longest(self, name: str) -> int:
        """The longest token that ``name`` begins with: the trie's deepest path, back to an entry."""
        size = self.automaton.longest_prefix(name)
        named = self.named
        while size:
            if (rank := named.get(name[:size])) is not None:
                return rank
            size -= 1
        return -1

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids that the merges give for one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        name, sizes, fits = piece.decode("latin-1"), self.sizes, self.fits
        n, most, at = len(name), self.most, 0
        dead: set[int] = set()
        ids: list[int] = []
        rank = self._longest(name[:most])
        while at < n:
            while rank >= 0:
                if at + sizes[rank] not in dead:
                    if not ids:
                        break
                    fit = fits.get((ids[-1], rank))
                    if fit or (fit is None and self.compatible(ids[-1], rank)):
                        break
                rank = self.shorter[rank]
            if rank >= 0:
                ids.append(rank)
                at += sizes[rank]
                rank = self._longest(name[at : at + most]) if at < n else -1
            elif ids:
                dead.add(at)
                last = ids.pop()
                at -= sizes[last]
                rank = self.shorter[last]
            else:
                raise ValueError("the vocabulary lacks a single byte of the text")
        return ids

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [array("I", self.encode_piece(piece.encode())).tobytes() for piece in pieces]

    def encode_flat(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        return self.cache.encode_all(texts, self._encode, self.pieces)

    def encode(self, texts: tb.Texts) -> list[bytes]:
        """Ids of every text as little-endian 32-bit integers."""
        return split_ids(*self.encode_flat(texts))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        shift = self.place[ids] - (ends - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(ends[-1] if len(ends) else 0)]


_DECIMAL = [str(i).encode() for i in range(70_000)]


def _digests(texts: tb.Texts, bpe: ByteBpe) -> dict[str, pa.Array]:
    ids, sizes = bpe.encode_flat(texts)
    decoded = bpe.decode(ids)
    stops = np.cumsum(sizes)
    ends = np.concatenate([[0], np.cumsum(bpe.length[ids])])[stops] if len(ids) else np.zeros(len(sizes), np.int64)
    ids_sha, text_sha, start, byte = [], [], 0, 0
    for stop, end in zip(stops.tolist(), ends.tolist()):
        ids_sha.append(hashlib.sha256(b",".join(map(_DECIMAL.__getitem__, ids[start:stop].tolist()))).hexdigest())
        text_sha.append(hashlib.sha256(decoded[byte:end]).hexdigest())
        start, byte = stop, end
    return {"n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)}


def token_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    ``ranks`` is the path of a rank file present on every machine, of at most 70,000 tokens. NULL counts
    as empty, which has no tokens. Every row is encoded alone, so ids may be NULL or repeat. Other
    columns are not read.
    """
    texts = id_and_text(docs, id_col, text_col)
    return map_texts(
        texts,
        lambda part: _digests(part, ByteBpe.shared(ranks, pattern)),
        "n_tokens long, ids_sha256 string, decoded_sha256 string",
        slice_bytes=SLICE_BYTES,
        done=lambda: ByteBpe.shared(ranks, pattern).forget(),
    )


def encode_column(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` and, from decoding them, ``decodes`` (the text comes back) appended.

    Columns of these names that ``docs`` has are replaced.
    """
    docs = docs.drop("token_ids", "decodes")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.shared(ranks, pattern)
        try:
            for batch in batches:
                texts = tb.from_arrow(batch.column(place))
                for first, part in tb.slices(texts, SLICE_BYTES):
                    ids, sizes = bpe.encode_flat(part)
                    if np.array_equal(bpe.decode(ids), part.data):
                        ok = np.full(len(part), True)
                    else:
                        each = np.split(ids, np.cumsum(sizes)[:-1])
                        ok = np.array([bpe.decode(e).tobytes() == part.text(i) for i, e in enumerate(each)])
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(part)).columns, lists, pa.array(ok)], [*batch.schema.names, "token_ids", "decodes"])
        finally:
            bpe.forget()

    return map_rows(docs, run, "token_ids array<int>, decodes boolean")
