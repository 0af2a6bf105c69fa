"""Encoding text chunk by chunk with a bounded cache, for byte-level BPE vocabularies.

The usual splitting pattern of byte-level BPE never puts text before and after a single blank into one
piece unless the blank leads the piece. So a text may be cut before every blank and each chunk encoded
alone. This fails only where a blank stands between two white-space characters (a run of three or
more, or a blank inside a longer run), so texts with such a place are encoded whole. Chunks repeat a
lot, so each distinct chunk of a slice of texts is encoded once and its ids are put in by array index.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from tallymart.llm import textbatch as tb

SLICE_BYTES = 4 << 20
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 200  # what Python needs for an entry beside its bytes
MOST_REMEMBERED = 64
CHUNKS_AT_ONCE = 256
_MARKS = ".,;:!?"

_BEFORE = tb.SPACE.copy()  # bytes that may end a white-space character
_BEFORE[28:32] = True
_BEFORE[128:192] = True
_AFTER = tb.SPACE.copy()  # bytes that may begin one
_AFTER[28:32] = True
_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARK = np.zeros(256, bool)
_MARK[list(_MARKS.encode())] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def needs_whole(texts: tb.Texts) -> np.ndarray:
    """True for texts with a blank that may stand between two white-space characters."""
    data = texts.data
    flagged = np.zeros(len(texts), bool)
    if len(data) > 2:
        inner = np.flatnonzero((data[1:-1] == 32) & _BEFORE[data[:-2]] & _AFTER[data[2:]]) + 1
        flagged[np.searchsorted(texts.offsets, inner, "right") - 1] = True
    return flagged


Encode = Callable[[list[str]], list[bytes]]


def encode_chunks(
    texts: tb.Texts, encode_distinct: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], at_marks: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and the number of ids of each text.

    ``encode_distinct`` gives the ids of distinct chunks (bytes, with the blank that leads them) one after
    the other, and how many each has. With ``at_marks``, a mark behind an ASCII letter begins a chunk too: no
    piece holds a letter and a mark behind it, and there are fewer distinct words than words with marks.
    """
    data, offsets = texts.data, texts.offsets
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    cut = data == 32
    if at_marks:
        cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    for i in np.flatnonzero(needs_whole(texts)):
        cut[offsets[i] : offsets[i + 1]] = False
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(data)).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    flat, lengths = encode_distinct(coded.dictionary)
    code = coded.indices.to_numpy()
    sizes = lengths[code]
    ends = np.cumsum(sizes)
    shift = (np.cumsum(lengths) - lengths)[code] - (ends - sizes)
    ids = flat[np.repeat(shift, sizes) + np.arange(ends[-1])]
    upto = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
    return ids, np.diff(upto)


def split_ids(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The ids of each text as little-endian 32-bit integers."""
    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(4 * sizes).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


class ChunkCache:
    """Remembered encodings of chunks, in two generations of at most ``CACHE_BYTES`` each.

    A full young generation becomes the old one; entries found in the old one move back, so frequent
    chunks stay and memory is bounded. Chunks are bytes with the blank that leads them.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        """Forget all chunks; called at the end of a task, because Spark keeps Python workers."""
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _remember(self, chunk: bytes, ids: bytes) -> None:
        self.young[chunk] = ids
        self.held += len(chunk) + len(ids) + ENTRY_BYTES
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0

    def _recall(self, chunk: bytes) -> bytes | None:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is not None:
                self._remember(chunk, found)
        return found

    def _encodings(self, chunks: list[bytes], encode: Encode, pieces: Callable[[str], list[str]]) -> list[bytes]:
        """The encoding of each distinct chunk.

        A blank with letters is one piece, and so are the letters before a single mark; other chunks are split by
        the pattern.
        """
        found = [self._recall(chunk) for chunk in chunks]
        parts: dict[int, list[str]] = {}
        for k, ids in enumerate(found):
            if ids is None:
                text = chunks[k].decode("utf-8", "replace")
                if text[0] == " " and text[1:].isalpha():
                    parts[k] = [text]
                elif text[0] == " " and text[-1] in _MARKS and text[1:-1].isalpha():
                    parts[k] = [text[:-1], text[-1]]
                else:
                    parts[k] = pieces(text)
        distinct = {part: self._recall(part.encode()) for some in parts.values() for part in some}
        new = [part for part, ids in distinct.items() if ids is None]
        for part, ids in zip(new, encode(new)):
            distinct[part] = ids
            if len(part) < MOST_REMEMBERED:
                self._remember(part.encode(), ids)
        for k, some in parts.items():
            found[k] = b"".join(map(distinct.__getitem__, some))
            if len(some) > 1 and len(chunks[k]) < MOST_REMEMBERED:
                self._remember(chunks[k], found[k])
        return found

    def encode_all(self, texts: tb.Texts, encode: Encode, pieces: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """:func:`encode_chunks` where ``encode`` maps pieces, and ``pieces`` splits a chunk into them."""

        def distinct(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            encoded = self._encodings(chunks.to_pylist(), encode, pieces)
            return np.frombuffer(b"".join(encoded), "<u4"), np.array([len(e) // 4 for e in encoded], np.int64)

        return encode_chunks(texts, distinct)


# Bytes that are white space or may begin a white-space character.
_MAY_BLANK = _AFTER | _BEFORE
_MAY_BLANK[128:192] = False


class TokenizersEncoder:
    """Ids of texts by a file for the tokenizers library, as its plain ``encode`` without special tokens.

    The library gets the distinct chunks of a slice of texts some hundred at a time, joined to one string, as
    they could stand in a text; the lengths of the tokens show where each chunk ends.
    """

    _open: dict[str, "TokenizersEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library finds the strings of added tokens in a text before it splits it.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, rank in vocabulary.items():
            self.length[rank] = len(token)  # a character of a byte-level token stands for a byte

    @classmethod
    def shared(cls, path: str) -> TokenizersEncoder:
        """One per Python worker and file."""
        if path not in cls._open:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
            cls._open[path] = cls(path)
        return cls._open[path]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings one after the other, and how many each has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _encode_distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, ends, raw = chunks.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(chunks) + 1].astype(np.int64)
        data = np.frombuffer(raw, np.uint8)[: ends[-1]]
        sizes = np.diff(ends)
        # A chunk whose only white space is the blank in front keeps its pieces between others like it.
        blanks = np.concatenate([[0], np.cumsum(_MAY_BLANK[data])])
        joined = (data[ends[:-1]] == 32) & (blanks[ends[1:]] - blanks[ends[:-1]] == 1) & (sizes > 1)
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        n = int(joined.sum())
        dealt = chunks.take(pa.array(order))
        _, ends, raw = dealt.buffers()
        ends, view = np.frombuffer(ends, np.int32)[: len(chunks) + 1].astype(np.int64), memoryview(raw)
        edges = [*ends[:n:CHUNKS_AT_ONCE].tolist(), int(ends[n])]
        ids, _ = self._encode([bytes(view[a:b]).decode("utf-8", "replace") for a, b in zip(edges, edges[1:])])
        upto = np.concatenate([[0], np.cumsum(self.length[ids])])
        last = np.searchsorted(upto, ends[: n + 1])
        if last[-1] >= len(upto) or not np.array_equal(upto[last], ends[: n + 1]):  # not UTF-8: replaced characters
            ids, counts = self._encode([c.decode("utf-8", "replace") for c in dealt[:n].to_pylist()])
        else:
            counts = np.diff(last)
        more, alone = self._encode([c.decode("utf-8", "replace") for c in dealt[n:].to_pylist()])
        ids, counts = np.concatenate([ids, more]), np.concatenate([counts, alone])
        # Back into the order of the chunks.
        lengths = np.empty(len(chunks), np.int64)
        lengths[order] = counts
        begin = np.empty(len(chunks), np.int64)
        begin[order] = np.cumsum(counts) - counts
        place = np.cumsum(lengths)
        return ids[np.repeat(begin - (place - lengths), lengths) + np.arange(len(ids))], lengths

    def _holds_added(self, texts: tb.Texts) -> np.ndarray:
        raw, found = texts.data.tobytes(), np.zeros(len(texts), bool)
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                found[int(np.searchsorted(texts.offsets, at, "right")) - 1] = True
                at = raw.find(content, at + 1)
        return found

    def encode_flat(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has. Texts with the string of an added token go whole."""
        special = self._holds_added(texts)
        if not special.any():
            return encode_chunks(texts, self._encode_distinct, at_marks=True)
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        edges = np.flatnonzero(np.diff(special, prepend=~special[:1], append=~special[-1:]))
        for low, high in zip(edges[:-1], edges[1:]):
            a, b = texts.offsets[low], texts.offsets[high]
            some = tb.Texts(texts.data[a:b], texts.offsets[low : high + 1] - a)
            if special[low]:
                ids, counts = self._encode([some.text(i).decode("utf-8", "replace") for i in range(len(some))])
            else:
                ids, counts = encode_chunks(some, self._encode_distinct, at_marks=True)
            parts.append(ids)
            sizes.append(counts)
        return np.concatenate(parts), np.concatenate(sizes)

    def encode(self, texts: tb.Texts) -> list[bytes]:
        return split_ids(*self.encode_flat(texts))
