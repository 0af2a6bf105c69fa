"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

Candidates are maximal runs of ``[A-Za-z0-9+/_=-]`` of at least ``MIN_RUN`` bytes. A candidate has a
character class: hex, alphanumeric or base64, by the narrowest that holds all of it. A window slides over
it; counts per character are updated by one byte in and one out, and the Shannon entropy follows from a
running sum of ``c * log2(c)``. If the largest entropy reaches the class's threshold, the candidate is
a secret, unless the allow list knows its form: numbers, UUIDs, runs of one pattern, and words, path-like
or snake-case names whose letters are spread as in words.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymart.llm import textbatch as tb
from tallymart.llm.common import id_and_text, map_rows, map_texts

# The patterns of the contract. Kinds in the order in which ties are written.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    rb"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24

MIN_RUN = 20
WINDOW = 20
# Bits per character that the best window must reach.
THRESHOLDS = {"hex": 3.0, "alphanumeric": 3.7, "base64": 3.9}

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[48:58] = _CANDIDATE[65:91] = _CANDIDATE[97:123] = True
_CANDIDATE[[ord(c) for c in "+/_=-"]] = True

_CLASSES = (
    ("hex", re.compile(rb"[0-9a-f]+|[0-9A-F]+")),
    ("alphanumeric", re.compile(rb"[A-Za-z0-9]+")),
    ("base64", re.compile(rb"[A-Za-z0-9+/_=-]+")),
)
_ALLOWED = (
    re.compile(rb"[0-9]+"),
    re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(rb"(.{1,8})\1+.{0,7}"),
)
# Forms of names: allowed if the letters are also spread as in words.
_NAMES = (
    re.compile(rb"(?:[A-Z]?[a-z]{2,}+)++|[a-z]+|[A-Z]+"),
    re.compile(rb"[+/_=-]*+(?:(?:[A-Z]?[a-z]++|[A-Z]++)[+/_=-]++)*+(?:[A-Z]?[a-z]++|[A-Z]++)?+[0-9]{0,8}"),
)
_NOT_LETTERS = re.compile(rb"[^a-z]+")
_ORDERED = (b"abcdefghijklmnopqrstuvwxyz", b"zyxwvutsrqponmlkjihgfedcba", b"qwertyuiopasdfghjklzxcvbnm")
# Of random letters 7 in 26 are rare ones and 5 in 26 vowels; of the letters of words about 1 in 20 and 2 in 5.
RARE, VOWELS = b"jkqvwxz", b"aeiou"
MOST_RARE, LEAST_VOWELS = 0.2, 0.15
_TERM = [0.0] + [k * math.log2(k) for k in range(1, WINDOW + 1)]


def window_entropy(run: bytes, width: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits per byte, of any window of ``width`` bytes of ``run``."""
    width = min(width, len(run))
    if not width:
        return 0.0
    counts = [0] * 256
    total = 0.0
    least = math.inf
    for i, byte in enumerate(run):
        total += _TERM[counts[byte] + 1] - _TERM[counts[byte]]
        counts[byte] += 1
        if i >= width:
            out = run[i - width]
            total += _TERM[counts[out] - 1] - _TERM[counts[out]]
            counts[out] -= 1
        if i >= width - 1:
            least = min(least, total)
    return math.log2(width) - least / width


def like_words(run: bytes) -> bool:
    """Whether the letters of a run are spread as in words, or stand in the order of the alphabet or a keyboard."""
    letters = _NOT_LETTERS.sub(b"", run.lower())
    if not letters or any(letters in order for order in _ORDERED):
        return True
    rare, vowels = (len(letters) - len(letters.translate(None, some)) for some in (RARE, VOWELS))
    return rare <= MOST_RARE * len(letters) and vowels >= LEAST_VOWELS * len(letters)


def is_secret_run(run: bytes) -> bool:
    if any(form.fullmatch(run) for form in _ALLOWED):
        return False
    if any(form.fullmatch(run) for form in _NAMES):
        # Separators repeat and say nothing, so they are left out of the window.
        return not like_words(run) and window_entropy(run.translate(None, b"+/_=-")) >= THRESHOLDS["alphanumeric"]
    kind = next(name for name, form in _CLASSES if form.fullmatch(run))
    return window_entropy(run) >= THRESHOLDS[kind]


_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")


class Reach:
    """Spans by start, with the farthest end up to each: tells in logarithmic time whether one holds a range."""

    def __init__(self, spans: list[tuple[int, str, int]]):
        self.starts = sorted(start for start, _, _ in spans)
        self.ends = list(accumulate((end for _, end in sorted((start, end) for start, _, end in spans)), max))

    def holds(self, start: int, end: int) -> bool:
        before = bisect_right(self.starts, start)
        return before > 0 and self.ends[before - 1] >= end


def find_spans(texts: tb.Texts) -> list[list[tuple[int, str, int]]]:
    """(start, kind, end) of every text's spans, as byte positions within the text, sorted by start.

    Kinds are those of the contract and ``entropy``. An entropy span that lies within another is left out.
    """
    data, offsets = texts.data, texts.offsets
    found: list[list[tuple[int, str, int]]] = [[] for _ in range(len(texts))]
    hexes = tb.runs(texts, _HEX[data])
    long_hex = np.flatnonzero(hexes.ends - hexes.starts >= MIN_HEX)
    for text, a, b in zip(hexes.owner[long_hex], hexes.starts[long_hex], hexes.ends[long_hex]):
        found[text].append((int(a - offsets[text]), "hex", int(b - offsets[text])))
    lowered = tb.LOWER[data].tobytes()
    suspects: set[int] = set()
    for word in _KEYWORDS:
        at = lowered.find(word)
        while at >= 0:
            suspects.add(int(np.searchsorted(offsets, at, "right")) - 1)
            at = lowered.find(word, at + 1)
    for text in suspects:
        for m in ASSIGN.finditer(texts.text(text)):
            if len(m[2]) >= MIN_ASSIGNED:
                found[text].append((m.start(), "assign", m.end()))
    raw = data.tobytes()
    at = raw.find(b"AKIA")
    access: set[int] = set()
    while at >= 0:
        access.add(int(np.searchsorted(offsets, at, "right")) - 1)
        at = raw.find(b"AKIA", at + 1)
    for text in access:
        for m in ACCESS.finditer(texts.text(text)):
            if m.end() - m.start() >= MIN_ACCESS:
                found[text].append((m.start(), "access", m.end()))
    runs = tb.runs(texts, _CANDIDATE[data])
    long_runs = np.flatnonzero(runs.ends - runs.starts >= MIN_RUN)
    current, reach = -1, Reach([])
    for text, a, b in zip(runs.owner[long_runs].tolist(), runs.starts[long_runs].tolist(), runs.ends[long_runs].tolist()):
        if is_secret_run(raw[a:b]):
            if text != current:  # runs come text by text, and lie apart from each other
                current, reach = text, Reach(found[text])
            a, b = int(a - offsets[text]), int(b - offsets[text])
            if not reach.holds(a, b):
                found[text].append((a, "entropy", b))
    rank = {kind: k for k, kind in enumerate((*KINDS, "entropy"))}
    for spans in found:
        spans.sort(key=lambda x: (x[0], rank[x[1]]))
    return found


def _code_points(text: bytes, places: list[int]) -> list[int]:
    """Code points before each byte position."""
    counted = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return counted[places].tolist()


def _described(texts: tb.Texts) -> dict[str, pa.Array]:
    counts = {kind: np.zeros(len(texts), np.int64) for kind in KINDS}
    base, every = [], []
    for i, spans in enumerate(find_spans(texts)):
        written, basic = [], []
        if spans:
            places = _code_points(texts.text(i), [p for a, _, b in spans for p in (a, b)])
            for k, (_, kind, _) in enumerate(spans):
                written.append(f"{kind}:{places[2 * k]}:{places[2 * k + 1]}")
                if kind in counts:
                    counts[kind][i] += 1
                    basic.append(written[-1])
        base.append(hashlib.sha256(",".join(basic).encode()).hexdigest())
        every.append(",".join(written))
    made = {f"n_{kind}": pa.array(counts[kind], pa.int64()) for kind in KINDS}
    return made | {"base_sha256": pa.array(base, pa.string()), "spans": pa.array(every, pa.string())}


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    Spans are ``kind:start:end`` in code points, by start and then kind, joined by commas; no spans
    give an empty string and the digest of it. NULL counts as empty. Rows are scanned alone, so ids may
    be NULL or repeat. Other columns are not read.
    """
    schema = ", ".join(f"n_{kind} long" for kind in KINDS) + ", base_sha256 string, spans string"
    return map_texts(id_and_text(docs, id_col, text_col), _described, schema)


def redact(text: bytes, spans: list[tuple[int, str, int]], mark: bytes = b"[SECRET]") -> bytes:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    parts, at, covered = [], 0, -1
    for start, _, end in spans:
        if start >= covered:
            parts += [text[at:start], mark]
        covered = max(covered, end)
        at = max(at, end)
    return b"".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the secrets in the text replaced; NULL stays NULL."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.from_arrow(batch.column(place))
            for first, part in tb.slices(texts):
                rows = batch.slice(first, len(part))
                spans = find_spans(part)
                columns = list(rows.columns)
                if any(spans):
                    old = rows.column(place)
                    new = [
                        (redact(part.text(i), s).decode("utf-8", "replace") if s else old[i].as_py()) for i, s in enumerate(spans)
                    ]
                    columns[place] = pa.array(new, old.type)
                yield pa.RecordBatch.from_arrays(columns, rows.schema.names)

    return map_rows(docs, run)
