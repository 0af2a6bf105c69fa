"""Language identification by cross-parsing entropy over suffix automata.

For each language, a suffix automaton of a bounded sample of its texts accepts exactly the substrings
of that sample. A text is parsed greedily into the longest phrases the automaton accepts; the fewer
phrases, the closer the text is to the language. ``phrases * log2(sample size) / text size`` estimates
the cross entropy in bits per byte, and the language with the least wins (ties: first by name).

Texts are cut into blocks of ``BLOCK`` bytes whose phrases are added up, so that NumPy can advance the
automata over tens of thousands of blocks in step; every byte of every text is parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm import textbatch as tb
from tallymart.llm.common import id_and_text, map_texts, ship

SAMPLE_TEXTS = 16
SAMPLE_CHARS = 2500
BLOCK = 256
SLICE_BYTES = 4 << 20

_NORMAL = tb.LOWER.copy()
_NORMAL[tb.SPACE] = 32
_NORMAL[48:58] = ord("0")


def suffix_automaton(codes: list[int], width: int = 256) -> np.ndarray:
    """Transitions of the suffix automaton of ``codes``, all below ``width``: row per state, 0 where there is none."""
    edges: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for code in codes:
        new = len(edges)
        edges.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and code not in edges[p]:
            edges[p][code] = new
            p = link[p]
        if p >= 0:
            q = edges[p][code]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and edges[p].get(code) == q:
                    edges[p][code] = copy
                    p = link[p]
        last = new
    table = np.zeros((len(edges), width), np.uint16 if len(edges) < 1 << 16 else np.int32)
    for state, out in enumerate(edges):
        for code, target in out.items():
            table[state, code] = target
    return table


class Parser:
    """The automata of all languages, each over the bytes of its own sample.

    Every byte value of a sample has a code; all others share one that is in no sample and matches nothing.
    Matches restart every BLOCK bytes of a text, which adds at most one phrase per block to every language.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        if not samples:
            return
        self.codes, self.tables, self.bits = [], [], []
        for k in self.languages:
            normal = _NORMAL[np.frombuffer(samples[k], np.uint8)]
            known = np.unique(normal)
            code = np.full(256, len(known), np.uint8 if len(known) < 256 else np.int32)
            code[known] = np.arange(len(known))
            self.codes.append(code[_NORMAL])
            self.tables.append(suffix_automaton(code[normal].tolist(), len(known) + 1))
            self.bits.append(np.log2(len(normal) + 2))

    def phrases(self, texts: tb.Texts) -> np.ndarray:
        """Number of phrases per language and text."""
        sizes = np.diff(texts.offsets)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = texts.offsets[:-1][owner] + inner * BLOCK
        length = np.minimum(sizes[owner] - inner * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        active = np.searchsorted(-length, -np.arange(1, BLOCK + 1), "right")  # blocks longer than each step
        columns = []
        for step in range(BLOCK):
            if not active[step]:
                break
            columns.append(texts.data[start[: active[step]] + step])
        found = np.empty((len(self.languages), len(sizes)), np.int64)
        for k, (table, coding) in enumerate(zip(self.tables, self.codes)):
            width, root, table = table.shape[1], table[0], table.ravel()
            state = np.zeros(len(owner), np.int32)
            count = np.ones(len(owner), np.int32)
            for column in columns:
                code = coding[column].astype(np.int32)
                n = len(code)
                state = state[:n]
                ahead = table[state * width + code]
                stop = ahead == 0
                count[:n] += stop
                state = np.where(stop, root[code], ahead).astype(np.int32)
            found[k] = np.bincount(owner, weights=count, minlength=len(sizes))
        return found

    def label(self, texts: tb.Texts) -> tuple[list[str], np.ndarray]:
        """The language and a score of each text: one over the sum of 2 ** -(excess bits / 64)."""
        sizes = np.maximum(np.diff(texts.offsets), 1)
        letters = has_letter(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.phrases(texts) * np.array(self.bits)[:, None]
        best = bits.argmin(axis=0)
        excess = bits - bits.min(axis=0)
        score = 1.0 / np.exp2(-np.minimum(excess * 64 / np.minimum(sizes, 4096), 1000)).sum(axis=0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, score, 0.0)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letter(texts: tb.Texts) -> np.ndarray:
    found = tb.per_text(_ASCII_LETTER[texts.data], texts.offsets) > 0
    for i in np.flatnonzero(~found):
        text = texts.text(i)
        if not text.isascii():
            found[i] = any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return found


def training_samples(docs: DataFrame, usable: Column) -> dict[str, bytes]:
    """Sample text per language: of at most SAMPLE_TEXTS texts, at most SAMPLE_CHARS characters of each.

    The texts are picked by a hash of the id among all rows with text where ``usable`` holds and the
    language is known (``und`` is no language); whole texts go before longer ones. Of a longer text, the characters from a place
    chosen by the hash are taken.
    Only ids are sorted; what reaches the driver is bounded by these parameters for each language.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & (F.col("lang") != "und"))
    sizes = rows.where(F.length("text") > 0).select("doc_id", "lang", (F.length("text") > SAMPLE_CHARS).alias("long"))
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id", F.lit(9)), "doc_id")
    picked = sizes.withColumn("rank", F.row_number().over(order)).where(f"rank <= {SAMPLE_TEXTS}").select("doc_id", "lang", "long")
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), spare + 1).cast("int")
    found = docs.where(F.length("text") > 0).withColumn("long", F.length("text") > SAMPLE_CHARS)
    found = found.join(F.broadcast(picked), ["doc_id", "lang", "long"]).withColumn("text", F.substring("text", place + 1, F.lit(SAMPLE_CHARS)))
    samples: dict[str, list[str]] = {}
    for row in sorted(found.select("doc_id", "lang", "text").distinct().collect()):
        samples.setdefault(row.lang, []).append(row.text)
    return {k: "\n".join(v[:SAMPLE_TEXTS]).encode() for k, v in _agreed(samples).items()}


def _agreed(samples: dict[str, list[str]]) -> dict[str, list[str]]:
    """The sample texts whose label is confirmed by automata of the other half of the sample.

    A mislabelled text would teach its label another language. A language of which no text is confirmed
    keeps all.
    """
    kept: dict[str, list[str]] = {k: [] for k in samples}
    for half in (0, 1):
        teacher = Parser({k: "\n".join(v[half::2]).encode() for k, v in samples.items() if v[half::2]})
        for k, v in samples.items():
            if taught := v[1 - half :: 2]:
                names, _ = teacher.label(tb.from_arrow(pa.array(taught, pa.string())))
                kept[k] += [text for text, name in zip(taught, names) if name == k]
    return {k: kept[k] or v for k, v in samples.items()}


def identify(docs: DataFrame, usable: Column, lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred and score for every row of ``docs`` (doc_id, text and a language column).

    Only rows where ``usable`` (over doc_id) holds teach. ``und`` with score 0 stands for a NULL text, a
    text without any letter, and for every text when there is nothing to learn from. Every row is judged
    alone, by its text only, so ids may be NULL or repeat; other columns are not read.
    """
    ship(docs.sparkSession)
    labelled = docs.select("doc_id", "text", F.col(f"`{lang_col}`").alias("lang"))
    parser = docs.sparkSession.sparkContext.broadcast(Parser(training_samples(labelled, usable & F.col("doc_id").isNotNull())))

    def run(texts: tb.Texts) -> dict[str, pa.Array]:
        names, score = parser.value.label(texts)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())}

    return map_texts(id_and_text(docs), run, "lang_pred string, score double", slice_bytes=SLICE_BYTES)
