"""Quality rules as a short-circuit cascade, ordered by rejections per unit of cost.

The basic counts of a text are always made. The further rules then run one after the other, each only
on the texts that all earlier ones let pass. Their order comes from a bounded sample: seconds per text
and share of rejected texts of each rule. The order changes the cost and never the verdict, since a
text is kept only if every rule lets it pass.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import textbatch as tb
from tallymart.llm.common import id_and_text, map_texts

SAMPLE_TEXTS = 512

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LETTER = _UPPER.copy()
_ASCII_LETTER[97:123] = True
_LETTER = _ASCII_LETTER.copy()
_LETTER[128:] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True at every element whose value occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _by_owner(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return tb.mix(hashes ^ tb.mix(owner.astype(np.uint64) + np.uint64(1)))


def _bytes_per_text(flags: np.ndarray, texts: tb.Texts) -> np.ndarray:
    return tb.per_text(flags, texts.offsets)


def basic_counts(texts: tb.Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each text."""
    data = texts.data
    words = tb.words(texts)
    lines = tb.lines(texts)
    with_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    line_owner = lines.owner[with_word]
    line_keys = _by_owner(tb.span_hashes(data, lines.starts[with_word], lines.ends[with_word]), line_owner)
    n_lines = np.bincount(line_owner, minlength=len(texts))
    _, first = np.unique(line_keys, return_index=True)
    distinct = np.bincount(line_owner[first], minlength=len(texts))

    hashes = tb.span_hashes(data, words.starts, words.ends)
    grams, at = tb.ngram_hashes(hashes, words.bounds, 3)
    owner = np.searchsorted(words.bounds, at, "right") - 1
    again = at[_repeated(_by_owner(grams, owner))]
    marked = np.zeros(len(hashes), bool)
    for k in range(3):
        marked[again + k] = True
    return {
        "n_words": words.counts,
        "word_chars": _bytes_per_text(~tb.SPACE[data] & ((data & 0xC0) != 0x80), texts),
        "n_symbols": _bytes_per_text(_SYMBOL[data], texts),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": tb.per_text(marked, words.bounds),
    }


@dataclass(frozen=True)
class Rule:
    """``rejects(texts, counts)`` is True where a text is to go."""

    name: str
    rejects: Callable[[tb.Texts, dict[str, np.ndarray]], np.ndarray]


def _symbols(texts: tb.Texts, counts: dict[str, np.ndarray]) -> np.ndarray:
    return 10 * counts["n_symbols"] > counts["n_words"]


def _word_length(texts: tb.Texts, counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["word_chars"] < 2 * counts["n_words"]) | (counts["word_chars"] > 15 * counts["n_words"])


def _dup_lines(texts: tb.Texts, counts: dict[str, np.ndarray]) -> np.ndarray:
    return 10 * counts["n_dup_lines"] > 3 * counts["n_lines"]


def _shouting(texts: tb.Texts, counts: dict[str, np.ndarray]) -> np.ndarray:
    return 2 * _bytes_per_text(_UPPER[texts.data], texts) > _bytes_per_text(_ASCII_LETTER[texts.data], texts)


def _few_letters(texts: tb.Texts, counts: dict[str, np.ndarray]) -> np.ndarray:
    words = tb.words(texts)
    letters = np.concatenate([[0], np.cumsum(_LETTER[texts.data])])
    lettered = letters[words.ends] > letters[words.starts]
    return 10 * tb.per_text(lettered, words.bounds) < 8 * words.counts


RULES = (
    Rule("symbols", _symbols),
    Rule("word_length", _word_length),
    Rule("dup_lines", _dup_lines),
    Rule("shouting", _shouting),
    Rule("few_letters", _few_letters),
)


def _take(texts: tb.Texts, rows: np.ndarray) -> tb.Texts:
    if len(rows) == len(texts):
        return texts
    sizes = (texts.offsets[1:] - texts.offsets[:-1])[rows]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    parts = [texts.data[texts.offsets[i] : texts.offsets[i + 1]] for i in rows]
    return tb.Texts(np.concatenate(parts) if parts else np.zeros(0, np.uint8), offsets)


def _base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def cascade(texts: tb.Texts, counts: dict[str, np.ndarray], rules: list[Rule]) -> np.ndarray:
    """True for texts that pass the basic bounds and every rule; a rule sees only those still in."""
    rows = np.flatnonzero(~_base_failed(counts))
    left = _take(texts, rows)
    for rule in rules:
        if not len(rows):
            break
        stay = np.flatnonzero(~rule.rejects(left, {k: v[rows] for k, v in counts.items()}))
        rows, left = rows[stay], _take(left, stay)
    kept = np.zeros(len(texts), bool)
    kept[rows] = True
    return kept


def rule_order(texts: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE_TEXTS) -> list[Rule]:
    """The rules by rejections per second among the texts that earlier rules leave, best first.

    Measured on a random sample of about ``sample`` of all texts, where they are read: a task sends one row
    per set of rejecting rules it saw, and its seconds per rule.
    """
    n = texts.count()
    if not n:
        return list(rules)
    picked = texts.select("text").where("text is not null").sample(fraction=min(1.0, sample / n), seed=11)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        seconds = np.zeros(len(rules))
        for batch in batches:
            for _, part in tb.slices(tb.from_arrow(batch.column(0))):
                counts = basic_counts(part)
                rows = np.flatnonzero(~_base_failed(counts))
                left, sets = _take(part, rows), np.zeros(len(rows), np.int64)
                counts = {name: values[rows] for name, values in counts.items()}
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    sets |= rule.rejects(left, counts).astype(np.int64) << k
                    seconds[k] += time.perf_counter() - began
                for rejecting, times in zip(*np.unique(sets, return_counts=True)):
                    seen[int(rejecting)] = seen.get(int(rejecting), 0) + int(times)
        if seen:
            spent = [seconds.tolist()] + [[0.0] * len(rules)] * (len(seen) - 1)
            yield pa.RecordBatch.from_pydict({"rejecting": list(seen), "texts": list(seen.values()), "seconds": spent})

    total = [F.sum(F.col("seconds")[k]).alias(f"s{k}") for k in range(len(rules))]
    found = picked.mapInArrow(measure, "rejecting long, texts long, seconds array<double>").groupBy("rejecting")
    rows = found.agg(F.sum("texts").alias("texts"), *total).collect()  # at most one row per set of rules
    seconds = [sum(r[f"s{k}"] for r in rows) for k in range(len(rules))]
    left, ordered = {r.rejecting: r.texts for r in rows}, []
    while len(ordered) < len(rules):
        rejected = [sum(n for sets, n in left.items() if sets >> k & 1) for k in range(len(rules))]
        best = max((k for k in range(len(rules)) if k not in ordered), key=lambda k: rejected[k] / max(seconds[k], 1e-9))
        ordered.append(best)
        left = {sets: n for sets, n in left.items() if not sets >> best & 1}
    return [rules[k] for k in ordered]


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """doc_id, the basic counts, base_failed and kept for every row.

    NULL and empty texts have no words and fail the basic bounds; ids may be NULL or repeat, as every
    row is judged alone. Other columns are not read.
    """
    texts = id_and_text(docs, id_col, text_col)
    ordered = rule_order(texts, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(part: tb.Texts) -> dict[str, pa.Array]:
        counts = basic_counts(part)
        made = {name: pa.array(counts[name], pa.int64()) for name in names}
        return made | {
            "base_failed": pa.array(_base_failed(counts), pa.bool_()),
            "kept": pa.array(cascade(part, counts, ordered), pa.bool_()),
        }

    schema = ", ".join(f"{name} long" for name in names) + ", base_failed boolean, kept boolean"
    return map_texts(texts, judge, schema)
