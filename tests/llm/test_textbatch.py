import re

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from tallymart.llm import textbatch as tb

texts = st.lists(st.one_of(st.none(), st.text("ab \n\té", max_size=30)), min_size=1, max_size=8)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@given(texts, st.integers(1, 40))
def test_words_hashes_and_ngrams(values, most):
    seen = {}
    rows = 0
    for first, part in tb.slices(tb.from_arrow(pa.array(values, pa.string())), most):
        assert first == rows
        rows += len(part)
        words = tb.words(part)
        hashes = tb.span_hashes(part.data, words.starts, words.ends)
        grams, at = tb.ngram_hashes(hashes, words.bounds, 2)
        wanted = [_words(v) for v in values[first:rows]]
        assert words.counts.tolist() == [len(w) for w in wanted]
        flat = [w for ws in wanted for w in ws]
        pairs = [p for ws in wanted for p in zip(ws, ws[1:])]
        for word, value in [*zip(flat, hashes.tolist()), *zip(pairs, grams.tolist())]:
            assert seen.setdefault(word, value) == value
        assert len(at) == len(pairs)
    assert rows == len(values)
    assert len(set(seen.values())) == len(seen)


@given(texts)
def test_lines(values):
    part = tb.from_arrow(pa.array(values, pa.string()))
    lines = tb.lines(part)
    found = [part.data[a:b].tobytes().decode() for a, b in zip(lines.starts, lines.ends)]
    assert found == [x for v in values for x in (v or "").split("\n") if x]
