import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymart.llm import language
from tallymart.llm import textbatch as tb
from tallymart.llm.common import is_held_out

ROOT = "/root/testdata/sf0.01"


@settings(deadline=None)
@given(st.text("abc", min_size=1, max_size=30), st.text("abc", max_size=8))
def test_automaton_accepts_exactly_the_substrings(sample, probe):
    table = language.suffix_automaton([ord(c) - 97 for c in sample])
    state, ok = 0, True
    for c in probe:
        state = table[state, ord(c) - 97]
        ok = ok and state != 0
        if not ok:
            break
    assert ok == (probe in sample)


def _phrases(sample, text):
    """Greedy longest matches; a character the sample lacks ends a phrase."""
    count = 1
    current = ""
    for c in text:
        if current + c in sample:
            current += c
        else:
            count += 1
            current = c if c in sample else ""
    return count


@settings(deadline=None)
@given(st.text("ab c", min_size=3, max_size=40), st.lists(st.text("ab cd", max_size=50), min_size=1, max_size=5))
def test_phrases_match_a_plain_parser(sample, texts):
    parser = language.Parser({"x": sample.encode()})
    found = parser.phrases(tb.from_arrow(pa.array(texts)))[0]
    assert found.tolist() == [_phrases(sample, t) if t else 0 for t in texts]


def test_no_letters_are_merged():
    """Samples in four scripts: each language's phrases are those of a plain parser over its own bytes."""
    samples = {
        "el": "η γρήγορη αλεπού πηδάει πάνω από τον τεμπέλη σκύλο και φεύγει",
        "en": "the quick brown fox jumps over the lazy dog and runs away",
        "ru": "быстрая лиса прыгает через ленивую собаку и убегает прочь",
        "zh": "敏捷的狐狸跳过懒狗然后跑开了今天天气很好我们去公园",
    }
    parser = language.Parser({k: v.encode() for k, v in samples.items()})
    texts = ["лиса и собака", "αλεπού σκύλος", "今天我们去", "fox and dog", "собака 狐狸 fox σκύλο", "щэъё"]
    found = parser.phrases(tb.from_arrow(pa.array(texts)))
    latin = lambda t: t.encode().decode("latin-1")
    for k, row in zip(parser.languages, found):
        assert row.tolist() == [_phrases(latin(samples[k]), latin(t)) for t in texts]
    assert parser.label(tb.from_arrow(pa.array(texts[:4])))[0] == ["ru", "el", "zh", "en"]


def test_long_texts_are_parsed_in_blocks_to_the_end():
    parser = language.Parser({"a": b"aaaa" * 20, "b": b"bbbb" * 20})
    texts = tb.from_arrow(pa.array(["a" * 100 + "b" * 5_000, "b" * 100 + "a" * 5_000]))
    assert parser.label(texts)[0] == ["b", "a"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    held_out = is_held_out(F.col("doc_id"))
    found = language.identify(docs, ~held_out).join(docs.select("doc_id", "lang"), "doc_id").where(held_out).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 < r.score <= 1 for r in found)


def test_odd_rows(spark, odd, nothing):
    rows = language.identify(odd, F.lit(True)).collect()
    assert len(rows) == odd.count()
    und = {3, 4, 5, 11, 12}
    assert all((r.lang_pred == "und") == (r.doc_id in und) for r in rows if r.doc_id is not None)
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in language.identify(odd, F.lit(False)).collect()} == {"und"}
    assert language.identify(nothing, F.lit(True)).count() == 0


def test_a_language_of_long_texts_only(spark):
    """A language is learnt from parts of long texts too, also where it has one short text."""
    words = {"aa": "kolu mire tasano velit ", "bb": "strugh whend bractle ombly "}
    rows = [(i, words["bb"] * (5 + i), "bb") for i in range(20)] + [(50 + i, words["aa"] * (300 + i), "aa") for i in range(20)]
    rows += [(90, "qq", "cc")] + [(100 + i, "zyxo jivu quazy foxij " * (200 + i), "cc") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, F.col("doc_id") % 2 == 0).collect()}
    assert all(found[i] == lang for i, _, lang in rows if i != 90)
    samples = language.training_samples(docs, F.lit(True))
    assert set(samples) == {"aa", "bb", "cc"}
    assert all(len(x) <= language.SAMPLE_TEXTS * (language.SAMPLE_CHARS + 1) for x in samples.values())


def test_letters_of_any_script():
    assert language.has_letter(tb.from_arrow(pa.array(["日本", "123 é", "1 😀", "", "-a-"]))).tolist() == [True, True, False, False, True]
