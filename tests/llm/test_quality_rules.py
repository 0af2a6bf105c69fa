import os

import duckdb
import pyarrow as pa
import pytest

from tallymart.llm import checks, quality_rules
from tallymart.llm import textbatch as tb

ROOT = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def test_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{ROOT}/documents.parquet'")
    want = db.execute(checks.checks()["op2_quality_rules"])
    names = [c[0] for c in want.description]
    found = quality_rules.quality_verdicts(spark.read.parquet(f"{ROOT}/documents.parquet"))
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(want.fetchall())


def test_order_does_not_change_verdicts():
    texts = tb.from_arrow(pa.array(["A! " * 60, "word " * 60, "one two | three & ", "X Y Z " * 40, " ".join(f"w{i}ord" for i in range(90)), None, ""]))
    counts = quality_rules.basic_counts(texts)
    rules = list(quality_rules.RULES)
    wanted = quality_rules.cascade(texts, counts, rules)
    for _ in rules:
        rules = rules[1:] + rules[:1]
        assert (quality_rules.cascade(texts, counts, rules) == wanted).all()
    assert wanted.tolist() == [False] * 4 + [True] + [False] * 2


def test_order_is_measured_on_a_sample_that_does_not_grow(spark):
    """The rows measured follow from the sample size, not from the partitions; a useless rule goes last."""
    text = " ".join(f"w{i}ord" for i in range(90))
    rows = [(i, "A1 # " * 60 + text if i % 2 else text) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (2, 60):
        dealt = df.repartition(parts).cache()
        order = quality_rules.rule_order(dealt.select("doc_id", "text"))
        assert sorted(r.name for r in order) == sorted(r.name for r in quality_rules.RULES)
        sampled = dealt.sample(fraction=quality_rules.SAMPLE_TEXTS / 3000, seed=11).count()
        assert abs(sampled - quality_rules.SAMPLE_TEXTS) < 150
    assert list(quality_rules.rule_order(df.where("false"))) == list(quality_rules.RULES)


def test_order_counts_what_earlier_rules_leave(spark):
    """A rule that rejects only what a cheaper one has rejected comes after a rule that rejects others."""
    import numpy as np

    def rule(name, mark, cost):
        def rejects(texts, counts):
            deadline = time.perf_counter() + cost
            while time.perf_counter() < deadline:
                pass
            return np.array([mark in texts.text(i) for i in range(len(texts))], bool)

        return quality_rules.Rule(name, rejects)

    import time

    words = " ".join(f"w{i}ord" for i in range(90))
    rows = [(i, words + (" both" if i % 3 == 0 else " few" if i % 10 == 1 else "")) for i in range(600)]
    rules = (rule("twin", b"both", 0.04), rule("first", b"both", 0.01), rule("few", b"few", 0.03))
    order = quality_rules.rule_order(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rules)
    assert [r.name for r in order] == ["first", "few", "twin"]


def test_odd_rows(odd, nothing):
    rows = quality_rules.quality_verdicts(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert {r.n_words for r in rows if r.doc_id == 8} == {40_000}
    assert quality_rules.quality_verdicts(nothing).count() == 0


@pytest.mark.parametrize("text, repeats", [("a b c a b c", 6), ("a b c a b", 0), ("a a a a", 4), ("", 0), ("a b", 0)])
def test_repeated_words(text, repeats):
    counts = quality_rules.basic_counts(tb.from_arrow(pa.array([text])))
    assert counts["n_repeat_words"].tolist() == [repeats]
