import os
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymart.llm import checks, collocations
from tallymart.llm import textbatch as tb

ROOT = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_counts(text):
    found = Counter()
    for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)):
        words = re.findall(r"[^ \t]+", piece)
        for k in (1, 2, 3):
            found.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return found


def plain(rows, min_count=10, share=50, top=2000):
    """The contract, by definition: every cut and every longer phrase of every candidate."""
    counts = {}
    for lang, text in rows:
        counts.setdefault("und" if lang is None else lang, Counter()).update(plain_counts(text or ""))
    out = []
    for lang, f in counts.items():
        n = sum(a for p, a in f.items() if " " not in p)
        candidates = {p: a for p, a in f.items() if " " in p and a >= min_count}
        scored = []
        for phrase, a in candidates.items():
            if any(f" {phrase} " in f" {q} " and 100 * b >= share * a for q, b in candidates.items() if len(q) > len(phrase)):
                continue
            words = phrase.split(" ")
            cuts = []
            for k in range(1, len(words)):
                l, r = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((1_000_000 * a * a // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            scored.append((-score, -a, phrase.encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(df, **options).collect())


def test_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{ROOT}/documents.parquet'")
    want = db.execute(checks.checks()["op12_phrase_collocations"])
    assert [c[0] for c in want.description] == COLUMNS
    assert found(spark.read.parquet(f"{ROOT}/documents.parquet")) == sorted(want.fetchall())


@pytest.mark.parametrize("text", ["", " \t ", "a", "A b, c d e", "a  b\tc.d\x0ce f g h\x0b;i", "é É ß x y\xa0z 日本 語", "x\x00y z. " * 3])
def test_counts_of_a_slice(text):
    got = collocations.count_phrases(tb.from_arrow(pa.array(["lead in", text, None, text, "x"])))
    phrases, counts, hashes = got
    want = plain_counts("lead in") + plain_counts(text) + plain_counts(text) + plain_counts("x")
    seen = {p.as_py().decode()[:-1]: int(c) for p, c in zip(phrases, counts)}
    assert seen.pop("") == sum(a for p, a in want.items() if " " not in p)
    assert seen == want and len(set(hashes.tolist())) == len(phrases)


def random_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "B", "c", "dd", "é", "the", "the", "the"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ". ", "\t", "\n"]) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [(rng.choice(["x", "x", "y", None, "und", ""]), t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_definition(spark, seed, monkeypatch):
    """Many buckets, slices, early sums and partitions, so that keys are cut by partition borders."""
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 2_000)
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = plain(rows)
    assert want and found(df) == want
    assert found(df, min_count=3, share=80, top=7) == plain(rows, 3, 80, 7)


def test_early_sums_of_a_bucket(monkeypatch):
    monkeypatch.setattr(collocations, "HELD_PHRASES", 3)
    texts = ["a b a b", "b a", "a b c", "c"] * 4
    batches = [pa.RecordBatch.from_pydict({"lang": ["x"], "text": [t]}) for t in texts]
    runs = list(collocations._runs(1)(iter(batches)))
    merged = pa.Table.from_batches(collocations._merged(2)(iter(runs))).to_pydict()
    want = {p: a for p, a in plain_counts(".".join(texts)).items() if a >= 2}
    got = dict(zip(merged["phrase"], merged["f"]))
    assert got.pop("") == 40 and got == want


def test_walk_over_cut_partitions(spark):
    """Every partitioning of the sorted stream gives the counts of the parts."""
    rng = random.Random(3)
    words = ["a", "b", "c", "d"]
    f = Counter()
    for _ in range(3000):
        p = tuple(rng.choice(words) for _ in range(3))
        f.update([p[:1], p[:2], p])
    stream = spark.createDataFrame([("x", " ".join(p), a) for p, a in f.items()], "lang string, phrase string, f long")
    word = F.split("phrase", " ")
    keys = [F.get(word, F.lit(i)) for i in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 13, 60):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            rows = collocations.lockstep(stream, keys, "one", "two").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(rows) == len(f)
        for r in rows:
            p = tuple(r.phrase.split(" "))
            assert len(p) == 1 or r.one == f[p[:1]]
            assert r.two == (f[p[:2]] if len(p) == 3 else None)


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    row = spark.createDataFrame([(big, big + 2, big + 6)], "f long, l long, r long")
    got = row.select(collocations._score(F.col("l"), F.col("r"))).first()[0]
    assert got == 1_000_000 * big * big // ((big + 2) * (big + 6))


def test_odd_rows(spark, odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert found(odd) == plain(rows)
    assert collocations.collocations(nothing).collect() == []
    assert collocations.collocations(nothing).columns == COLUMNS
