import random
import re

import pytest
from pyspark.sql import functions as F

from tallymart.llm import licenses

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_blocks(words, template):
    """Every block of twice the next power of two, and the share of the template's words in it."""
    wanted = words_of(template)
    size = 1
    while size < len(wanted):
        size *= 2
    at = 0
    while True:
        yield at, len(set(wanted) & set(words[at : at + 2 * size])) / len(set(wanted))
        if at + 2 * size >= len(words):
            return
        at += size


def plain(doc_id, text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    words = words_of(text)
    places = [
        (i, label)
        for phrase, label in phrases.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    base = {label for _, label in places}
    met = [
        (label, share)
        for label, texts in templates.items()
        for t in texts
        for _, share in plain_blocks(words, t)
        if words and share >= threshold - 1e-12
    ]
    starts = [i for i, _ in places]
    return (
        doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {label for label, _ in met})), 1.0 if places else max((s for _, s in met), default=0.0),
    )


def key(row):
    return [(x is None, x if x is not None else 0) for x in row]


def found(df, **options):
    scanned = licenses.license_scan(df, **options)
    assert scanned.columns == COLUMNS
    return sorted((tuple(r) for r in scanned.collect()), key=key)


def test_equals_plain_definition_on_documents(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    want = sorted((plain(r.doc_id, r.text) for r in table.collect()), key=key)
    assert sum(bool(r[6]) for r in want) >= 3
    assert found(table) == want


def test_planted_notices(spark):
    every = [t for texts in licenses.TEMPLATES.values() for t in texts]
    filler = ["the of and in to".split()[i % 5] + "x" * (i % 3) for i in range(400)]
    rows = []
    for i, notice in enumerate(every):
        words = notice.split()
        for at in (0, 7, 31, 64, 399):
            rows.append((len(rows), " ".join(filler[:at] + words + filler[at:])))
        rows.append((len(rows), " ".join(words[: len(words) // 2])))
        rows.append((len(rows), notice.upper().replace(" ", "\n\t-- ")))
    want = sorted((plain(*r) for r in rows), key=key)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want
    labels = {r[0]: r[6] for r in want}
    for i, label in enumerate(label for label, texts in licenses.TEMPLATES.items() for _ in texts):
        assert all(label in labels[7 * i + k].split(",") for k in (0, 1, 2, 3, 4, 6))


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_filters_lose_nothing(spark, threshold):
    """Random texts of few words against random templates of repeated words: all near the threshold."""
    rng = random.Random(int(threshold * 100))
    words = [f"w{i}" for i in range(14)]
    templates = {f"l{i}": [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(2)] for i in range(5)}
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 70)))) for i in range(250)]
    phrases = {"w1 w2": "a", "w3 w3": "b", "w4": "c"}
    want = sorted((plain(*r, phrases, templates, threshold) for r in rows), key=key)
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), phrases=phrases, templates=templates, threshold=threshold)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert [r[7] for r in got] == pytest.approx([r[7] for r in want])


def test_blocks(spark):
    text = "a b c " * 10 + "Released under the MIT license. " + "d e f " * 10
    rows = licenses.license_blocks(spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.label, r.containment) for r in rows} == {(1, "mit", 1.0)}
    assert all(r.first_word <= 30 and r.first_word + r.n_words >= 35 for r in rows)


def test_many_notices_in_one_text(spark):
    text = "Licensed under CC BY-NC 4.0. " * 30_000
    (row,) = found(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert row == (1, 210_000, 30_000, 2, 209_995, "cc-by-nc", "cc-by-nc", 1.0)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == sorted((plain(*r) for r in rows), key=key)
    assert found(nothing) == []


def test_no_python_in_the_plan(spark, small):
    scanned = licenses.license_scan(spark.read.parquet(f"{small}/documents.parquet"))
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|CartesianProduct", plan)


def test_base_in_sql(spark, small):
    """n_words and the number of places as DuckDB finds them."""
    import duckdb

    sql = rf"""
    WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(
        translate(coalesce(text, ''), '{licenses._UPPER}', '{licenses._LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') || ' ' AS t
        FROM '{small}/documents.parquet')
    SELECT doc_id, CASE WHEN t = '  ' THEN 0 ELSE len(string_split(t, ' ')) - 2 END,
      len(string_split(t, ' under the mit license ')) + len(string_split(t, ' apache license version 2 '))
      + len(string_split(t, ' cc by nc ')) - 3 FROM d"""
    got = licenses.license_scan(spark.read.parquet(f"{small}/documents.parquet")).select("doc_id", "n_words", F.col("n_base"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(duckdb.connect().execute(sql).fetchall())
