import random

import pyarrow as pa

from tallymart.llm import decontaminate as dc
from tallymart.llm import textbatch as tb


def _items(n=60, seed=1):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(25)]
    words = lambda k: [rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(3000)}x" for _ in range(k)]
    return [(i, " ".join(words(rng.randint(6, 30))).capitalize() + ". " + " ".join(words(rng.randint(3, 8))) + ".") for i in range(n)]


def test_block_max_wand_equals_full_scoring():
    items = _items()
    index = dc.Index(items)
    rng = random.Random(2)
    for _ in range(300):
        query = set()
        for _, text in rng.sample(items, rng.randint(1, 4)):
            words = dc._hashes(text)
            query |= set(rng.sample(words, rng.randint(1, len(words))))
        scores = {}
        for term in query:
            for item, weight in zip(index.postings[term].items, index.postings[term].weights):
                scores[item] = scores.get(item, 0.0) + weight
        found = dict(index.search(query))
        assert found.keys() == {i for i, s in scores.items() if s >= dc.THRESHOLD - 1e-9}
        assert all(abs(found[i] - scores[i]) < 1e-9 for i in found)


def test_bulk_bound_loses_no_match():
    """Every window of every text that reaches the threshold is left by the bulk bound."""
    items = _items()
    index = dc.Index(items)
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = [f"c{rng.randrange(25)}" for _ in range(rng.randint(0, 400))]
        for _, text in rng.sample(items, 2):
            some = text.split()
            some = [w if rng.random() < 0.75 else "zz" for w in some]
            at = rng.randint(0, len(words))
            words[at:at] = some
        texts.append(" ".join(words))
    part = tb.from_arrow(pa.array(texts))
    spans, hashes = dc.words_of(part)
    left = {(int(t), int(low)) for t, low, _ in zip(*index.passages(hashes, spans.bounds))}
    for t in range(len(texts)):
        for low in range(spans.bounds[t], spans.bounds[t + 1], index.stride):
            window = set(hashes[low : min(low + 2 * index.stride, spans.bounds[t + 1])].tolist())
            if index.search(window):
                assert (t, low) in left


def test_documents_that_contain_an_item_are_found(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()}
    plain = lambda t: " ".join(t.lower().split())
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    wanted = {(d, r.item_id) for d, t in texts.items() for r in items.collect() if plain(r.text) in t}
    assert wanted and wanted <= found
    assert len(found - wanted) <= 0.1 * len(wanted)  # near copies of an item
    kept = {r.doc_id for r in dc.decontaminated(docs, items).collect()}
    assert kept == texts.keys() - {d for d, _ in found}


def test_blocks_of_items_give_the_same_matches(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    one = {(r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()}
    monkeypatch.setattr(dc, "INDEX_BYTES", 2_000)
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()} == one


def test_odd_rows(spark, odd, nothing):
    benchmark = spark.createDataFrame(
        [(1, "One two three four five six. One two three four five six."), (2, None), (None, "some words in it that match"), (3, ""), (4, "word"), (5, "une naïve ÉTÉ à la ßtraße")],
        "item_id long, text string",
    )
    found = {(r.doc_id, r.item_id) for r in dc.leaks(odd, benchmark).collect()}
    assert {(1, 1), (2, 1)} <= found and {i for _, i in found} <= {1, 5, None}
    assert dc.decontaminated(odd, benchmark).columns == odd.columns
    assert dc.leaks(nothing, benchmark).count() == 0
    assert dc.leaks(odd, benchmark.where("false")).count() == 0
    assert dc.decontaminated(odd, benchmark.where("false")).count() == odd.count()


def test_statistics_do_not_depend_on_blocks(spark, monkeypatch):
    """Scores and verdicts are the same whether the items are one index or many."""
    items = _items(80, seed=5)
    rng = random.Random(6)
    texts = []
    for i in range(60):
        words = " ".join(t for _, t in rng.sample(items, 2)).split()
        texts.append((i, " ".join(w for w in words if rng.random() < 0.9)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(tuple(r) for r in dc.leaks(docs, benchmark).collect())
    assert one
    monkeypatch.setattr(dc, "INDEX_BYTES", 900)
    many = sorted(tuple(r) for r in dc.leaks(docs, benchmark).collect())
    assert [r[:2] + r[3:] for r in many] == [r[:2] + r[3:] for r in one]
    assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(one, many))
    whole = dc.Statistics.of(items)
    (index, names), *_ = dc._indexes(benchmark)
    assert index.stride == max(dc.MIN_STRIDE, whole.longest) and set(names.values()) <= {i for i, _ in items}


def test_every_item_row_counts(spark):
    """Items without an id, and different items of one id, are searched too."""
    first, second, third = (f"w{k}a w{k}b w{k}c w{k}d w{k}e w{k}f. w{k}g w{k}h w{k}i." for k in "xyz")
    benchmark = spark.createDataFrame([(None, first), (1, second), (1, third), (1, third)], "item_id long, text string")
    docs = spark.createDataFrame([(10, "some " + first), (11, second), (12, third), (13, "clean text of many words that is in no item")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()) == [(10, None), (11, 1), (12, 1)]
    assert [r.doc_id for r in dc.decontaminated(docs, benchmark).collect()] == [13]
