import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymart.llm import near_dedup
from tallymart.llm.components import connected_components
from tallymart.llm.superminhash import band_keys, signatures

LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def groups(rows, size, percent):
    """doc_id -> (set size, smallest id reachable), by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, size) for d, t in rows}
    owners = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            owners[g].append(d)
    common = Counter()
    for some in owners.values():
        some = sorted(some)
        common.update((a, b) for i, b in enumerate(some) for a in some[:i])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def check(spark, rows, size, percent=80):
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()
    want = groups(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in found)


@pytest.mark.parametrize("size", [4, 5])
def test_documents_match_brute_force(spark, small, size):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, size)


def near_copies(rng, n, words, changes, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.choice(changes)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [400, 7])
def test_large_bucket_with_outliers(spark, monkeypatch, block):
    """Near copies around the threshold, of several parents, in buckets and blocks larger than the limits."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", block)
    rng = random.Random(5)
    texts = near_copies(rng, 60, 120, [0, 1, 2, 4, 8]) + near_copies(rng, 50, 60, [1, 2, 3]) + near_copies(rng, 80, 200, [5, 8, 11])
    rng.shuffle(texts)
    check(spark, [(i * 3 + 1, t) for i, t in enumerate(texts)], 4)


def test_a_group_around_the_threshold_makes_no_row_per_pair(spark, monkeypatch):
    """Pairs at 0.75 to 0.85: all links found, and rows stay far below the number of pairs."""
    rng = random.Random(9)
    texts = near_copies(rng, 400, 150, [2, 3, 4])
    seen = []
    materialize = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: seen.append((name, materialize(df, name))) or seen[-1][1])
    check(spark, [(i, t) for i, t in enumerate(texts)], 4)
    rows = {}
    for name, df in seen:
        rows[name] = rows.get(name, 0) + df.count()
    assert "between" in rows and max(rows[n] for n in ("pairs", "linked", "meeting", "between")) < 400 * 40
    assert rows["between"] < 800


@pytest.mark.parametrize("columns", [3, 4096])
def test_intersections_of_blocks(monkeypatch, columns):
    monkeypatch.setattr(near_dedup, "COLUMNS_AT_ONCE", columns)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30), dtype=np.uint64)) for _ in range(15)]
    found = near_dedup._shared(sets[:6], sets[6:])
    assert found.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[6:]] for a in sets[:6]]
    parts = np.array([1, 1, 5, 7]), np.array([5, 9, 7])
    linked = np.array([[1, 1, 0], [1, 0, 0], [0, 1, 1], [0, 0, 1]], bool)
    kept = near_dedup._joined_components(*parts, linked & (parts[0][:, None] != parts[1][None, :]))
    assert len(kept) == 3 and {x for pair in kept for x in pair} == {1, 5, 7, 9}


def test_odd_rows(spark, odd, nothing):
    found = near_dedup.near_duplicates(odd, size=4).collect()
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    assert len(found) == odd.count()
    assert all(r.component_id is None and r.kept for r in by_id[None])
    assert [(r.component_id, r.kept) for r in by_id[2]] == [(1, False)] * 2
    assert [(r.n_shingles, r.component_id) for d in (3, 4, 5) for r in by_id[d]] == [(0, 3), (0, 4), (0, 5)]
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    random.Random(1).shuffle(edges)
    found = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    labels = {r.node: r.component for r in found.collect()}
    assert labels == {i: 1 for i in range(2, 301)} | {1001: 1000}


def test_signatures_estimate_similarity_with_less_spread_than_independent_hashes():
    rng = np.random.default_rng(0)
    sets, counts = [], []
    for _ in range(200):
        both = rng.integers(1, 2**62, 60, dtype=np.uint64)
        sets += [both[:40], both[20:]]
        counts += [40, 40]
    table = signatures(np.concatenate(sets), np.array(counts), 128)
    shared = (table[::2] == table[1::2]).mean(axis=1)
    assert abs(shared.mean() - 1 / 3) < 0.01
    assert shared.std() < 0.9 * np.sqrt(1 / 3 * 2 / 3 / 128)


def test_signatures_ignore_order_repeats_and_chunks():
    values = np.random.default_rng(1).integers(1, 2**62, 70_000, dtype=np.uint64)
    a = signatures(values, np.array([len(values)]), 200)
    b = signatures(np.concatenate([values[::-1], values[:500]]), np.array([len(values) + 500]), 200)
    assert np.array_equal(a, b)
    assert np.array_equal(band_keys(a, 40), band_keys(b, 40))
    assert (signatures(np.zeros(0, np.uint64), np.array([0]), 8) == np.uint64(2**64 - 1)).all()
