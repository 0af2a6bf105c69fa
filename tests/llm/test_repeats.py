import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tallymart.llm import repeats
from tallymart.llm import textbatch as tb

L = repeats.LENGTH


def brute(texts):
    """(bytes, removed, spans, digest) of each text, from all strings of L bytes."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + L] for d in data for i in range(len(d) - L + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - L + 1):
            if times[d[i : i + L]] > 1:
                gone[i : i + L] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    found = repeats.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == Counter((d, *b) for (d, _), b in zip(rows, brute([t for _, t in rows])))


def test_made_up_repeats(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(60), prose(400)
    rows = [(i, prose(60) + passage[: 180 + i] + prose(50)) for i in range(40)]  # strings just under and over the length
    rows += [(100, long), (101, long), (102, long[:900] + "X" + long[901:]), (103, long[7:450] + prose(5) + long[300:])]
    rows += [(200, "ab" * 300), (201, "z" * 199), (202, "z" * 200), (203, "z" * 201), (204, None), (205, ""), (None, passage)]
    rows += [(206, long), (206, long), (207, passage[5:205]), (208, "\x00" * 250), (209, "\x00" * 31 + passage)]
    check(spark, rows)


def test_anchor_runs_cover_every_string_once():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc "), 700)), "", "a" * 900, "".join(rng.choice(list("ab"), 230)), "x" * 150]
    part = tb.from_arrow(pa.array(texts))
    value, place, first, times, counts = repeats.anchors(part)
    at = 0
    for text, n in zip(texts, counts):
        covered = [i for k in range(at, at + n) for i in range(first[k], first[k] + times[k])]
        assert covered == list(range(max(len(text) - L + 1, 0)))
        assert all(f <= p and p + repeats.GRAM <= f + L for f, p in zip(first[at : at + n] + times[at : at + n] - 1, place[at : at + n]))
        at += n


def test_odd_rows(spark, odd, nothing):
    rows = repeats.repeated_bytes(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (None, 3, 4, 5, 6, 9, 10))
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id in (1, 2, 7, 8, 11))
    assert repeats.repeated_bytes(nothing).count() == 0
