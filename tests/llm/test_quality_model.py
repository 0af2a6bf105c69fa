import numpy as np
from pyspark.sql import functions as F

from tallymart.llm import quality_model
from tallymart.llm.common import is_held_out

ROOT = "/root/testdata/sf0.01"


def _scored(spark):
    held_out = is_held_out(F.col("doc_id"))
    labels = spark.read.parquet(f"{ROOT}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scored = quality_model.quality_scores(spark.read.parquet(f"{ROOT}/documents.parquet"), labels, ~held_out)
    return scored.join(labels, "doc_id").select("doc_id", "score", "predicted", "label", held_out.alias("held_out")).collect()


def test_held_out_accuracy(spark):
    rows = [r for r in _scored(spark) if r.held_out]
    assert np.mean([r.predicted == r.label for r in rows]) > 0.95
    good, bad = ([r.score for r in rows if r.label == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.99


def test_scores_do_not_depend_on_the_run(spark):
    assert sorted(_scored(spark)) == sorted(_scored(spark))


def test_shards_follow_from_the_ids(spark):
    """The same weights from 4 and from 211 partitions, with as many vectors as shards."""
    labels = spark.read.parquet(f"{ROOT}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts in (4, 211):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(quality_model.fit(docs.repartition(parts), labels, F.lit(True)))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert np.array_equal(*found)
    repeated = docs.union(docs.withColumn("text", F.concat(F.col("text"), F.lit(" more words"))))  # later in byte order
    assert np.array_equal(found[0], quality_model.fit(repeated, labels, F.lit(True)))
    rows = docs.join(labels, "doc_id").collect()
    shard = {r.doc_id: r.s for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(4)).alias("s")).collect()}
    each = [quality_model._train([(r.text.encode(), r.label) for r in sorted(rows) if shard[r.doc_id] == k]) for k in range(4)]
    assert np.array_equal(found[0], np.mean(each, axis=0))


def test_training_equals_a_plain_loop():
    """FTRL-proximal by its definition, one coordinate at a time."""
    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(["good", "fine", "bad", "junk!!", "word"], 30, p=[0.3, 0.3, 0.1, 0.1, 0.2] if y else [0.1, 0.1, 0.3, 0.3, 0.2])).encode(), int(y)) for y in rng.integers(0, 2, 40)]
    q = quality_model
    n, z = {}, {}
    share = [max(sum(y == k for _, y in rows), 1) for k in (0, 1)]
    prior = min(max(np.mean([y for _, y in rows]), 0.05), 0.95)
    bias = np.log(prior / (1 - prior))

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= q.L1 else -(zi - np.sign(zi) * q.L1) / ((q.BETA + np.sqrt(n.get(i, 0.0))) / q.ALPHA + q.L2)

    examples = []
    for text, y in rows:
        slot, counts = q.features(q.tb.Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
        times = {}
        for i in slot.tolist():
            times[i] = times.get(i, 0) + 1
        examples.append(({i: q.SCALE * t / (len(slot) + q.DAMPING) for i, t in times.items()}, y))
    for epoch in range(q.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            x, y = examples[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-(sum(w[i] * v for i, v in x.items()) + bias)))
            for i, v in x.items():
                g = len(rows) / (2.0 * share[y]) * (p - y) * v
                z[i] = z.get(i, 0.0) + g - (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / q.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = q._train(rows)
    want = np.zeros(len(got))
    for i in z:
        want[i] = weight(i)
    want[-1] = bias
    assert np.abs(got - want).max() < 1e-5 and np.abs(want).max() > 0.1


def test_odd_rows_and_no_labels(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = quality_model.quality_scores(odd, none, F.lit(True)).collect()
    assert len(rows) == odd.count() and {(r.score, r.predicted) for r in rows} == {(0.5, 0)}
    some = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (8, None), (None, 1), (3, 1), (9, 5)], "doc_id long, label int")
    rows = quality_model.quality_scores(odd, some, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert quality_model.quality_scores(nothing, some, F.lit(True)).count() == 0


def test_accepted_keeps_whole_rows(spark, odd):
    weights = np.zeros((1 << quality_model.BITS) + 1, np.float32)
    assert quality_model.accepted(odd, weights, 0.5).count() == odd.count()
    assert quality_model.accepted(odd, weights, 0.51).count() == 0
    assert quality_model.accepted(odd, weights, 0.5).columns == odd.columns
