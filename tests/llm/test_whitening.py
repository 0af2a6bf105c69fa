import numpy as np
import pytest

from tallymart.llm import whitening
from tallymart.llm.eigen import eigen

SCHEMA = "vec_id long, embedding array<float>, label int, deviation long, n string, `a.b` int"


def plain(vectors, k=32):
    """Mean, covariance, eigenvalues by falling size, eigenvectors and exact deviations, by definition."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum(int(d) ** 2 for d in n * row - sums) for row in x]
    centred = (n * x - sums).astype(float) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    return deviation, centred, covariance, values[order], axes[:, order]


def as_matrix(rows, dims):
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, [None] * dims)[r.component - 1] = r.whitened
    return out


def test_equals_plain_definition(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    source = table.collect()
    deviation, centred, covariance, values, axes = plain([r.embedding for r in source])
    for parts in (1, 7):
        rows = whitening.whitened_components(table.repartition(parts)).collect()
        assert len(rows) == 32 * len(source)
        found = as_matrix(rows, 32)
        exact = {r.vec_id: r.deviation for r in rows}
        assert [exact[r.vec_id] for r in source] == deviation
        white = np.array([found[r.vec_id] for r in source])
        want = centred @ axes / np.sqrt(values)
        signs = np.sign((white * want).sum(axis=0))
        assert np.abs(white * signs - want).max() < 1e-9
        shares = {r.component: r.explained for r in rows}
        assert [shares[k + 1] for k in range(32)] == pytest.approx((values / np.trace(covariance)).tolist(), rel=1e-10)
        assert {r.n for r in rows} == {len(source)}
        error = {r.identity_error for r in rows}
        assert len(error) == 1 and error.pop() < 1e-10


def residual(matrix, values, vectors):
    wide = matrix.astype(np.longdouble)
    return float(np.abs(wide @ vectors - vectors * values).max() / np.abs(matrix).max())


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 50, 40),
    np.repeat([5.0, 3.0, 1.0], [3, 30, 7]),
    np.concatenate([1 + 1e-9 * np.arange(20), 1e-4 * (1 + 1e-12 * np.arange(20))]),
    np.zeros(6),
    np.array([1e9, 1, 1e-9, 0, 0]),
    np.array([2.0]),
])
def test_eigenvectors_to_double_precision(spectrum):
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(len(spectrum),) * 2))[0].astype(np.longdouble)
    matrix = (turn * spectrum) @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = eigen(matrix)
    assert values == pytest.approx(np.sort(spectrum)[::-1], rel=1e-12, abs=1e-13 * max(spectrum.max(), 1e-300))
    assert np.abs(vectors.T @ vectors - np.eye(len(spectrum))).max() < 1e-14
    if spectrum.any():
        assert residual(matrix, values, vectors) < 1e-15 * len(spectrum)


def test_clusters_are_told_apart():
    """Vectors of eigenvalues 1e-9 apart, far below float32, come out right."""
    spectrum = np.concatenate([1 + 1e-9 * np.arange(1, 9), [3.0, 7.0]])
    turn = np.linalg.qr(np.random.default_rng(6).normal(size=(10, 10)))[0].astype(np.longdouble)
    for _ in range(2):  # orthogonal beyond double precision
        turn = turn @ (3 * np.eye(10) - turn.T @ turn) / 2
    values, vectors = eigen((turn * spectrum) @ turn.T)
    overlap = np.abs(turn.astype(float).T @ vectors)[np.argsort(-spectrum)]
    assert np.abs(overlap - np.eye(10)).max() < 1e-7


def test_exact_products_of_large_entries():
    block = np.array([[2**30 + 1, -3], [2**29, 2**26 + 1], [5, 7]], np.int64)
    wide = block.astype(object)
    assert (whitening._products(block).astype(object) == wide.T @ wide).all()


def test_odd_rows(spark):
    good = [(i, [0.1 * i, -0.2 * (i % 3), 1.0], 0, 0, "x", 0) for i in range(12)]
    bad = [(50, None), (51, [0.0, None, 1.0]), (52, [float("nan"), 0.0, 0.0]), (53, [float("inf"), 0.0, 0.0]), (54, [])]
    rows = good + [good[3], (None, *good[4][1:])] + [(*b, 0, 0, "x", 0) for b in bad]
    found = whitening.whitened_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == 14 * 3 and {r.n for r in found} == {14}
    assert sum(r.vec_id == 3 for r in found) == 6 and sum(r.vec_id is None for r in found) == 3
    assert all((r.whitened is None) == (r.component == 3) for r in found)  # the third entry never varies
    assert found[0].identity_error < 1e-12
    deviation = plain([r[1] for r in good] + [good[3][1], good[4][1]])[0]
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)


def test_no_variance_and_no_rows(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 0, 0, "x", 0)] * 3, SCHEMA)
    rows = whitening.whitened_components(one).collect()
    assert len(rows) == 6
    assert all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in rows)
    for empty in (one.where("false"), one.withColumn("embedding", whitening.F.lit(None).cast("array<float>"))):
        found = whitening.whitened_components(empty)
        assert found.count() == 0 and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_different_lengths_fail(spark):
    table = spark.createDataFrame([(1, [0.5, 0.25], 0, 0, "x", 0), (2, [0.5], 0, 0, "x", 0)], SCHEMA)
    for parts in (1, 2):
        with pytest.raises(Exception, match="entries in one table|different lengths"):
            whitening.whitened_components(table.repartition(parts)).collect()


def test_deviation_beyond_long_is_exact_in_decimals(spark):
    table = spark.createDataFrame([(i, [2e5 * i, 3.0], 0, 0, "x", 0) for i in range(60)], SCHEMA)
    rows = whitening.usable(table)
    model = whitening.fit(rows)
    found = {r.vec_id: int(r.deviation) for r in whitening.project(rows, model).collect()}
    want = plain([r.embedding for r in table.collect()])[0]
    assert [found[i] for i in range(60)] == want and max(want) > 2**63
