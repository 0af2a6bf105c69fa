"""Eigenvectors of a symmetric matrix to double precision: single precision first, then refined.

The starting vectors are those of the matrix in float32. Each step of Ogita and Aishima's iteration takes
four matrix products and doubles the number of right digits. Products of the last steps are taken in
extended precision (``numpy.longdouble``). Where eigenvalues lie closer together than the step can tell
apart, the step only makes the vectors orthogonal; the small matrix that the cluster's vectors span is
then solved on its own, shifted by the cluster's mean, and the vectors are turned by the result.
"""

from __future__ import annotations

import numpy as np

STEPS = 30
EXACT_STEPS = 2


def _clusters(values: np.ndarray, width: float) -> list[slice]:
    """Runs of two or more neighbours in ``values`` (ascending) at most ``width`` apart."""
    cuts = np.flatnonzero(np.diff(values) > width) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1]


def _step(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction: new vectors, eigenvalues, the width of a cluster, and the size of the correction."""
    gram = np.eye(len(matrix), dtype=matrix.dtype) - vectors.T @ vectors
    form = vectors.T @ (matrix @ vectors)
    values = np.diag(form) / (1 - np.diag(gram))
    off = form - np.diag(values)
    width = 2 * (np.linalg.norm(off.astype(float)) + np.abs(values).max() * np.linalg.norm(gram.astype(float)))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > width
    correction = np.where(apart, (form + values[None, :] * gram) / np.where(apart, gaps, 1), gram / 2)
    return vectors + vectors @ correction, values, width, float(np.abs(correction).max())


def _solve_cluster(matrix: np.ndarray, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The cluster's vectors turned so that the matrix is diagonal between them."""
    centre = values.mean()
    small = vectors.T @ (matrix @ vectors) - centre * (vectors.T @ vectors)
    size = np.abs(small).max()
    if size == 0:
        return vectors
    small = ((small + small.T) / (2 * size)).astype(float)
    return vectors @ np.linalg.eigh(small)[1].astype(vectors.dtype)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric ``longdouble`` matrix."""
    size = np.abs(matrix).max() if matrix.size else 0
    if size == 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    exact = np.asarray(matrix, np.longdouble) / np.longdouble(size)
    vectors = np.linalg.eigh(exact.astype(np.float32))[1].astype(float)
    working = exact.astype(float)
    left, best = EXACT_STEPS, np.inf
    for _ in range(STEPS):
        vectors, values, width, moved = _step(working, vectors)
        order = np.argsort(values)
        vectors, values = vectors[:, order], values[order]
        for run in _clusters(values, width):
            vectors[:, run] = _solve_cluster(working, vectors[:, run], values[run])
        if working.dtype == np.longdouble:
            left -= 1
            if not left:
                break
        elif moved < 1e-12 or moved > best / 2:
            working, vectors = exact, vectors.astype(np.longdouble)
        best = min(best, moved)
    # Within a tight cluster rounding turns the vectors a little; that costs orthogonality in second order.
    vectors = vectors @ (3 * np.eye(len(vectors)) - vectors.T @ vectors) / 2
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    values = (vectors * (exact @ vectors)).sum(axis=0) * np.longdouble(size)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), vectors[:, order].astype(float)
