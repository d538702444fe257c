"""Largest eigenvalues of a symmetric positive semidefinite matrix by contour integration (FEAST).

1. Householder steps bring the matrix to three diagonals; by Sylvester's law the signs of the pivots of T - s I count
   the eigenvalues above s. Bisection on these counts finds gaps in the spectrum and cuts it into intervals there.
2. For each interval a circle around it is walked by Gauss-Legendre nodes. The sum of the complex shifted solves
   (z I - A)^-1 Y projects Y onto the eigenvectors inside. The solves of all nodes and intervals run as one Spark job.
3. Rayleigh-Ritz on the projected block extracts the eigenpairs; the block is projected again until they stand still.
4. An interval is done when it holds as many eigenvalues as the counts say; else its block is widened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

NODES = 8
#: A cut between neighbouring eigenvalues needs this share of the larger one between them, and this share of the trace
#: (vectors of two intervals are orthogonal only to rounding over their distance).
GAP, CLEAR = 0.05, 1e-6
EXTRA = 6
TURNS = 12
EXACT = 1e-14


class Counts:
    """How many eigenvalues of a symmetric matrix lie above a number."""

    def __init__(self, a: np.ndarray) -> None:
        a = a.copy()
        d = len(a)
        for k in range(d - 2):
            x = a[k + 1:, k].copy()
            norm = np.linalg.norm(x)
            if norm == 0:
                continue
            x[0] += np.copysign(norm, x[0])
            x /= np.linalg.norm(x)
            a[k + 1:, :] -= 2 * np.outer(x, x @ a[k + 1:, :])
            a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ x, x)
        self.main, self.beside = np.diag(a).copy(), np.diag(a, 1) ** 2
        self.small = np.finfo(float).tiny ** 0.5

    def above(self, s: float) -> int:
        count, pivot = 0, 1.0
        for i, entry in enumerate(self.main):
            pivot = entry - s - (self.beside[i - 1] / pivot if i else 0.0)
            if abs(pivot) < self.small:
                pivot = -self.small
            count += pivot > 0
        return count

    def value(self, k: int, low: float, high: float) -> float:
        """The k-th largest eigenvalue, up to rounding."""
        while (middle := (low + high) / 2) not in (low, high):
            if self.above(middle) >= k:
                low = middle
            else:
                high = middle
        return high


def intervals(counts: Counts, d: int, wanted: int, low: float, high: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), the highest first, that together hold at least the `wanted` largest."""
    values: list[float] = []
    best = wanted
    while True:
        values.append(counts.value(len(values) + 1, low, high))
        m = len(values)
        if m == d:
            best, values = d, [*values, low]
            break
        if m <= wanted:
            continue
        gaps = [values[i - 1] - values[i] for i in range(wanted, m)]
        best = wanted + int(np.argmax(gaps))
        if gaps[best - wanted] >= GAP * values[best - 1] or m >= wanted + EXTRA and gaps[best - wanted] > 1e-6 * values[best - 1]:
            break
    cuts = [i for i in range(1, best) if values[i - 1] - values[i] >= max(GAP * values[i - 1], CLEAR)] + [best]
    out, top, done = [], high, 0
    for i in cuts:
        bottom = (values[i - 1] + values[i]) / 2
        out.append((bottom, top, i - done))
        top, done = bottom, i
    return out


def _solves(spark: SparkSession, a: np.ndarray, blocks: dict[int, tuple[float, float, np.ndarray]]) -> dict[int, np.ndarray]:
    """The projected block of each interval; one task for each interval and node."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    jobs = [(key, node) for key in blocks for node in range(NODES)]
    sent = spark.sparkContext.broadcast((a, blocks))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, held = sent.value
        for frame in frames:
            for key, node in zip(frame["interval"], frame["node"], strict=True):
                low, high, block = held[key]
                turn = (high - low) / 2 * np.exp(1j * np.pi * (1 + points[node]) / 2)
                shifted = ((low + high) / 2 + turn) * np.eye(len(matrix)) - matrix
                part = (turn * np.linalg.solve(shifted, block)).real * weights[node] / 2
                yield pd.DataFrame({"interval": [key], "part": [part.tobytes()]})

    table = spark.createDataFrame(jobs, "interval int, node int").repartition(len(jobs))
    out = {key: np.zeros_like(block) for key, (_, _, block) in blocks.items()}
    for row in table.mapInPandas(run, "interval int, part binary").collect():
        out[row.interval] += np.frombuffer(row.part).reshape(out[row.interval].shape)
    return out


def largest(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Equal eigenvalues give any orthonormal basis of their space. The matrix has as many rows as a vector has entries,
    so it fits into one process whatever the number of vectors; it must not be zero.
    """
    d, scale = len(matrix), float(np.trace(matrix))
    a = (matrix + matrix.T) / (2 * scale)
    wanted = min(wanted, d)
    spans = intervals(Counts(a), d, wanted, -1e-3, 1 + 1e-3)
    rng = np.random.default_rng(11)
    size = {k: min(d, n + max(2, n // 2)) for k, (_, _, n) in enumerate(spans)}
    blocks = {k: rng.standard_normal((d, size[k])) for k in size}
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    turns = dict.fromkeys(size, 0)
    while open_ := [k for k in size if k not in found]:
        projected = _solves(spark, a, {k: (spans[k][0], spans[k][1], blocks[k]) for k in open_})
        for k in open_:
            low, high, n = spans[k]
            basis, _ = np.linalg.qr(projected[k])
            values, turn = np.linalg.eigh(basis.T @ a @ basis)
            vectors = basis @ turn
            inside = (values > low) & (values <= high)
            off = np.linalg.norm(a @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if inside.sum() == n and (off <= EXACT * d).all():
                found[k] = values[inside], vectors[:, inside]
                continue
            blocks[k], turns[k] = vectors, turns[k] + 1
            if turns[k] == TURNS:  # too narrow a block; a whole one is exact
                turns[k], size[k] = 0, min(d, 2 * size[k])
                blocks[k] = np.hstack((vectors, rng.standard_normal((d, size[k] - vectors.shape[1])))) if size[k] > vectors.shape[1] else vectors
                if size[k] == vectors.shape[1] and inside.sum() == n:
                    found[k] = values[inside], vectors[:, inside]
    values = np.concatenate([found[k][0] for k in size])
    vectors = np.hstack([found[k][1] for k in size])
    first = np.argsort(-values, kind="stable")[:wanted]
    return values[first] * scale, vectors[:, first]
