import math
import random

import numpy as np
import pytest

from tallyforge.llm import feast
from tallyforge.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, x int, part string, component long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "p", 3) for i, v in rows], SCHEMA).repartition(3)


def whole(vector, d):
    if vector is None or any(c is None or not math.isfinite(c) for c in vector):
        return None
    x = [math.floor(float(np.float32(c)) * 256) + 0 for c in vector]
    return tuple(x + [0] * (d - len(x)))


def expected(rows, k=4):
    d = max((len(v) for _, v in rows if whole(v, 0) is not None), default=0)
    kept = [(i, whole(v, d)) for i, v in rows if whole(v, d) is not None]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    centred = np.array([[v - s / n for v, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        centre = np.array([v - s / n for v, s in zip(x, sums, strict=True)])
        out.setdefault((i, x), []).append((n, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), centre @ vectors / np.sqrt(values), values))
    return kept, out, values / np.trace(centred.T @ centred / n)


def test_rows_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1 + j) + (i % 3) * j for j in range(7)]) for i in range(60)]
    rows += [(i, rows[0][1]) for i in range(100, 140)] + [(5, rows[5][1]), (None, rows[6][1]), (None, None), (200, None), (201, [1.0, None] + [0.0] * 5),
             (202, [float("nan")] * 7), (203, [float("inf")] + [0.0] * 6), (204, [-0.0] * 7), (205, [1.5, -2.5]), (206, [])]
    got = wh.whitened(table(spark, rows)).collect()
    kept, want, explained = expected(rows)
    assert len(got) == 4 * len(kept)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9
    n = next(iter(want.values()))[0][0]
    by_deviation = {}
    for r in got:
        assert r.n == n and abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[r.component - 1]
        by_deviation.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = np.zeros(4)
    for (i, _), copies in want.items():
        held = by_deviation[(i, copies[0][1])]
        for c in range(4):
            assert len(held[c + 1]) == len(copies)
            for value in held[c + 1]:
                assert abs(abs(value) - abs(copies[0][2][c])) < 1e-9
                if abs(value) > 1e-6:
                    sign = math.copysign(1, value) * math.copysign(1, copies[0][2][c])
                    assert signs[c] in (0, sign)
                    signs[c] = sign


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])], [(1, [float("nan")])]])
def test_tables_without_variance_give_no_rows(spark, rows):
    df = table(spark, rows) if rows else table(spark, [(1, None)]).where("false")
    assert wh.whitened(df).collect() == []


def test_few_dimensions_low_rank_and_large_entries(spark):
    two = wh.whitened(table(spark, [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component) for r in two) == [(i, c) for i in (1, 2, 3) for c in (1, 2)]
    line = wh.whitened(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    huge = wh.whitened(table(spark, [(i, [1e12 * i, float(i % 2)]) for i in range(5)])).collect()
    assert all(r.deviation is None or r.deviation >= 0 for r in huge) and len(huge) >= 5
    assert wh._deviations(np.array([[3, 4]]), 10**9, [0, 0]) == [None] and wh._deviations(np.array([[1, 1]]), 2 * 10**9, [0, 0]) == [8 * 10**18]


def psd(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [1.0] * 6, [3, 3, 3, 3, 3, 1, 1], [9, 1e-9, 1e-10, 0, 0], [7], [2, 2],
                                    list(np.linspace(1, 1.3, 30)), [1, 1 - 1e-9, 1 - 2e-9, 1 - 3e-9, 1 - 4e-9, 0.2], [1e6] + [1.0 + i * 1e-3 for i in range(20)]])
def test_eigenpairs_by_contours(spark, values):
    a = psd(values, len(values))
    found, vectors = feast.largest(spark, a, 4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:4]
    assert np.allclose(found, want, rtol=0, atol=1e-12 * np.trace(a))
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-7)
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() <= 1e-11 * np.trace(a)
    counts = feast.Counts(a)
    for s in np.random.default_rng(1).uniform(0, max(values), 20):
        assert counts.above(s) == (np.linalg.eigvalsh(a) > s).sum()
