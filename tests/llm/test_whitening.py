import math

import numpy as np
import pytest

from hydrospark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string"


def plain(vectors, k=4):
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for r in x.tolist()]
    return n, deviation, (x - sums / n).astype(float) @ axes / np.sqrt(values), values / (centred**2).sum() * n


def check(spark, vectors, extra=()):
    rows = [(i, [float(c) for c in v], 7, "q") for i, v in enumerate(vectors)] + [(900 + i, v, 1, "z") for i, v in enumerate(extra)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    n, deviation, white, explained = plain(vectors)
    assert sorted((r.vec_id, r.component) for r in got) == [(i, j + 1) for i in range(len(vectors)) for j in range(white.shape[1])]
    turn = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        want = white[r.vec_id, r.component - 1]
        sign = turn.setdefault(r.component, 1 if want * r.whitened > 0 else -1)
        assert r.whitened == pytest.approx(sign * want, abs=1e-9)
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9


def test_whitened(spark):
    pick = np.random.default_rng(1)
    vectors = (pick.standard_normal((300, 24)) * np.linspace(3, 1, 24) + 1).astype(np.float32)
    nan, inf = float("nan"), float("inf")
    check(spark, np.vstack((vectors, vectors[:40], [vectors[0]] * 200)),
          extra=[None, [], [1.0, None] * 12, [nan] * 24, [inf] + [0.0] * 23, [-inf] * 24, [1.0, 2.0]])


def test_few_dimensions_and_ties(spark):
    check(spark, [[-0.0, 0.001], [1, 0.5], [0.25, 3], [2, -1.5]])
    check(spark, [[1], [2], [4]])
    square = np.repeat(np.eye(3, dtype=np.float32), 2, axis=0) * np.tile([[3], [-3]], (3, 1))
    rows = spark.createDataFrame([(i, [float(c) for c in v], 0, "") for i, v in enumerate(square)], SCHEMA)
    got = whitening.whitened(rows).collect()
    assert len(got) == 18 and max(r.identity_error for r in got) < 1e-9
    assert {round(r.explained, 9) for r in got} == {round(1 / 3, 9)}


def test_nothing_to_whiten(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, ""), (3, None, 0, "")], SCHEMA)
    assert whitening.whitened(same).count() == 0
    assert whitening.whitened(same.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0, "") for i in range(5)], SCHEMA)
    assert {r.component for r in whitening.whitened(line).collect()} == {1}


def test_solver_against_dense():
    pick = np.random.default_rng(3)
    turn, _ = np.linalg.qr(pick.standard_normal((60, 60)))
    for spectrum in (np.linspace(1, 2, 60), np.r_[np.ones(55), 5, 5, 5, 5 - 1e-9, 9], np.geomspace(1e-12, 1, 60), np.r_[np.zeros(57), 1, 2, 3]):
        matrix = turn * spectrum @ turn.T
        values, vectors, residuals = whitening.jacobi_davidson(lambda v, m=matrix: m @ v, 60, whitening.Spec())
        assert values == pytest.approx(np.sort(spectrum)[::-1][:4], abs=1e-12)
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13 and residuals.max() < 1e-11


def test_minres():
    pick = np.random.default_rng(5)
    half = pick.standard_normal((12, 12))
    matrix, right = half + half.T, pick.standard_normal((12, 3))
    found = whitening._minres(lambda v: matrix @ v, right, 60, 1e-14)
    assert np.abs(matrix @ found - right).max() < 1e-8
