"""Whitening against an exact covariance and numpy's own eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from stemledger.llm import whitening


def brute(rows, components=4):
    """{(vec_id, component): values} from exact fractions and numpy's solver."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in kept}]
    n, dim = len(fit), len(fit[0])
    total = [sum(c) for c in zip(*fit)]
    centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(x, total)] for x in fit]
    v = np.array([[float(sum(x[i] * x[j] for x in centred) / n) for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, total))
        z = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, total)])
        for k in range(min(components, dim)):
            out[i, k + 1] = (n, deviation, abs(z @ vectors[:, k]) / math.sqrt(values[k]), values[k] / values.sum())
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, label string")


def test_rows_equal_those_of_exact_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.standard_normal(6) * [5, 3, 2, 1, 0.5, 0.2]]) for i in range(60)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    rows += [(2**53 + 1, rows[3][1]), (None, rows[4][1])]
    bad = [(70, None), (71, []), (72, [None] * 6), (73, [float("nan")] * 6), (74, [float("inf")] + [0.0] * 5)]
    got = whitening.whitened(table(spark, rows + bad)).collect()
    want = brute(rows)
    assert sorted(((r["vec_id"], r["component"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        n, deviation, score, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9
    by_id = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    assert by_id[2**53 + 1, 1] == by_id[3, 1]


def test_tables_without_directions(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None)])).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whitened(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(i, 1) for i in range(5)]
    assert all(r["explained"] == pytest.approx(1.0) for r in line)


def test_lengths_apart_and_very_large_entries(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, [3e38, 0.0, 0.0]), (5, [0.0, 0.0, 2.0])]
    got = whitening.whitened(table(spark, rows)).collect()
    assert {r["vec_id"]: r["n"] for r in got} == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3}
    assert {r["vec_id"] for r in got if r["deviation"] is None} == {3, 4, 5}


@pytest.mark.parametrize("kind", ["random", "same", "zero", "low rank", "graded", "clusters", "spike"])
def test_spectral_division(kind):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    values = {
        "random": rng.random(24), "same": np.full(24, 3.0), "zero": np.zeros(24), "low rank": [4.0, 2, 1] + [0.0] * 21,
        "graded": np.logspace(3, -12, 24), "clusters": np.repeat([7.0, 2, 1], 8), "spike": [1e9] + [1.0] * 23,
    }[kind]
    v = (q * np.asarray(values)) @ q.T
    v = (v + v.T) / 2
    found, vectors = whitening.spectral(v)
    scale = max(np.abs(v).max(), 1e-300)
    assert np.abs(found - np.linalg.eigvalsh(v)[::-1]).max() / scale < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * found).max() / scale < 1e-12


def test_polar_factor_has_the_signs_of_the_eigenvalues():
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.standard_normal((9, 9)))
    values = np.array([5.0, 1e-9, 3, -2, -1e-8, -7, 1, 1, -1])
    assert np.abs(whitening.polar((q * values) @ q.T) - (q * np.sign(values)) @ q.T).max() < 1e-6
