"""Whitened rows against an eigendecomposition of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest
from ferrule.llm import whitening
from ferrule.llm.whitening import whiten


def expected(vectors, components=32):
    """(n, deviations, eigenvalues, axes, centred rows, trace) from exact sums."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(dim)]
    dev = [sum((n * r[d] - s[d]) ** 2 for d in range(dim)) for r in x]
    centred = np.array([[float(Fraction(n * r[d] - s[d], n)) for d in range(dim)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return n, dev, values[order], axes[:, order], centred, float(Fraction(sum(dev), n**3))


def check(rows, got, components=32):
    n, dev, values, axes, centred, trace = expected([v for _, v in rows], components)
    keep = values > 1e-9 * values[0]
    values, axes = values[keep], axes[:, keep]
    want = centred @ axes / np.sqrt(values)
    at = {i: k for k, (i, _) in enumerate(rows)}
    table = np.full(want.shape, np.nan)
    for r in got:
        k = at[r.vec_id]
        assert (r.n, r.deviation) == (n, dev[k])
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        assert r.identity_error < 1e-6
        table[k, r.component - 1] = r.whitened
    sign = np.sign((table * want).sum(axis=0))
    assert np.abs(table - want * sign).max() < 1e-6
    assert len(got) == want.size


@pytest.mark.parametrize("dim", [1, 5, 40, 120])
def test_whitening_equals_eigenvectors(spark, dim):
    rng = np.random.default_rng(dim)
    v = (rng.standard_normal((300, dim)) * np.linspace(1, 4, dim) @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    check(rows, whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect())


def test_odd_rows_clashing_names_and_exact_sums(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(k, rng.standard_normal(4).tolist()) for k in range(50)] + [(77, [1e3, 2.0, -3e3, 0.5]), (78, [0.0] * 4)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 2.0, 3.0]), (103, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 3, "w") for i, v in rows + odd], "vec_id long, embedding array<double>, n int, w string")
    check(rows, whiten(df).collect())
    monkeypatch.setattr(whitening, "SAFE", 0)
    check(rows, whiten(df).collect())
    short = [*rows, (200, [2.0, 1.0]), (201, [])]
    filled = [(i, v + [0.0] * (4 - len(v))) for i, v in short]
    check(filled, whiten(spark.createDataFrame(short, "vec_id long, embedding array<double>")).collect())


def test_directions_without_variance_are_no_components(spark):
    rng = np.random.default_rng(4)
    flat = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 6))
    rows = [(k, [*(np.floor(x * 64) / 64).tolist(), 5.0]) for k, x in enumerate(flat)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=2)
    assert {r.component for r in got.collect()} == {1, 2}
    constant = spark.createDataFrame([(k, [1.0, 2.0, float(k)]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whiten(constant).collect()} == {1}
    assert whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "vec_id long, embedding array<double>")).collect() == []
    assert whiten(constant.limit(0)).collect() == [] and whiten(constant.limit(0)).columns == whiten(constant).columns


def test_repeated_and_null_ids_are_rows_like_others(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [4.0, 0.0]), (2, [0.0, 1.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted([(i is None, i or 0, c) for i, _ in rows for c in (1, 2)])
    assert {r.n for r in got} == {4}
