"""Hard negatives against brute force: ties, clusters, odd rows, small slabs, and how the search ends."""

import math

import numpy as np
import pytest
from ferrule.llm import hard_negatives as module
from ferrule.llm.hard_negatives import hard_negatives
from pyspark.sql import functions as F


def brute(rows, asks, positives=5, negatives=3, least=50, most=95):
    good = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(256 * c) for c in v]
        good[i] = min(good.get(i, (y, x)), (y, x))
    out = []
    for a, (y, x) in good.items():
        if not asks(a):
            continue
        near = sorted(((-sum(p * q for p, q in zip(x, w)), i, z) for i, (z, w) in good.items() if i != a))
        for s, p, _ in [n for n in near if n[2] == y][:positives]:
            fit = [(-t, i) for t, i, z in near if z != y and least * -s <= 100 * -t <= most * -s][:negatives]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fit)]
    return sorted(out)


def table(seed, n=400, dim=8, grid=None):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)) + rng.integers(0, 3, (n, 1))
    if grid:
        v = np.round(v * grid) / grid
    return [(i * 3 - 50, x.astype(np.float32).tolist(), int(y)) for i, (x, y) in enumerate(zip(v, rng.integers(0, 4, n)))]


def answers(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in hard_negatives(df.repartition(3), F.col("vec_id") % 7 == 0).collect())


@pytest.mark.parametrize("seed, grid, slab", [(1, None, 2048), (2, 1, 16), (3, 2, 64)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, grid, slab):
    monkeypatch.setattr(module, "SLAB", slab)
    monkeypatch.setattr(module, "CHUNK", 10)
    monkeypatch.setattr(module, "ROWS_A_PIVOT", 20)
    rows = table(seed, grid=grid)
    got = answers(spark, rows)
    assert got == brute(rows, lambda i: i % 7 == 0) and got


def test_far_slabs_are_not_scanned(spark, monkeypatch):
    monkeypatch.setattr(module, "SLAB", 32)
    monkeypatch.setattr(module, "ROWS_A_PIVOT", 40)
    rng = np.random.default_rng(8)
    centres = 20 * rng.standard_normal((12, 6))
    rows = [(i, (centres[i % 12] + rng.standard_normal(6)).tolist(), i % 5) for i in range(1200)]
    seen, plain = [], module._scored

    def counted(tiles, *rest):
        seen.append(tiles.where("side = 1").count())
        return plain(tiles, *rest)

    monkeypatch.setattr(module, "_scored", counted)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") == 77).collect())
    assert got == brute(rows, lambda i: i == 77) and got
    assert sum(seen) < 1200  # two searches over 1,200 rows would be 2,400


def test_odd_rows_few_rows_and_clashing_names(spark):
    same = [1.0, 0.5]
    rows = [
        (0, same, 1), (7, same, 1), (14, same, 2), (1, [0.9, 0.3], 2), (2, [0.7, 0.4], 3), (3, [0.0, 0.0], 2), (4, [-1.0, -1.0], 1), (5, [1.0], 3), (6, [], 2),
        (21, None, 1), (28, [None, 1.0], 1), (35, same, None), (None, same, 1), (42, [float("nan"), 1.0], 1), (49, [float("inf"), 1.0], 1), (2, [0.7, 0.4], 3), (56, [0.0, 0.0], 1),
    ]
    assert answers(spark, rows) == brute(rows, lambda i: i % 7 == 0)
    wide = spark.createDataFrame([(*r, "s", 1.0, 2) for r in rows], "vec_id long, embedding array<double>, label int, chunk string, x double, asks int")
    assert sorted(tuple(r) for r in hard_negatives(wide, F.col("vec_id") % 7 == 0).collect()) == brute(rows, lambda i: i % 7 == 0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert hard_negatives(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert hard_negatives(df.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []
    assert hard_negatives(df.where("label = 1"), F.col("vec_id") == 0).collect() == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(3) * 3e5).tolist(), int(i % 2)) for i in range(60)]
    assert answers(spark, rows, "vec_id long, embedding array<double>, label int") == brute(rows, lambda i: i % 7 == 0)
