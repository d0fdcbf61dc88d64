"""Surfaces from more control points than one array of distances holds."""

import numpy as np
import pytest

from loamgrid.operators import interpolation as I


def cloud(n, seed=4):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.uniform(0, 100, (n, 2)), rng.normal(0, 1, n)])


def test_any_number_of_control_points(spark):
    df = spark.range(50_100).selectExpr("id % 300 + 0.5D as x", "floor(id / 300) * 1.0D as y", "id * 1.0D as v")
    assert I.control_points(df, "x", "y", "v").shape == (50_100, 3)


def test_tin_from_the_points_around():
    p = cloud(300)
    q = np.vstack([np.random.default_rng(2).uniform(-5, 105, (60, 2)), p[:5, :2]])
    assert np.allclose(I.tin(p, q), I.tin(p, q, whole=10), equal_nan=True)
    assert np.isnan(I.tin(p, q)).any() and not np.isnan(I.tin(p, q, True, 10)).any()


@pytest.mark.parametrize("session", [False, True])
def test_variogram_in_blocks(spark, monkeypatch, session):
    p = cloud(200)
    i, j = np.triu_indices(len(p), 1)
    h, g = np.hypot(*(p[i, :2] - p[j, :2]).T), (p[i, 2] - p[j, 2]) ** 2 / 2
    monkeypatch.setattr(I, "BLOCK", 3000)
    top, sums = I.variogram_sums(p, spark if session else None)
    assert top == pytest.approx(h.max() / 2)
    b = (h[h < top] / top * 12).astype(int)
    assert np.allclose(sums[:, :12], [np.bincount(b, w, 12) for w in (None, h[h < top], g[h < top])])
    less = I._sums_without(p, 77, top, sums)
    assert less is None or np.allclose(less[1], I.variogram_sums(np.delete(p, 77, 0))[1])


def test_nearest_in_blocks(monkeypatch):
    p, q = cloud(200), cloud(70, 5)[:, :2]
    want = [f(p, q) for f in (I.idw, I.nearest, I.natural_neighbour)]
    monkeypatch.setattr(I, "BLOCK", 900)
    assert all(np.allclose(f(p, q), w) for f, w in zip((I.idw, I.nearest, I.natural_neighbour), want, strict=True))
