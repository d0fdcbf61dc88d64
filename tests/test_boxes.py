"""Layers of upright rectangles, alone and mixed with other shapes, against the set operations on one pair at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.operators import joins, shapes
from loamgrid.operators import vectors as V


def box(x0, y0, x1, y1):
    return [[[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]]


def layer(spark, rows):
    return spark.createDataFrame(rows, f"k long, shape {G.SHAPE}")


def some(rng, n, first=0):
    return [(first + i, box(x := rng.randint(0, 30), y := rng.randint(0, 30), x + rng.randint(1, 9), y + rng.randint(1, 5))) for i in range(n)]


TRIANGLE = [[[[3.0, 3.0], [25.0, 5.0], [9.0, 28.0], [3.0, 3.0]]]]


def no_python(*_):
    raise AssertionError("a pair of rectangles went to Python")


def floats(rows):
    return [(k, [[[[float(v) for v in p] for p in ring] for ring in part] for part in s]) for k, s in rows]


@pytest.mark.parametrize("mixed", [False, True])
def test_pairs_of_rectangles(spark, monkeypatch, mixed):
    rng = random.Random(3)
    a, b = floats(some(rng, 25)), floats(some(rng, 25, 100))
    if mixed:
        a, b = [*a, (99, TRIANGLE)], [*b, (999, TRIANGLE)]
    da, db = layer(spark, a), layer(spark, b)
    area = {(p, q): G.area_of(G.set_operation(s, t, G.OPERATIONS["intersection"])) for p, s in a for q, t in b}
    dist = {(p, q): shapes.distance(s, t, "polygon", "polygon") for p, s in a for q, t in b}
    within = {(p, q) for p, s in a for q, t in b if shapes.is_within(s, t, "polygon")}
    if not mixed:
        for where, name in ((V, "_shape"), (shapes, "_shape")):
            monkeypatch.setattr(where, name, no_python)
    got = {(r.a_k, r.b_k): r.area for r in V.overlay_pairs(da, db, 8.0).collect()}
    assert set(got) == {k for k, v in area.items() if v > 0} and all(got[k] == pytest.approx(area[k]) for k in got)
    pairs = lambda **o: {(r.a_k, r.b_k) for r in shapes.shape_pairs(da, db, "k", "k", size=8.0, **o).collect()}
    assert pairs() == {k for k, v in dist.items() if v <= 1e-9}
    assert pairs(relation="distance", reach=3.0) == {k for k, v in dist.items() if v <= 3}
    assert pairs(relation="within") == within
    best = {}
    for (p, q), v in sorted(area.items()):
        if v > 0 and v > best.get(p, (0, 0.0))[1] + 1e-9:
            best[p] = (q, v)
    assert {r.a_k: r.b_k for r in shapes.largest_overlap(da, db, "k", "k", 8.0).collect()} == {p: q for p, (q, _) in best.items()}


def test_largest_overlap_keeps_touching_and_ties(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 2.0, 0.0, 4.0, 2.0), (3, 1.0, 0.0, 3.0, 2.0), (4, 9.0, 9.0, 10.0, 10.0), (5, 1.0, 0.0, 3.0, 2.0)], "k long, x0 double, y0 double, x1 double, y1 double")
    a, b = (joins.boxes_of(df, s, "x0", "y0", "x1", "y1") for s in "ab")
    got = {r.a_k: (r.b_k, r.overlap) for r in joins.largest_overlap(a, b, "k", "k", 8.0, others=True).collect()}
    assert got == {1: (3, 2.0), 2: (3, 2.0), 3: (5, 4.0), 5: (3, 4.0)}
    assert "SortAggregate" not in joins.largest_overlap(a, b, "k", "k", 8.0)._jdf.queryExecution().executedPlan().toString()


def test_cells_fit_many_boxes(spark, monkeypatch):
    monkeypatch.setattr(V, "MANY_PAIRS", 10)
    rng = random.Random(5)
    rows = [(i, float(x := rng.uniform(0, 60)), float(y := rng.uniform(0, 60)), x + rng.choice([0.5, 3.0, 40.0]), y + rng.choice([0.1, 1.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double")
    a, b = (joins.boxes_of(df, s, "x0", "y0", "x1", "y1") for s in "ab")
    sizes = V._cell_sizes(a, b, 64.0)
    assert sizes[1] < sizes[0] < 64
    got = [(r.a_k, r.b_k) for r in V.box_pairs(a, b, 64.0).collect()]
    assert len(got) == len(set(got)) and set(got) == {(p[0], q[0]) for p in rows for q in rows if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}


@pytest.mark.parametrize("mixed", [False, True])
def test_rectangles_without_others(spark, monkeypatch, mixed):
    rng = random.Random(7)
    a, b = floats(some(rng, 20)), floats(some(rng, 40, 100))
    if mixed:
        b = [*b, (999, TRIANGLE)]
    want = {k: G.area_of(G.set_operation(s, [p for _, t in b for p in t], G.OPERATIONS["difference"])) for k, s in a}
    out = {r.k: r.shape for r in V.difference(layer(spark, a), layer(spark, b), "k", 8.0).collect()}
    assert set(out) == {k for k, v in want.items() if v > 1e-9} and all(G.area_of(V._shape(s)) == pytest.approx(want[k]) for k, s in out.items())


@pytest.mark.parametrize("cells", [4_000_000, 40])
def test_union_of_rectangles(spark, monkeypatch, cells):
    monkeypatch.setattr(G, "GRID_CELLS", cells)
    rng = random.Random(11)
    rows = floats(some(rng, 60))
    want = G.area_of(G.set_operation([p for _, s in rows for p in s], [], lambda p, q: p))
    boxes = np.array([[*s[0][0][0], *s[0][0][2]] for _, s in rows])
    assert G.area_of(G.box_union(boxes)) == pytest.approx(want) and G.area_of(G.box_union(G.fewer_boxes(boxes))) == pytest.approx(want)
    frame = np.array([[0, 0, 9, 1], [0, 8, 9, 9], [0, 0, 1, 9], [8, 0, 9, 9], [9, 9, 10, 10.0]])
    assert G.area_of(G.box_union(frame)) == 81 - 49 + 1 and sorted(map(len, G.box_union(frame))) in ([1, 2], [2])
    d = V.dissolve(layer(spark, rows), None, key="k").collect()
    assert len(d) == 1 and d[0].features == 60 and G.area_of(V._shape(d[0].shape)) == pytest.approx(want)


def test_grown_rectangles(spark, monkeypatch):
    rows = [(1, box(0.0, 0.0, 3.0, 2.0)), (2, [[[[5.0, 5.0], [5.0, 7.0], [6.0, 7.0], [6.0, 5.0], [5.0, 5.0]]]])]
    want = {k: G.buffer_shape("polygon", s, 2.0) for k, s in rows}
    got = {r.k: V._shape(r.shape) for r in V.buffer(layer(spark, rows), 2.0).collect()}
    assert all(np.allclose(got[k][0][0], want[k][0][0]) for k in want)
    mixed = V.buffer(layer(spark, [*rows, (3, TRIANGLE)]), 2.0).select("k", F.round(G.shape_area(F.col("shape")), 6).alias("area"))
    assert {r.k: r.area for r in mixed.collect()} == {k: pytest.approx(G.area_of(G.buffer_shape("polygon", s, 2.0)), abs=1e-5) for k, s in [*rows, (3, TRIANGLE)]}


def test_points_in_long_and_short_rings(spark):
    rng = np.random.default_rng(8)
    star = [[[[5 + r * np.cos(t), 5 + r * np.sin(t)] for t, r in zip(np.linspace(0, 2 * np.pi, 41), [*([4.0, 2.0] * 20), 4.0], strict=True)]]]
    rows = [(1, TRIANGLE), (2, [[[[float(v) for v in p] for p in star[0][0]]]]), (3, [box(0.0, 0.0, 9.0, 9.0)[0] + box(2.0, 2.0, 5.0, 5.0)[0]])]
    pts = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 20, (300, 2)))]
    got = {(r.a_i, r.b_k, r.a_w) for r in shapes.points_in_shapes(spark.createDataFrame(pts, "i long, x double, y double").withColumn("w", F.col("i") * 2), layer(spark, rows), "i", "k", "x", "y", keep=("w",)).collect()}
    want = {(i, k, 2 * i) for i, x, y in pts for k, s in rows if sum(G._within(ring, (x, y)) for part in s for ring in part) % 2}
    assert got == want
