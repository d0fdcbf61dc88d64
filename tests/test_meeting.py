import random

import numpy as np
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.operators import joins as J
from loamgrid.operators import meeting, series, shapes
from loamgrid.operators import raster as R
from loamgrid.operators.vectors import box_pairs


def test_full_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(meeting, "PART_ROWS", 4)
    rng = random.Random(1)
    a, b = [(i, rng.choice([0, 0, 0, 1, 2])) for i in range(60)], [(i, rng.choice([0, 1, 3])) for i in range(20)]
    got = meeting.meet(spark.createDataFrame(a, "i int, k int"), spark.createDataFrame(b, "j int, k int"), ["k"])
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, k in a for j, m in b if k == m)


def test_boxes_of_all_sizes(spark):
    rng = random.Random(2)
    rows = [(i, x := rng.uniform(-500, 500), y := rng.uniform(-500, 500), x + rng.choice([0.0, 1.0, 30.0, 700.0]), y + rng.choice([0.0, 2.0, 90.0])) for i in range(120)] + [(900, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double")
    a, b = (J.boxes_of(df, s, "x0", "y0", "x1", "y1") for s in "ab")
    got = [(r.a_k, r.b_k) for r in box_pairs(a, b, 8.0).collect()]
    want = {(p[0], q[0]) for p in rows[:-1] for q in rows[:-1] if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want
    assert box_pairs(a.limit(0), b, 8.0).count() == 0


def test_nearest_k(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.uniform(-400, 400, (20, 2))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "k long, x double, y double")
    got = {}
    for r in J.nearest_k(df, df, "x", "y", "k", "k", 3).collect():
        got.setdefault(r.a_key, []).append(r.dist)
    d = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), 1)[:, :3]
    assert all(np.allclose(sorted(got[i]), d[i]) for i in range(len(x)))
    assert J.nearest_k(df, df.limit(2), "x", "y", "k", "k", 3).count() == 2 * len(x)


def test_series_neighbours_on_the_globe(spark):
    rng = np.random.default_rng(4)
    lat, lon = np.concatenate([rng.uniform(-90, 90, 30), rng.normal(50, 0.01, 20)]), np.concatenate([rng.uniform(-180, 180, 30), rng.normal(179.99, 0.01, 20)])
    df = spark.createDataFrame([(f"s{i:02}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))] + [("none", None, 1.0)], "s string, lat double, lon double")
    p, q = np.radians(lat), np.radians(lon)
    xyz = np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], 1)
    km = 2 * 6371 * np.arcsin(np.minimum(1, np.linalg.norm(xyz[:, None] - xyz[None], axis=2) / 2))
    np.fill_diagonal(km, np.inf)
    got = {}
    for r in series.neighbours(df, "s", "lat", "lon", 4).collect():
        got.setdefault(r.key, []).append(r.km)
    assert set(got) == {f"s{i:02}" for i in range(50)}
    assert all(np.allclose(sorted(got[f"s{i:02}"]), np.sort(km[i])[:4], atol=1e-6) for i in range(50))


def test_exact_relations(spark):
    square = lambda x, y, w: [[[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]]
    hole = [[square(0.0, 0.0, 10.0)[0][0], square(3.0, 3.0, 4.0)[0][0]]]
    a = spark.createDataFrame([(1, square(4.0, 4.0, 1.0)), (2, square(1.0, 1.0, 1.0)), (3, square(10.0, 0.0, 2.0)), (4, square(13.0, 0.0, 1.0)), (5, None)], f"k long, shape {G.SHAPE}")
    b = spark.createDataFrame([(7, hole)], f"k long, shape {G.SHAPE}")
    keys = lambda df: sorted(r.a_k for r in df.collect())
    assert keys(shapes.shape_pairs(a, b, "k", "k")) == [2, 3]
    assert keys(shapes.shape_pairs(a, b, "k", "k", "within")) == [2]
    assert keys(shapes.shape_pairs(a, b, "k", "k", "distance", 3.0)) == [1, 2, 3, 4]
    assert sorted(r.k for r in shapes.select_by_location(a, b, "k", "k", disjoint=True).collect()) == [1, 4, 5]
    line = spark.createDataFrame([(1, [[[[-5.0, 5.0], [20.0, 5.0]]]]), (2, [[[[4.0, 4.0], [6.0, 6.0]]]])], f"k long, shape {G.SHAPE}")
    assert keys(shapes.shape_pairs(line, b, "k", "k", kinds=("line", "polygon"))) == [1]
    point = spark.createDataFrame([(1, [[[[5.0, 5.0]]]]), (2, [[[[1.0, 5.0]]]])], f"k long, shape {G.SHAPE}")
    assert keys(shapes.shape_pairs(point, b, "k", "k", "within", kinds=("point", "polygon"))) == [2]


def test_outlines_of_regions(spark):
    # A ring around a hole, a pixel that touches it at a corner, and a neighbour of another class.
    rows = [(r, c, 1) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(3, 3, 1), (0, 3, 2)]
    df = spark.createDataFrame(rows, "row long, col long, c int")
    out = {r.pixels: r for r in shapes.region_outlines(R.connected_regions(df, "c"), "c").collect() if r.c == 1}
    assert set(out) == {8, 1} and len(out[8].shape[0]) == 2 and G.area_of(out[8].shape) == 8 and G.area_of(out[1].shape) == 1
    diagonal = shapes.region_outlines(R.connected_regions(df, "c", diagonal=True), "c").where("c = 1").collect()
    assert len(diagonal) == 1 and diagonal[0].pixels == 9


def test_contour_lines_are_whole(spark):
    rows = [(r, c, float(np.hypot(r - 5, c - 5))) for r in range(11) for c in range(11)]
    seg = R.contour_segments(spark.createDataFrame(rows, "row long, col long, z double"), "z", 1.5, 0.2)
    total = sum(np.hypot(r.x2 - r.x1, r.y2 - r.y1) for r in seg.where("level < 4").collect())
    lines = shapes.contour_lines(seg).where("level < 4").collect()
    assert all(r.closed for r in lines) and len(lines) == len({r.level for r in lines}) > 1
    assert abs(sum(r.length for r in lines) - total) < 1e-9


def test_centre_lines_like_the_whole_raster(spark):
    rng = np.random.default_rng(6)
    a = np.zeros((60, 70))
    a[5:40, 10:50] = 1
    a[20:58, 30:66] = 1
    a[rng.integers(0, 60, 60), rng.integers(0, 70, 60)] = 0
    rows = [(int(r), int(c), 1.0) for r, c in np.argwhere(a > 0)]
    got = {(r.row, r.col) for r in R.centre_lines(spark.createDataFrame(rows, "row long, col long, m double"), "m", tile=16, rounds=3).collect()}
    assert got == {(int(r), int(c)) for r, c in np.argwhere(R.thin(a) > 0)}
