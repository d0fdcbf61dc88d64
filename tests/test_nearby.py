import math
import random

import numpy as np
import pandas as pd

from loamgrid.functions.curves import EARTH_M, morton_int
from loamgrid.operators import nearby

SCHEMA = "point_id long, lat double, lon double, code string, salt string"


def _distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(h)))


def _points():
    rng, pts = random.Random(1), []
    for lat, lon in [(0.001, 0.001), (51.5, -0.1), (89.9999, 30), (-89.9999, -170), (10, 180), (10, -180), (-59.7, 179.9996)]:
        pts += [(lat + rng.uniform(-1, 1) * 8e-4, ((lon + rng.uniform(-1, 1) * 8e-4 / max(0.02, math.cos(math.radians(lat)))) + 540) % 360 - 180) for _ in range(40)]
    pts += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(100)]
    pts += [pts[0]] * 30  # the same position
    return [(i + 1, min(90.0, max(-90.0, a)), b) for i, (a, b) in enumerate(pts)]


def _brute(pts, metres):
    return {(i, j) for i, a, b in pts for j, c, d in pts if i < j and _distance((a, b), (c, d)) <= metres}


def test_near_over_poles_and_antimeridian(spark):
    pts = _points()
    df = spark.createDataFrame([(*p, "x", "y") for p in pts] + [(900, None, 1.0, "", ""), (901, float("nan"), 1.0, "", ""), (902, 91.0, 1.0, "", ""), (903, 0.0, 0.0, "", ""), (904, 0.0, 0.0, "", ""), (None, 51.5, -0.1, "", "")], SCHEMA)
    for metres in (100.0, 1000.0):
        got = {(r.key_a, r.key_b) for r in nearby.points_near(df, "point_id", "lat", "lon", metres).collect()}
        assert got == _brute(pts, metres)


def test_small_blocks_and_positions_with_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK_ROWS", 7)
    monkeypatch.setattr(nearby, "PAIRS", 50)
    pts = _points()
    got = [(r.key_a, r.key_b) for r in nearby.points_near(spark.createDataFrame([(*p, "", "") for p in pts], SCHEMA), "point_id", "lat", "lon", 100.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _brute(pts, 100.0)


def test_empty_points(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nearby.points_near(df, "point_id", "lat", "lon", 100.0).count() == 0


REGIONS = [
    (1, '{"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [4, 6], [6, 6], [6, 4], [4, 4]]]}'),
    (2, '{"type": "MultiPolygon", "coordinates": [[[[5, 5], [20, 5], [5, 20], [5, 5]]], [[[-170, -80], [-160, -80], [-165, -70], [-170, -80]]]]}'),
    (3, None), (4, "no json"), (5, '{"type": "Point", "coordinates": [1, 2]}'), (6, ""),
]


def test_inside_with_holes_and_parts(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(-5, 25), rng.uniform(-5, 25)) for i in range(600)] + [(1000 + i, rng.uniform(-82, -68), rng.uniform(-172, -158)) for i in range(200)]
    regions = spark.createDataFrame(REGIONS, "region_id long, geojson string")
    df = spark.createDataFrame([(*p, "", "") for p in pts] + [(5000, None, None, "", ""), (None, 1.0, 1.0, "", "")], SCHEMA)
    got = {(r.key_a, r.key_b) for r in nearby.points_inside(df, "point_id", "lat", "lon", regions, "region_id", "geojson").collect()}
    want = set()
    for i, y, x in pts:
        if 0 < x < 10 and 0 < y < 10 and not (4 < x < 6 and 4 < y < 6):
            want.add((i, 1))
        if x > 5 and y > 5 and x + y < 25 or (-80 < y < -70 and abs(x + 165) < (-70 - y) / 2):
            want.add((i, 2))
    assert got == want
    assert nearby.points_inside(df, "point_id", "lat", "lon", regions.limit(0), "region_id", "geojson").count() == 0
    assert nearby.points_inside(df, "point_id", "lat", "lon", regions, "region_id", "geojson", broadcast_rows=0).count() == len(want)


def test_inside_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK_ROWS", 9)
    monkeypatch.setattr(nearby, "PAIRS", 40)
    rng = random.Random(3)
    pts = [(i, rng.uniform(-5, 25), rng.uniform(-5, 25)) for i in range(300)] + [(i, 2.0, 2.0) for i in range(300, 340)]
    regions = spark.createDataFrame(REGIONS, "region_id long, geojson string")
    df = spark.createDataFrame([(*p, "", "") for p in pts], SCHEMA)
    each = [sorted(map(tuple, nearby.points_inside(df, "point_id", "lat", "lon", regions, "region_id", "geojson", broadcast_rows=n).collect())) for n in (0, 500_000)]
    assert each[0] == each[1] and len(each[0]) > 60


def test_exact_test_agrees_with_the_even_odd_rule():
    rng = np.random.default_rng(5)
    for _ in range(20):
        # A star with a hole, its corners at random distances.
        turn = np.sort(rng.uniform(0, 2 * np.pi, 30))
        ring = lambda far: [[float(f * np.cos(t)), float(f * np.sin(t))] for f, t in zip(far, turn, strict=True)]
        edges = nearby.polygon_edges([ring(rng.uniform(4, 9, 30)), ring(np.full(30, 2.0))])
        cover = nearby.polygon_cover(edges, 24, 150)
        ranges = nearby._Ranges(pd.DataFrame([(1, *r[:6], r[6].ravel()) for r in cover], columns=["key_b", "lo", "hi", "whole", "x", "y", "inside", "edges"]))
        x, y = rng.uniform(-10, 10, 800), rng.uniform(-10, 10, 800)
        order = np.argsort(nearby.lonlat_code(y, x))
        x, y = x[order], y[order]
        got = nearby._contained(ranges, nearby.lonlat_code(y, x), y, x)
        assert {int(p) for p, _ in got} == {i for i in range(800) if nearby.even_odd(edges, x[i], y[i])}


def test_cover_holds_the_polygon():
    edges = nearby.polygon_edges([[[0, 0], [7, 1], [3, 9], [0, 0]]])
    cover = nearby.polygon_cover(edges, 16, 200)
    assert all(a[1] < b[0] for a, b in zip(cover, cover[1:], strict=False))
    rng = random.Random(4)
    for _ in range(500):
        x, y = rng.uniform(-1, 10), rng.uniform(-1, 10)
        code = morton_int((int((x + 180) / 360 * 2**16), int((y + 90) / 180 * 2**16)), 16)
        hit = [w for lo, hi, w, *_ in cover if lo <= code <= hi]
        inside = nearby.even_odd(edges, x, y)
        assert len(hit) == 1 if inside else not any(hit)
