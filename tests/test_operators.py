"""Known answers of table, raster, vector, series and statistics operators on small frames."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.functions.airquality import sub_index, with_aqi
from loamgrid.operators import detection as D
from loamgrid.operators import interpolation as I
from loamgrid.operators import joins as J
from loamgrid.operators import learning as L
from loamgrid.operators import raster as R
from loamgrid.operators import series as S
from loamgrid.operators import stats as A
from loamgrid.operators import tables as T
from loamgrid.operators import vectors as V


def _grid(spark, f, rows=10, cols=10):
    return spark.createDataFrame([(r, c, f(r, c)) for r in range(rows) for c in range(cols)], "row long, col long, z double")


def test_filters_and_search(spark):
    df = spark.createDataFrame([("Blr", "KSPCB", 12.9), ("Mys", "OTHER", 13.0), ("x", "KSPCB", None)], "name string, agency string, lat double")
    count = lambda q: T.filter_rows(df, q).count()
    assert (count('agency = "KSPCB"'), count('agency != "KSPCB"'), count("lat > 12.95"), count("kspcb"), count(""), count("lat != 13")) == (2, 1, 1, 2, 3, 1)
    with pytest.raises(ValueError):
        T.filter_rows(df, "lat > abc")
    assert T.delete_rows(df, "lat > 12.95").count() == 2
    assert [r.lat for r in T.sort_rows(df, "lat", True).collect()] == [13.0, 12.9, None]
    assert T.safe_names(["B 02", "b-02", "8A", "--"]) == ["B_02", "b_02_2", "b8A", "band"]
    assert T.position_columns(spark.createDataFrame([(12.0, 77.0), (13.0, 78.0)], "`Latitude (deg)` double, `Longitude (deg)` double")) == ("Longitude (deg)", "Latitude (deg)")
    assert T.position_columns(spark.createDataFrame([(5e5, 2e6), (6e5, 3e6)], "x double, y double")) is None


def test_profile_and_histogram(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (float("nan"),)], "v double")
    r = T.profile(df).first()
    assert (r.missing, r["min"], r["max"], r["mean"], r["median"]) == (2, 1.0, 3.0, 2.0, 2.0) and r["std"] == pytest.approx(math.sqrt(2 / 3))
    h = T.histogram(spark.createDataFrame([(5.0,)] * 3, "v double"), "v", 4).orderBy("bin").collect()
    assert (h[0].lo, h[-1].hi, [x.n for x in h]) == (4.5, 5.5, [0, 0, 3, 0])
    assert T.histogram(df.limit(0), "v").count() == 0


def test_attribute_join_first_match_and_collision(spark):
    left = spark.createDataFrame([("LEFT", 1), ("whole", 2), ("none", 3), (None, 4)], "zone string, y int")
    right = spark.createDataFrame([(" left", 10, 1), ("left", 11, 2), ("Whole", 20, 3), (None, 40, 4)], "z string, y int, o int")
    got = {r.zone: (r.t_y, r.matched) for r in J.attribute_join(left, right, "zone", "z", ["o"]).collect()}
    assert got == {"LEFT": (10, True), "whole": (20, True), "none": (None, False), None: (40, True)}
    keys = spark.createDataFrame([("7",), ("7.0",), (" 7",), ("x",)], "k string").select(J.join_key(F.col("k")).alias("k"))
    assert [r.k for r in keys.collect()] == ["7", "7", "7", "x"]


def test_terrain_of_a_plane(spark):
    t = R.terrain(_grid(spark, lambda r, c: 0.1 * c * 10 - 0.1 * r * 10), "z", 10.0).where("row between 2 and 7 and col between 2 and 7").collect()
    # Rising to the east and to the north: slope 8.05 degrees, facing south-west.
    assert all(r.slope == pytest.approx(8.05, abs=0.01) and r.aspect == pytest.approx(225) for r in t)
    flat = R.terrain(_grid(spark, lambda r, c: 5.0), "z", 10.0).first()
    assert (flat.slope, flat.aspect) == (0.0, -1.0) and flat.hillshade == pytest.approx(255 * math.sin(math.pi / 4))


def test_zones_changes_and_classes(spark):
    g = _grid(spark, lambda r, c: 1.0 if c < 5 else 3.0).withColumn("zone", F.lit(1))
    z = R.zonal(g, "zone", "z").first()
    assert (z["mean"], z["min"], z["max"], z["sum"], z["count"]) == (2.0, 1.0, 3.0, 200.0, 100)
    c = R.zonal_classes(g, "zone", "z").orderBy("class").collect()
    assert [(r["class"], r.percent, r.majority) for r in c] == [(1.0, 50.0, 1.0), (3.0, 50.0, 1.0)]
    m = R.change_matrix(g, g.withColumn("z", F.when(F.col("row") < 5, 2.0).otherwise(F.col("z"))), "z", 0.01).collect()
    assert {(r.from_class, r.to_class): (r.pixels, r.changed) for r in m} == {(1.0, 1.0): (25, False), (3.0, 3.0): (25, False), (1.0, 2.0): (25, True), (3.0, 2.0): (25, True)}
    rules = [(0, 2, 5), (2, 3, 6)]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double").select(R.reclassify(F.col("v"), rules)).collect()] == [5, 6, 6, 0, None]


def test_connected_regions_and_contours(spark):
    g = _grid(spark, lambda r, c: 1.0 if (r < 4 or c > 6) else 0.0)
    b = R.region_boxes(R.connected_regions(g, "z"), "z", 0.01).collect()
    assert sorted((r.z, r.pixels) for r in b) == [(0.0, 42), (1.0, 58)]
    diag = _grid(spark, lambda r, c: 1.0 if r == c else None).where("z is not null")
    assert R.connected_regions(diag, "z").select("region").distinct().count() == 10
    assert R.connected_regions(diag, "z", diagonal=True).select("region").distinct().count() == 1
    s = R.contour_segments(_grid(spark, lambda r, c: float(c)), "z", 1.0, 0.5).collect()
    assert len(s) == 9 * 9 and all(x.x1 == x.x2 == x.level for x in s)


def test_focal_and_filters(spark):
    g = _grid(spark, lambda r, c: float(r == 5 and c == 5))
    f = {(r.row, r.col): r.m for r in R.focal(g, "z", 3, "mean", name="m").collect()}
    assert f[5, 5] == pytest.approx(1 / 9) and f[4, 6] == pytest.approx(1 / 9) and f[0, 0] == 0 and len(f) == 100
    s = {(r.row, r.col): r.filtered for r in R.kernel_filter(g, "z", R.LAPLACE).collect()}
    assert s[5, 5] == -4 and s[5, 4] == 1 and s[4, 4] == 0
    thick = np.zeros((20, 30))
    thick[8:13, 3:27] = 1
    line = R.thin(thick)
    assert line.sum() < 30 and line[10, 10:20].sum() == 10
    up = {(r.row, r.col): r.z for r in R.refine(_grid(spark, lambda r, c: 2.0 * c), 2, ["z"], "bilinear").collect()}
    assert len(up) == 400 and up[6, 7] == pytest.approx(2 * 3.25)


def test_geometry(spark):
    square = [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]], [[0.5, 0.5], [0.5, 1.0], [1.0, 1.0], [1.0, 0.5], [0.5, 0.5]]]]
    df = spark.createDataFrame([(1, square)], f"id long, shape {G.SHAPE}")
    m = V.measures(df).first()
    assert (m.area_m2, m.perimeter_m) == (3.75, 10.0) and m.centroid.x == pytest.approx((4 * 1 - 0.25 * 0.75) / 3.75)
    inside = df.select(*(G.contains_point(F.col("shape"), F.lit(x), F.lit(y)) for x, y in ((0.2, 0.2), (0.7, 0.7), (3.0, 1.0)))).first()
    assert list(inside) == [True, False, False]
    a, b = [[[[0, 0], [2, 0], [2, 2], [0, 2]]]], [[[[1, 1], [3, 1], [3, 3], [1, 3]]]]
    areas = {k: G.area_of(G.set_operation(a, b, f)) for k, f in G.OPERATIONS.items()}
    assert areas == {"intersection": pytest.approx(1), "union": pytest.approx(7), "difference": pytest.approx(3), "symmetric": pytest.approx(6)}
    assert G.area_of(G.buffer_shape("point", [[[[5, 5]]]], 100)) == pytest.approx(math.pi * 1e4, rel=0.002)
    assert G.area_of(G.buffer_shape("polygon", a, -0.5)) == pytest.approx(1)
    assert G.area_of(G.buffer_shape("line", [[[[0, 0], [10, 0], [10, 10]]]], 1)) == pytest.approx(40 + math.pi - (1 - math.pi / 4), rel=0.003)
    assert G.area_of(G.repaired([[[[0, 0], [2, 2], [2, 0], [0, 2]]]])) == pytest.approx(2)
    rng = np.random.default_rng(1)
    for _ in range(20):
        p, q = ([[[*map(list, G.convex_hull(rng.uniform(0, 10, (8, 2)).tolist()))]]] for _ in range(2))
        area = {k: G.area_of(G.set_operation(p, q, f)) for k, f in G.OPERATIONS.items()}
        assert area["union"] == pytest.approx(G.area_of(p) + G.area_of(q) - area["intersection"]) and area["difference"] == pytest.approx(G.area_of(p) - area["intersection"])
    assert G.simplify_line([[0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0]], 0.1) == [[0, 0], [2, 0], [3, 5], [4, 0]]
    x, y = G.to_utm(np.array([3.0]), np.array([45.0]), np.array([32631]), np)
    # On the central meridian the northing is the meridian arc times the scale.
    assert x[0] == pytest.approx(500_000, abs=1e-6) and y[0] == pytest.approx(4_982_950.400, abs=0.01)


def test_spatial_joins(spark):
    rng = np.random.default_rng(2)
    a = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 100, (120, 2)))], "k long, x double, y double")
    b = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 100, (40, 2)))], "k long, x double, y double")
    A_, B_ = a.toPandas().to_numpy(), b.toPandas().to_numpy()
    d = np.hypot(A_[:, None, 1] - B_[None, :, 1], A_[:, None, 2] - B_[None, :, 2])
    near = {r.a_key: (r.b_key, r.join_dist_m) for r in J.nearest(a, b, "x", "y", "k", "k", 2.0).collect()}
    assert near == {i: (int(d[i].argmin()), round(float(d[i].min()), 2)) for i in range(120)}
    cut = {r.a_key: r.b_key for r in J.nearest(a, b, "x", "y", "k", "k", 2.0, limit=5.0).collect()}
    assert cut == {i: (int(d[i].argmin()) if d[i].min() <= 5 else None) for i in range(120)}
    got = {(r.a_key, r.b_key) for r in J.within_distance(a, b, "x", "y", "k", "k", 8.0).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 8), strict=True)}


def test_suppression_and_matching(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), float(x + w), float(y + h), int(c), float(s)) for i, (x, y, w, h, c, s) in enumerate(zip(*(rng.uniform(0, 60, 150) for _ in range(2)), *(rng.uniform(4, 15, 150) for _ in range(2)), rng.integers(0, 2, 150), rng.integers(0, 9, 150) / 10, strict=True))]
    df = spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double, cls int, score double")

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        c = max(0, w) * max(0, h)
        return c / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - c)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[0])):
        if all(k[5] != r[5] or iou(k, r) <= 0.2 for k in kept):
            kept.append(r)
    assert {r.k for r in D.suppress(df, "k", "cls", "score", 10.0, 0.2).collect()} == {r[0] for r in kept}
    truth = [(100 + i, r[1] + 0.5, r[2], r[3], r[4] + 0.5, r[5]) for i, r in enumerate(rows[:60])]
    pairs = sorted(((-p[6], -iou(p, t), p[0], t[0]) for p in rows for t in truth if p[5] == t[5] and iou(p, t) >= 0.3))
    used_p, used_t, want = set(), set(), set()
    for _, _, p, t in pairs:
        if p not in used_p and t not in used_t:
            used_p.add(p)
            used_t.add(t)
            want.add((p, t))
    got = D.match_truth(df, spark.createDataFrame(truth, "k long, x0 double, y0 double, x1 double, y1 double, cls int"), "k", "cls", "score", 10.0, 0.3)
    assert {(r.pred, r.truth) for r in got.collect()} == want


def test_air_quality(spark):
    one = lambda p, v: spark.range(1).select(sub_index(p, F.lit(v))).first()[0]
    assert (one("PM2.5", 45.0), one("PM10", 50.0), one("NO2", 20.0), one("O3", 1e9), one("CO", None if False else 0.0)) == (75.0, 50.0, 25.0, 500.0, 0.0)
    t0 = datetime(2026, 1, 1)
    df = spark.createDataFrame([("s", t0 + timedelta(hours=h), 45.0, 50.0, 20.0, 30.0) for h in range(48)], "name string, at timestamp_ntz, pm25 double, pm10 double, no2 double, o3 double")
    got = with_aqi(df, "name", "at", {"PM2.5": "pm25", "PM10": "pm10", "NO2": "no2", "O3": "o3"}).orderBy("at").collect()
    assert all(r.aqi is None for r in got[:23]) and all((r.aqi, r.main_pollutant) == (75, "PM2.5") for r in got[23:])
    assert all(r.aqi is None for r in with_aqi(df, "name", "at", {"PM2.5": "pm25", "PM10": "pm10"}).collect())


def test_series(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, None, None, 4.0, None, None, None, 8.0, None])], "s string, t int, v double")
    assert [r.v for r in S.interpolate_gaps(df, "s", "t", "v", 2).orderBy("t").collect()] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, 8.0, None]
    assert [r.v for r in S.forward_fill(df, "s", "t", "v").orderBy("t").collect()] == [1.0, 1.0, 1.0, 4.0, 4.0, 4.0, 4.0, 8.0, 8.0]
    line = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "s string, t int, v double")
    f = S.recursive_forecast(line, "s", "t", "v", 4, [2.0, -1.0]).orderBy("h").collect()
    assert [(r.h, r.forecast) for r in f] == [(1, 10.0), (2, 11.0), (3, 12.0), (4, 13.0)]
    assert S.guess_roles({"time_text": "string", "aqi": "double", "station": "string", "lat": "double", "lon": "double"}) == {"time": "time_text", "series": "station", "target": "aqi", "lat": "lat", "lon": "lon"}
    assert S.backtest_cutoffs(1000, 48, "h", 3) and all(333 <= c <= 952 for c in S.backtest_cutoffs(1000, 48, "h", 3))


def test_area_weighted_accuracy(spark):
    rows = [("crop", "crop")] * 16 + [("crop", "forest")] * 4 + [("forest", "forest")] * 20
    cm = A.confusion(spark.createDataFrame(rows, "m string, r string"), "m", "r")
    assert A.overall_accuracy(cm).first().accuracy == pytest.approx(0.9)
    e = {r["class"]: r for r in A.area_estimates(cm, spark.createDataFrame([("crop", 75.0), ("forest", 25.0)], "class string, area double")).collect()}
    assert e["forest"].area == pytest.approx(40) and e["crop"].area == pytest.approx(60) and e["crop"].overall == pytest.approx(0.85)
    assert A.natural_breaks([1, 2, 10, 11, 12, 50, 51], [2, 1, 1, 1, 1, 1, 1], 3) == [1.0, 2.0, 12.0, 51.0] and A.natural_breaks([], [], 3) == []


def test_interpolators():
    rng = np.random.default_rng(5)
    p = np.column_stack([rng.uniform(0, 100, (40, 2)), np.zeros(40)])
    p[:, 2] = 3 + 0.5 * p[:, 0] - 0.2 * p[:, 1]
    q = rng.uniform(30, 70, (15, 2))
    plane = 3 + 0.5 * q[:, 0] - 0.2 * q[:, 1]
    for m in ("trend", "tin", "spline"):
        assert np.allclose(I.METHODS[m](p, q), plane, atol=1e-6), m
    for m in ("idw", "nearest", "spline", "kriging", "tin"):
        assert np.allclose(I.METHODS[m](p, p[:, :2]), p[:, 2], atol=1e-3), m
    assert I.leave_one_out(p, "trend") == pytest.approx({"method": "trend", "rmse": 0, "mae": 0, "bias": 0, "checked": 1.0}, abs=1e-8)
    assert I.compare_methods(p, ("nearest", "trend"))[0]["method"] == "trend"


def test_models(spark):
    rng = np.random.default_rng(6)
    rows = [(i, c, *map(float, rng.normal([0, 4, 8][c], 1, 2))) for i, c in enumerate(rng.integers(0, 3, 300).tolist())]
    df = spark.createDataFrame(rows, "id long, c int, a double, b double")
    for pooled in (False, True):
        out = L.gaussian_classify(df, L.gaussian_class_stats(df, "c", ["a", "b"]), "c", ["a", "b"], pooled)
        assert out.where("predicted = c").count() > 285
    out, _ = L.cluster(df, ["a", "b"], "kmeans", 3)
    assert A.agreement(out, "c", "cluster").first().ari > 0.9
    near = L.neighbours_exact(df.where("id % 20 = 0").select("id", F.array("a", "b").alias("v")), df.select("id", F.array("a", "b").alias("v")), "id", "v", 3, batch=4)
    x = np.array([r[2:] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for r in near.collect():
        assert r.near != r.query and r.score == pytest.approx(s[r.query, r.near], abs=1e-5) and (np.delete(s[r.query], r.query) > r.score + 1e-5).sum() < 3
    assert near.count() == 15 * 3
    pairs = J.within_distance(df.withColumnRenamed("a", "x").withColumnRenamed("b", "y"), df.withColumnRenamed("a", "x").withColumnRenamed("b", "y"), "x", "y", "id", "id", 1.0).where("a_key < b_key").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    labels = {r.node: r.cluster for r in L.dbscan(pairs, df.select(F.col("id").alias("node")), 6).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2) <= 1.0
    core = d.sum(1) >= 6
    want = np.where(core, np.arange(300), 10**6)
    for _ in range(300):
        want = np.where(core, np.where(d & core[None], want[None], 10**6).min(1), 10**6)
    border = np.where(d & core[None], want[None], 10**6).min(1)
    assert labels == {i: int(border[i]) if border[i] < 10**6 else -1 for i in range(300)}


def test_overlay_and_dissolve(spark):
    box = lambda x: [[[[x, 0.0], [x + 2, 0.0], [x + 2, 2.0], [x, 2.0], [x, 0.0]]]]
    a, b = (spark.createDataFrame([(1, n, box(x))], f"fid long, name string, shape {G.SHAPE}") for n, x in (("A", 0.0), ("B", 1.0)))
    area = lambda df: sorted(round(r[0], 6) for r in df.select(G.shape_area(F.col("shape"))).collect())
    i = V.overlay(a, b, "intersection", "fid", 1.0)
    assert i.columns == ["fid", "name", "b_fid", "b_name", "shape"] and area(i) == [2.0]
    assert area(V.overlay(a, b, "difference", "fid", 1.0)) == [2.0] and area(V.overlay(a, b, "union", "fid", 1.0)) == [2.0, 2.0, 2.0] and area(V.overlay(a, b, "symmetric", "fid", 1.0)) == [2.0, 2.0]
    d = V.dissolve(a.unionByName(b), None).collect()
    assert len(d) == 1 and d[0].features == 2 and G.area_of(V._shape(d[0].shape)) == pytest.approx(6)
    assert V.overlay(a.limit(0), b, "union", "fid", 1.0).count() == 1
    r = V.random_points(a, "fid", 5).collect()
    assert len(r) == 5 and all(0 <= p.x <= 2 and 0 <= p.y <= 2 for p in r)
