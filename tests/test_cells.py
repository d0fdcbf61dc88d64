"""Layers that meet in grid cells in numpy, without a row for each pair, against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.operators import cells, detection, joins, shapes
from loamgrid.operators import vectors as V
from loamgrid.plans import shape_queries, spatial_queries
from tests.test_boxes import box, floats, layer, some

BOX = "k long, x0 double, y0 double, x1 double, y1 double"


def no_pairs(*_, **__):
    raise AssertionError("a row for each pair")


@pytest.fixture(params=[(10_000, 128), (7, 5)])
def small(request, monkeypatch):
    """Few rows a part and a block, and no join that makes pairs."""
    monkeypatch.setattr(cells, "PART_ROWS", request.param[0])
    monkeypatch.setattr(cells, "BLOCK", request.param[1])
    monkeypatch.setattr(V, "MANY_PAIRS", request.param[0])
    for module in (V, shapes, joins, detection):
        monkeypatch.setattr(module, "box_pairs", no_pairs)


def rows_of(n, seed, levels=(0.5, 3.0, 40.0)):
    rng = random.Random(seed)
    return [(i, float(x := rng.randint(-30, 60)), float(y := rng.randint(-30, 60)), x + rng.choice(levels), y + rng.choice((1.0, 2.0))) for i in range(n)]


def common(p, q):
    return max(0.0, min(p[3], q[3]) - max(p[1], q[1])) * max(0.0, min(p[4], q[4]) - max(p[2], q[2]))


def meet(p, q):
    return p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]


def as_shapes(spark, rows):
    return layer(spark, [(r[0], box(*r[1:])) for r in rows])


def test_largest_overlap(spark, small):
    rows = rows_of(120, 1)
    a, b = (joins.boxes_of(spark.createDataFrame(rows, BOX), s, "x0", "y0", "x1", "y1") for s in "ab")
    got = {r.a_k: (r.b_k, r.overlap) for r in joins.largest_overlap(a, b, "k", "k", 8.0, others=True).collect()}
    want = {p[0]: max(((q[0], common(p, q)) for q in rows if q != p and meet(p, q)), key=lambda m: (m[1], -m[0]), default=None) for p in rows}
    assert got == {k: v for k, v in want.items() if v}


def test_shapes_largest_overlap(spark, small):
    a, b = rows_of(90, 2), rows_of(80, 3)
    got = {r.a_k: (r.b_k, r.overlap) for r in shapes.largest_overlap(as_shapes(spark, a), as_shapes(spark, b), "k", "k", 8.0).collect()}
    want = {p[0]: max(((q[0], common(p, q)) for q in b if common(p, q) > 0), key=lambda m: (m[1], -m[0]), default=None) for p in a}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("disjoint", [False, True])
def test_shapes_intersecting_and_disjoint(spark, small, disjoint):
    a, b = rows_of(90, 4), rows_of(12, 5)
    got = sorted(r.k for r in shapes.select_by_location(as_shapes(spark, a), as_shapes(spark, b), "k", "k", disjoint=disjoint, size=8.0).collect())
    assert got == [p[0] for p in a if any(meet(p, q) for q in b) != disjoint]


def test_shapes_in_reach(spark, small):
    a, b = rows_of(90, 6), rows_of(12, 7)
    far = lambda p, q: (max(0, q[1] - p[3], p[1] - q[3]) ** 2 + max(0, q[2] - p[4], p[2] - q[4]) ** 2) ** 0.5
    got = sorted(r.k for r in shapes.select_by_location(as_shapes(spark, a), as_shapes(spark, b), "k", "k", "distance", 3.0, size=8.0).collect())
    assert got == [p[0] for p in a if any(far(p, q) <= 3 for q in b)]


def test_shapes_within(spark, small):
    a, b = rows_of(120, 8, (0.5, 3.0)), rows_of(120, 9)
    got = sorted((r.a_k, r.b_k) for r in shapes.shape_pairs(as_shapes(spark, a), as_shapes(spark, b), "k", "k", "within", size=8.0).collect())
    want = [(p[0], q[0]) for p in a for q in b if p[1] >= q[1] and p[2] >= q[2] and p[3] <= q[3] and p[4] <= q[4]]
    assert got == want and want


def test_shared_area(spark, small):
    a, b = rows_of(90, 10), rows_of(80, 11)
    got = shapes.shared_area(as_shapes(spark, a), as_shapes(spark, b), "k", 8.0).first().area
    assert got == pytest.approx(sum(common(p, q) for p in a for q in b))


def test_points_in_polygons_are_counted(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(cells, "PART_ROWS", 7)
    diamond = lambda x, y, r: [[[[x, y - r], [x + r, y], [x, y + r], [x - r, y], [x, y - r]]]]
    rows = floats([(i, diamond(rng.uniform(0, 40), rng.uniform(0, 40), rng.choice([1.0, 4.0, 20.0]))) for i in range(30)])
    disc = G.circle(10.0, 10.0, 6.0, 20)[0]
    rows += [(98, [[[[float(v) for v in p] for p in [*disc, disc[0]]]]]), (99, box(90.0, 90.0, 91.0, 91.0)), (100, None)]
    pts = [(rng.uniform(0, 40), rng.uniform(0, 40), rng.choice([None, 2.0, 3.5])) for _ in range(200)]
    inside = lambda s, x, y: s is not None and sum(G._within(ring, (x, y)) for part in s for ring in part) % 2
    got = {r.k: (r.points, r.sum_v) for r in shapes.count_points(spark.createDataFrame(pts, "x double, y double, v double"), layer(spark, rows), "k", "x", "y", "v", 8.0).collect()}
    assert got == {k: (sum(1 for x, y, _ in pts if inside(s, x, y)), pytest.approx(sum(v or 0.0 for x, y, v in pts if inside(s, x, y)))) for k, s in rows}
    for module in (V, shapes):
        monkeypatch.setattr(module, "box_pairs", no_pairs)
    assert shape_queries.points_in_polygons(spark, "/root/testdata/sf0.001").count()


def test_merged_pieces(spark, small):
    rng = random.Random(13)
    rows = [(*r, rng.choice(["a", "b", None]), r[0] % 3 if r[0] % 10 else None, float(r[0])) for r in rows_of(200, 14, (3.0, 4.0, 9.0))]
    root = {r[0]: r[0] for r in rows}
    pairs = [(p, q) for p in rows for q in rows if p[5] == q[5] and None not in (p[6], q[6]) and p[6] != q[6] and common(p, q) >= 0.5 * min((p[3] - p[1]) * (p[4] - p[2]), (q[3] - q[1]) * (q[4] - q[2]))]
    while any(root[p[0]] != root[q[0]] for p, q in pairs):
        for p, q in pairs:
            root[p[0]] = root[q[0]] = min(root[p[0]], root[q[0]])
    df = spark.createDataFrame(rows, f"{BOX}, cls string, tile int, score double")
    got = {r.k: (r.cls, r.x0, r.y1, r.score, r.pieces) for r in detection.merge_cut(df, "k", "cls", "score", "tile", 8.0).collect()}
    each = {k: [r for r in rows if root[r[0]] == k] for k in set(root.values())}
    assert got == {k: (m[0][5], min(r[1] for r in m), max(r[4] for r in m), max(r[7] for r in m), len(m)) for k, m in each.items()} and len(got) < len(rows)


def test_a_mask_of_one_row_is_broadcast(spark):
    a, mask = as_shapes(spark, rows_of(60, 15)), layer(spark, [(1, box(0.0, 0.0, 30.0, 30.0))])
    plan = V.overlay_pairs(a, mask, 8.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "SortMergeJoin" not in plan
    got = {r.k: r.a for r in V.overlay(a, mask, "clip", "k", 8.0).select("k", G.shape_area(F.col("shape")).alias("a")).collect()}
    want = {p[0]: common(p, (1, 0.0, 0.0, 30.0, 30.0)) for p in rows_of(60, 15)}
    assert got == {k: v for k, v in want.items() if v > 0}


@pytest.mark.parametrize("mask_rows", [1, 2 * V.FEW_ROWS])
def test_a_clipped_layer_is_not_broadcast(spark, mask_rows):
    """Its size on disk, by which Spark chooses, is a small part of its size in memory."""
    boxes = spatial_queries._boxes(spark, "/root/testdata/sf0.01").select("k", "x0", "y0", "x1", "y1")
    side = 400.0 / mask_rows
    mask = layer(spark, [(i, box(200 + i * side, 150.0, 200 + (i + 1) * side, 700.0)) for i in range(mask_rows)])
    out = V.overlay(spatial_queries._shapes(boxes), mask, "clip", "k", 64.0).select("k", G.shape_area(F.col("shape")).alias("a"))
    got = {}
    for r in out.collect():
        got[r.k] = got.get(r.k, 0.0) + r.a
    want = {p.k: common(p, (0, 200.0, 150.0, 600.0, 700.0)) for p in boxes.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v > 0} and len(got) > mask_rows
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = [float(n) for n in re.findall(r"BroadcastQueryStage.*rowCount=([\d.E+]+)", plan)]
    assert sent and max(sent) <= mask_rows * 8, sent


def test_overlay_areas_makes_no_pairs(spark, monkeypatch):
    for module in (V, shapes):
        monkeypatch.setattr(module, "box_pairs", no_pairs)
    assert spatial_queries.overlay_areas(spark, "/root/testdata/sf0.01").first().common > 0


def test_buffers_are_made_in_batches(spark):
    rows = rows_of(50, 16)
    out = V.buffer(as_shapes(spark, rows), 2.0, area="area")
    assert "mapinarrow" in out._jdf.queryExecution().executedPlan().toString().lower()
    want = {r[0]: G.buffer_shape("polygon", box(*r[1:]), 2.0) for r in rows}
    got = out.withColumn("again", G.shape_area(F.col("shape"))).collect()
    assert len(got) == 50 and all(r.area == pytest.approx(G.area_of(want[r.k])) and r.again == pytest.approx(r.area) for r in got)


def test_dissolve_hands_on_few_rectangles(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE_BOXES", 30)
    rows = [(i, box(x := float(i % 40), y := float(i // 40), x + 3, y + 3), None if i % 2 else "a") for i in range(1600)] + [(9999, None, "b")]
    df = spark.createDataFrame(floats_of(rows), f"k long, shape {G.SHAPE}, cls string")
    out = V.dissolve(df, "cls", key="k")
    got = {r.value: (r.features, G.area_of(V._shape(r.shape))) for r in out.collect()}
    cells_of = lambda odd: {(x + u, y + v) for i in range(odd, 1600, 2) for x, y in [(i % 40, i // 40)] for u in range(3) for v in range(3)}
    assert got == {None: (800, len(cells_of(1))), "a": (800, len(cells_of(0))), "b": (1, 0)}
    assert "flatmapgroupsinpandas" in (plan := out._jdf.queryExecution().executedPlan().toString().lower()) and "salt" not in plan


def test_union_gathers_only_what_is_left(spark, small, monkeypatch):
    monkeypatch.setattr(V, "split_pairs", no_pairs)
    a, b = rows_of(60, 17, (0.5, 3.0, 9.0)), rows_of(150, 18, (3.0, 20.0))
    out = {r.k: G.area_of(V._shape(r.shape)) for r in V.difference(as_shapes(spark, a), as_shapes(spark, b), "k", 8.0).collect()}
    left = {p[0]: G.area_of(G.set_operation(box(*p[1:]), [part for q in b for part in box(*q[1:])], G.OPERATIONS["difference"])) for p in a}
    want = {k: pytest.approx(v) for k, v in left.items() if v > 1e-9}
    assert out == want and 0 < len(out) < len(a)


def floats_of(rows):
    return [(k, s and [[[[float(v) for v in p] for p in ring] for ring in part] for part in s], c) for k, s, c in rows]
