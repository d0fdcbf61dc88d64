"""Queries on layers, rasters, surfaces, models, detections and streams, with SQL where plain SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.functions.spectral import scene_class_clear
from loamgrid.operators import detection as D
from loamgrid.operators import interpolation as I
from loamgrid.operators import joins as J
from loamgrid.operators import learning as L
from loamgrid.operators import raster as R
from loamgrid.operators import shapes as X
from loamgrid.operators import vectors as V
from loamgrid.sources.layers import parse_geojson
from loamgrid.storage import Staged, read
from loamgrid.streaming import pipelines as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- Layers made from the tables: points of customers and suppliers, boxes of parts, a grid of embeddings ------------

_C = "c as (select c_custkey as k, (c_custkey * 7919 % 10007) / 10.0 as x, (c_custkey * 104729 % 10009) / 10.0 as y, c_acctbal as v from customer)"
_S = "s as (select s_suppkey as k, (s_suppkey * 6151 % 10007) / 10.0 as x, (s_suppkey * 3571 % 10009) / 10.0 as y, s_acctbal as v from supplier)"
_B = "b as (select p_partkey as k, (p_partkey * 7919 % 997) / 1.0 as x0, (p_partkey * 104729 % 991) / 1.0 as y0, ((p_partkey * 7919 % 997) + p_size + 1)::double as x1, ((p_partkey * 104729 % 991) + p_partkey % 13 + 1)::double as y1, p_partkey % 3 as cls, p_retailprice as score from part)"
_G = "g as (select vec_id // 25 as \"row\", vec_id % 25 as col, round(embedding[1]::double, 6) as z, label as cls from embeddings)"


def _points(spark, d, table, key, a, b, v):
    return read(spark, d, table).select(F.col(key).alias("k"), ((F.col(key) * a % 10007) / 10).alias("x"), ((F.col(key) * b % 10009) / 10).alias("y"), F.col(v).alias("v"))


def _customers(spark, d):
    return _points(spark, d, "customer", "c_custkey", 7919, 104729, "c_acctbal")


def _suppliers(spark, d):
    return _points(spark, d, "supplier", "s_suppkey", 6151, 3571, "s_acctbal")


def _boxes(spark, d):
    k = F.col("p_partkey")
    x0, y0 = (k * 7919 % 997).cast("double"), (k * 104729 % 991).cast("double")
    return read(spark, d, "part").select(k.alias("k"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size") + 1).alias("x1"), (y0 + k % 13 + 1).alias("y1"), (k % 3).alias("cls"), F.col("p_retailprice").alias("score"))


def _grid(spark, d):
    return read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("row"), (F.col("vec_id") % 25).alias("col"), F.round(F.col("embedding")[0].cast("double"), 6).alias("z"), F.col("label").alias("cls"))


def _shapes(boxes):
    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))
    return boxes.withColumn("shape", F.array(F.array(ring))).drop("x0", "y0", "x1", "y1")


# --- Spatial joins ---------------------------------------------------------------------------------------------------


@query(f"with {_C}, {_S} select c.k as a_key, s.k as b_key, round(sqrt(power(c.x - s.x, 2) + power(c.y - s.y, 2)), 4) as dist from c join s on abs(c.x - s.x) <= 25 and abs(c.y - s.y) <= 25 where sqrt(power(c.x - s.x, 2) + power(c.y - s.y, 2)) <= 25")
def within_distance(spark, d):
    return J.within_distance(_customers(spark, d), _suppliers(spark, d), "x", "y", "k", "k", 25.0).withColumn("dist", F.round("dist", 4))


@query(f"with {_C}, {_S}, f as (select c.k as a_key, s.k as b_key, sqrt(power(c.x - s.x, 2) + power(c.y - s.y, 2)) as d from c, s) select a_key, b_key, round(d, 2) as join_dist_m from f qualify row_number() over (partition by a_key order by d, b_key) = 1")
def nearest_join(spark, d):
    return J.nearest(_customers(spark, d), _suppliers(spark, d), "x", "y", "k", "k")


def _in_boxes(spark, d):
    boxes = _boxes(spark, d).select("k", *((F.col(c) / 10).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return _customers(spark, d), boxes, J.points_in_boxes(_customers(spark, d), J.boxes_of(boxes, "b", "x0", "y0", "x1", "y1"), "x", "y", 10.0)


_IN = f"{_C}, {_B}, pairs as (select c.k as ck, c.v, b.k as bk from c join b on c.x between b.x0 / 10 and b.x1 / 10 and c.y between b.y0 / 10 and b.y1 / 10)"


@query(f"with {_IN} select b.k, count(ck) as points, round(coalesce(sum(v), 0), 4) as sum_v from b left join pairs on b.k = bk group by b.k")
def count_points(spark, d):
    _, boxes, pairs = _in_boxes(spark, d)
    return J.count_points(boxes, pairs, "k", "v").select("k", "points", F.round("sum_v", 4).alias("sum_v"))


@query(f"with {_IN} select k from c where k in (select ck from pairs)")
def select_loc_semi(spark, d):
    c, _, pairs = _in_boxes(spark, d)
    return J.select_by_location(c, pairs, "k").select("k")


@query(f"with {_IN} select k from c where k not in (select ck from pairs)")
def select_loc_anti(spark, d):
    c, _, pairs = _in_boxes(spark, d)
    return J.select_by_location(c, pairs, "k", disjoint=True).select("k")


#: Unit cells of the boxes, whose corners are whole numbers: areas of any combination by counting.
_CELLS = "cells as (select k, cls, x, unnest(range(y0::int, y1::int)) as y from (select k, cls, y0, y1, unnest(range(x0::int, x1::int)) as x from b)), ca as (select * from cells where k % 2 = 0), cb as (select * from cells where k % 2 = 1)"
_PAIRS = "p as (select a.k as ak, b.k as bk, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as o, (a.x1 - a.x0) * (a.y1 - a.y0) as sa, (b.x1 - b.x0) * (b.y1 - b.y0) as sb, a.cls as ac, b.cls as bc from b a join b on a.k < b.k and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1)"


@query(f"with {_B}, {_PAIRS}, q as (select ak, bk, o from p union all select bk, ak, o from p) select ak as a_k, bk as b_k, round(o, 4) as overlap from q qualify row_number() over (partition by ak order by o desc, bk) = 1")
def largest_overlap(spark, d):
    b = _boxes(spark, d)
    boxed = lambda s: J.boxes_of(b, s, "x0", "y0", "x1", "y1")
    best = J.largest_overlap(boxed("a"), boxed("b"), "k", "k", 64.0, others=True)
    return best.select("a_k", "b_k", F.round("overlap", 4).alias("overlap"))


@query(f"with {_B}, {_PAIRS} select ak as a_k, bk as b_k, round(o / (sa + sb - o), 6) as iou from p where ac = bc and o > 0")
def iou_pairs(spark, d):
    return D.iou_pairs(_boxes(spark, d), "k", "cls", 64.0).select("a_k", "b_k", F.round("iou", 6).alias("iou"))


@query(f"""with recursive {_B}, {_PAIRS}, over as (select ak, bk from p where ac = bc and o / (sa + sb - o) > 0.1), both_ways as (select ak as k, bk as other from over union all select bk, ak from over),
nb as (select b.k, b.cls, row_number() over (partition by b.cls order by b.score desc, b.k) as i, coalesce(list(other) filter (other is not null), []) as others from b left join both_ways on both_ways.k = b.k group by b.k, b.cls, b.score),
walk(cls, i, kept) as (select distinct cls, 0::bigint, []::bigint[] from nb union all select w.cls, w.i + 1, case when len(list_intersect(w.kept, n.others)) = 0 then list_append(w.kept, n.k) else w.kept end from walk w join nb n on n.cls = w.cls and n.i = w.i + 1)
select unnest(kept) as k, cls from walk qualify row_number() over (partition by cls order by i desc) = 1""")
def nms_greedy(spark, d):
    return D.suppress(_boxes(spark, d), "k", "cls", "score", 64.0, 0.1).select("k", "cls")


@query(f"""with recursive {_B}, t as (select k, cls, x0 + 0.5 as x0, y0, x1, y1 from b where k % 2 = 0), q as (select b.k as p, t.k as t, b.cls, b.score, greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) as o, (b.x1 - b.x0) * (b.y1 - b.y0) as sp, (t.x1 - t.x0) * (t.y1 - t.y0) as st from b join t on b.cls = t.cls and b.x0 <= t.x1 and t.x0 <= b.x1 and b.y0 <= t.y1 and t.y0 <= b.y1),
pr as (select p, t, cls, o / (sp + st - o) as iou, row_number() over (partition by cls order by score desc, o / (sp + st - o) desc, p, t) as i from q where o / (sp + st - o) >= 0.5),
walk(cls, i, ps, ts) as (select distinct cls, 0::bigint, []::bigint[], []::bigint[] from pr union all select w.cls, w.i + 1, case when list_contains(w.ps, n.p) or list_contains(w.ts, n.t) then w.ps else list_append(w.ps, n.p) end, case when list_contains(w.ps, n.p) or list_contains(w.ts, n.t) then w.ts else list_append(w.ts, n.t) end from walk w join pr n on n.cls = w.cls and n.i = w.i + 1),
hit as (select unnest(ps) as p, unnest(ts) as t from walk qualify row_number() over (partition by cls order by i desc) = 1)
select p as pred, t as truth, round(iou, 6) as iou from hit join pr using (p, t)""")
def match_detections(spark, d):
    b = _boxes(spark, d)
    return D.match_truth(b, b.where("k % 2 = 0").withColumn("x0", F.col("x0") + 0.5), "k", "cls", "score", 64.0, 0.5).withColumn("iou", F.round("iou", 6))


@query(f"with {_B} select k, floor(x0 / 512)::bigint * 1000000 + floor(y0 / 512)::bigint as tile from b where k % 5 <> 0 and not exists (select 1 from b h where h.k % 5 = 0 and h.x0 <= b.x1 and b.x0 <= h.x1 and h.y0 <= b.y1 and b.y0 <= h.y1)")
def split_purge(spark, d):
    b = _boxes(spark, d)
    a, h = (J.boxes_of(b.where(c), s, "x0", "y0", "x1", "y1") for c, s in (("k % 5 <> 0", "a"), ("k % 5 = 0", "b")))
    out = J.overlap_purge(a, h, "k", 64.0)
    return out.select(F.col("a_k").alias("k"), (F.floor(F.col("a_x0") / 512) * 1_000_000 + F.floor(F.col("a_y0") / 512)).alias("tile"))


@query(f"with {_B}, {_PAIRS} select count(*) as pieces, round(sum(o), 3) as area from p where o > 0")
def overlay_intersection(spark, d):
    s = _shapes(_boxes(spark, d).select("k", "x0", "y0", "x1", "y1"))
    return V.overlay_pairs(s, s, 64.0).where("a_k < b_k").agg(F.count("*").alias("pieces"), F.round(F.sum("area"), 3).alias("area"))


@query(f"with {_B}, {_PAIRS} select round(sum((x1 - x0) * (y1 - y0)), 3) as a, round((select sum(o) from p where (ak % 2) <> (bk % 2)), 3) as common from b where k % 2 = 0")
def overlay_areas(spark, d):
    s = _shapes(_boxes(spark, d).select("k", "x0", "y0", "x1", "y1"))
    a, b = s.where("k % 2 = 0"), s.where("k % 2 = 1")
    area = a.agg(F.round(F.sum(G.shape_area(F.col("shape"))), 3).alias("a"))
    common = X.shared_area(a, b, "k", 64.0).select(F.round("area", 3).alias("common"))
    return area.join(F.broadcast(common))


@query(f"""with {_B}, {_CELLS}, one as (select k, null::bigint as b_k, count(*)::double as area from ca where (x, y) not in (select (x, y) from cb) group by k),
two as (select null::bigint as k, k as b_k, count(*)::double as area from cb where (x, y) not in (select (x, y) from ca) group by 2),
both_ as (select ca.k, cb.k as b_k, count(*)::double as area from ca join cb using (x, y) group by all) select * from one union all select * from two union all select * from both_""")
def overlay_union(spark, d):
    s = _shapes(_boxes(spark, d).select("k", "x0", "y0", "x1", "y1"))
    u = V.overlay(s.where("k % 2 = 0"), s.where("k % 2 = 1"), "union", "k", 64.0, area="area")
    return u.select("k", "b_k", F.round("area", 3).alias("area"))


@query(f"with {_B}, {_CELLS}, u as (select cls, count(*)::double as area from (select distinct cls, x, y from cells) group by 1) select cls::varchar as value, count(*) as features, any_value(area) as area from b join u using (cls) group by 1")
def dissolve_boxes(spark, d):
    s = _shapes(_boxes(spark, d).select("k", "cls", "x0", "y0", "x1", "y1"))
    return V.dissolve(s, "cls", key="k").select("value", "features", F.round(G.shape_area(F.col("shape")), 3).alias("area"))


@query(f"with {_B} select cls::varchar as value, count(*) as features, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from b group by 1")
def dissolve_bbox(spark, d):
    return _boxes(spark, d).groupBy(F.col("cls").cast("string").alias("value")).agg(F.count("*").alias("features"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(f"with {_B} select k, round_even((x1 - x0) * (y1 - y0), 2) as area_m2, round_even((x1 - x0) * (y1 - y0) / 10000, 4) as area_ha, round_even(2 * (x1 - x0 + y1 - y0), 2) as perimeter_m, round((x0 + x1) / 2, 6) as cx, round((y0 + y1) / 2, 6) as cy from b")
def geometry_measures(spark, d):
    m = V.measures(_shapes(_boxes(spark, d)))
    return m.select("k", "area_m2", "area_ha", "perimeter_m", F.round("centroid.x", 6).alias("cx"), F.round("centroid.y", 6).alias("cy"))


@query(f"with {_B} select k, vertex, x, y from (select k, unnest([1, 2, 3, 4])::int as vertex, unnest([x0, x1, x1, x0]) as x, unnest([y0, y0, y1, y1]) as y from b)")
def vertices_to_points(spark, d):
    return V.vertices(_shapes(_boxes(spark, d)), "k").select("k", "vertex", "x", "y")


@query(f"with {_B} select k, unnest([1, 2, 3, 4])::int as segment, unnest([x1 - x0, y1 - y0, x1 - x0, y1 - y0]) as length_m from b")
def split_lines(spark, d):
    return V.split_lines(_shapes(_boxes(spark, d)), "k").select("k", "segment", "length_m")


@query(f"with {_B}, l as (select k, x0, y0, x1 - x0 as n from b), m as (select k, unnest(range(0, ceil(n / 5)::bigint)) * 5.0 as distance_m, n, x0, y0 from l union all select k, n, n, x0, y0 from l) select k, distance_m, round(x0 + distance_m, 6) as x, y0 as y from m")
def points_along(spark, d):
    b = _boxes(spark, d)
    lines = b.select("k", F.array(F.array(F.array(F.array("x0", "y0"), F.array("x1", "y0")))).alias("shape"))
    return V.points_along(lines, "k", 5.0).select("k", "distance_m", F.round("x", 6).alias("x"), "y")


@query(f"with {_C} select (k % 50) as g, count(*) as points from c group by 1 having count(*) > 1")
def points_to_lines(spark, d):
    return V.points_to_lines(_customers(spark, d).withColumn("g", F.col("k") % 50), "g", "v", "x", "y", "k").select("g", F.col("points").cast("long").alias("points"))


@query(f"with {_B} select k, round((x1 - x0) * (y1 - y0) + 2 * 2 * (x1 - x0 + y1 - y0) + 32 * sin(2 * pi() / 64) * 4, 3) as area, 2.0::double as buffer_m from b")
def buffers(spark, d):
    s = _shapes(_boxes(spark, d).select("k", "x0", "y0", "x1", "y1"))
    return V.buffer(s, 2.0, area="area").select("k", F.round("area", 3).alias("area"), "buffer_m")


@query(f"""with {_C}, p as (select distinct x, y from c), g as (select a.x, a.y, atan2(b.y - a.y, b.x - a.x) as t from p a join p b on a.x <> b.x or a.y <> b.y),
w as (select x, y, t, lead(t) over (partition by x, y order by t) as nxt, min(t) over (partition by x, y) + 2 * pi() as first_again from g), v as (select x, y from w group by x, y having max(coalesce(nxt, first_again) - t) > pi() + 1e-9),
m as (select avg(x) as mx, avg(y) as my from v), o as (select x, y, row_number() over (order by atan2(y - my, x - mx)) as i, count(*) over () as n from v, m)
select count(*)::int as corners, round(abs(sum(a.x * b.y - b.x * a.y)) / 2, 3) as area from o a join o b on b.i = a.i % a.n + 1""")
def hull_of_layer(spark, d):
    p = _customers(spark, d).select("k", F.array(F.array(F.array(F.array("x", "y")))).alias("shape"))
    return V.layer_hull(p).select(F.size(F.col("shape")[0][0]).alias("corners"), F.round(F.abs(G.ring_area(F.concat(F.col("shape")[0][0], F.slice(F.col("shape")[0][0], 1, 1)))), 3).alias("area"))


@query("select count(*) as cells, round(sum((x1 - x0) * (y1 - y0))::double, 3) as area from (select r, c, c * 125.0 as x0, 1000 - (r + 1) * 125.0 as y0, (c + 1) * 125.0 as x1, 1000 - r * 125.0 as y1 from range(8) t(r), range(8) u(c))")
def fishnet(spark, d):
    f = V.fishnet(spark, 0, 0, 1000, 1000, 125.0)
    return f.agg(F.count("*").alias("cells"), F.round(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), 3).alias("area"))


@query("""with r as (select region_id, geojson::json as g from regions), p as (select region_id, case when g->>'type' = 'Polygon' then [from_json(g->'coordinates', '[[["DOUBLE"]]]')] when g->>'type' = 'MultiPolygon' then from_json(g->'coordinates', '[[[["DOUBLE"]]]]') end as parts from r),
pt as (select region_id, unnest(flatten(flatten(parts))) as q from p), box as (select region_id, min(q[1]) as x0, min(q[2]) as y0, max(q[1]) as x1, max(q[2]) as y1 from pt group by 1),
e as (select region_id, parts[1][1] as ring, unnest(range(1, len(parts[1][1]))) as i from p), a as (select region_id, abs(sum(radians(ring[i + 1][1] - ring[i][1]) * (2 + sin(radians(ring[i][2])) + sin(radians(ring[i + 1][2]))))) * power(6371008.8, 2) / 2 as m2 from e group by 1)
select region_id, 'polygon' as kind, len(parts) as parts, round(m2 / 1e6, 1) as km2, x0, y0, x1, y1 from p join box using (region_id) join a using (region_id)""")
def region_measures(spark, d):
    """GeoJSON layer: parts, spherical area of the first ring, box."""
    r = parse_geojson(read(spark, d, "regions"), "geojson")
    b = G.shape_box(F.col("shape"))
    return r.select("region_id", "kind", F.size("shape").alias("parts"), F.round(G.sphere_area(F.col("shape")[0][0]) / 1e6, 1).alias("km2"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))


@query("""with p as (select station, lon, lat, 32600 + (lat < 0)::int * 100 + least(60, greatest(1, floor((lon + 180) / 6)::int + 1)) as zone, radians(lat) as p, radians(lon - (least(60, greatest(1, floor((lon + 180) / 6)::int + 1)) * 6 - 183)) as l, 1 / 298.257223563::double / (2 - 1 / 298.257223563::double) as n from stations where abs(lat) < 84),
t as (select *, 2 * sqrt(n) / (1 + n) as e from p), u as (select *, sinh(atanh(sin(p)) - e * atanh(e * sin(p))) as t from t), v as (select *, atan2(t, cos(l)) as xi, atanh(sin(l) / sqrt(1 + t * t)) as eta, [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440, 61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280] as a from u),
w as (select *, 0.9996 * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) as r, eta + a[1] * cos(2 * xi) * sinh(2 * eta) + a[2] * cos(4 * xi) * sinh(4 * eta) + a[3] * cos(6 * xi) * sinh(6 * eta) + a[4] * cos(8 * xi) * sinh(8 * eta) as ex, xi + a[1] * sin(2 * xi) * cosh(2 * eta) + a[2] * sin(4 * xi) * cosh(4 * eta) + a[3] * sin(6 * xi) * cosh(6 * eta) + a[4] * sin(8 * xi) * cosh(8 * eta) as ny from v)
select station, zone, round(500000 + r * ex, 3) as x, round(case when lat < 0 then 10000000 else 0 end + r * ny, 3) as y, true as exact from w""")
def utm_roundtrip(spark, d):
    """Stations to UTM and back: the largest error in degrees is below 1e-8."""
    s = read(spark, d, "stations").where("abs(lat) < 84")
    zone = G.utm_zone(F.col("lon"), F.col("lat"))
    x, y = G.to_utm(F.col("lon"), F.col("lat"), zone)
    lon, lat = G.from_utm(F.col("x"), F.col("y"), F.col("zone"))
    out = s.select("station", "lon", "lat", zone.alias("zone"), x.alias("x"), y.alias("y"))
    return out.select("station", "zone", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), (F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))) < 1e-8).alias("exact"))


# --- Rasters ---------------------------------------------------------------------------------------------------------

_EV = "h as (select date_trunc('hour', ts) as hr, event_type, avg(value) as v from events group by all), r as (select extract(hour from hr)::bigint as \"row\", extract(day from hr)::bigint as day, event_type, v from h)"


def _hours(spark, d):
    h = read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hr"), "event_type").agg(F.avg("value").alias("v"))
    return h.select(F.hour("hr").cast("long").alias("row"), F.dayofmonth("hr").cast("long").alias("day"), "event_type", "v")


@query("""with p as (select scene_id as zone, case when b08 is null or b08::varchar = 'nan' then null else b08 end as v from pixels)
select zone as scene_id, round(avg(v), 6) as mean, round(min(v), 6) as min, round(max(v), 6) as max, round(stddev_pop(v), 6) as std, round(median(v), 6) as median, round(sum(v), 6) as sum, count(v) as count from p where zone is not null group by 1""")
def zonal_stats(spark, d):
    return R.zonal(read(spark, d, "pixels"), "scene_id", "b08")


@query("""with c as (select scene_id, label_code as class, count(*) as n from pixels group by all) select scene_id, class, round(100.0 * n / sum(n) over (partition by scene_id), 2) as percent,
first_value(class) over (partition by scene_id order by n desc, class rows between unbounded preceding and unbounded following) as majority from c where class is not null""")
def zonal_pct(spark, d):
    return R.zonal_classes(read(spark, d, "pixels"), "scene_id", "label_code")


@query("select (b.v > 50)::int + (case when b.v > 50 then 0 when b.v >= 20 then 2 else 0 end) as class, count(*) as n from (select value as v from events) b group by 1")
def reclassify(spark, d):
    rule = R.reclassify(F.col("value"), [(50.0000001, 1e9, 1), (20, 50.0000001, 2)])
    return read(spark, d, "events").groupBy(rule.alias("class")).agg(F.count("*").alias("n"))


_HALF = f"with {_EV}, a as (select \"row\", event_type, avg(v) as v from r where day <= 15 group by all), z as (select \"row\", event_type, avg(v) as v from r where day > 15 group by all)"


def _halves(spark, d):
    h = _hours(spark, d)
    return tuple(h.where(c).groupBy("row", "event_type").agg(F.avg("v").alias("v")) for c in ("day <= 15", "day > 15"))


@query(_HALF + " select \"row\", event_type, round(a.v, 5) as before, round(z.v, 5) as after, round(z.v - a.v, 5) as difference, round(100 * (z.v - a.v) / nullif(abs(a.v), 0), 4) as percent from a join z using (\"row\", event_type)")
def change_diff(spark, d):
    c = R.change(*_halves(spark, d), "v", ["row", "event_type"])
    return c.select("row", "event_type", F.round("before", 5).alias("before"), F.round("after", 5).alias("after"), F.round("difference", 5).alias("difference"), F.round("percent", 4).alias("percent"))


@query(_HALF + " select round(avg(z.v - a.v), 5) as mean_change, round(avg((z.v > a.v)::int) * 100, 4) as increased_pct, count(*) as pixels from a join z using (\"row\", event_type)")
def change_summary(spark, d):
    s = R.change_summary(R.change(*_halves(spark, d), "v", ["row", "event_type"]))
    return s.select(F.round("mean_change", 5).alias("mean_change"), F.round("increased_pct", 4).alias("increased_pct"), "pixels")


@query(_HALF + ", f as (select floor(a.v / 20)::bigint as from_class, floor(z.v / 20)::bigint as to_class from a join z using (\"row\", event_type)) select from_class, to_class, count(*) as pixels, round(count(*) * 0.01, 6)::double as hectares, from_class <> to_class as changed from f group by all order by pixels desc, from_class, to_class limit 200")
def change_matrix(spark, d):
    a, z = (h.withColumn("c", F.floor(F.col("v") / 20)) for h in _halves(spark, d))
    return R.change_matrix(a, z, "c", 0.01, ["row", "event_type"]).withColumn("hectares", F.round("hectares", 6))


@query("select tile, pix_row, pix_col, round(median(case when ok and b04 is not null then b04 end), 6) as b04, sum(ok::int)::bigint as clear_obs_count from (select p.*, tile, label_code not in (0, 1, 3, 8, 9, 10) as ok from (select scene_id, pix_row, pix_col, case when b04::varchar = 'nan' then null else b04 end as b04, label_code from pixels) p join scenes using (scene_id)) group by all")
def composite_median(spark, d):
    px = read(spark, d, "pixels").join(read(spark, d, "scenes").select("scene_id", "tile"), "scene_id")
    c = R.composite(px, ["b04"], scene_class_clear(F.col("label_code")), ["tile", "pix_row", "pix_col"])
    return c.withColumn("b04", F.round("b04", 6))


@query("select tile, pix_row, pix_col, first(b02 order by captured_at desc, scene_id, sample_id) as b02 from (select p.*, tile, captured_at from (select sample_id, scene_id, pix_row, pix_col, b02 from pixels where b02 is not null and b02::varchar <> 'nan') p join scenes using (scene_id)) group by all")
def mosaic_first_valid(spark, d):
    px = read(spark, d, "pixels").join(read(spark, d, "scenes").select("scene_id", "tile", "captured_at"), "scene_id")
    px = px.withColumn("b02", F.when(~F.isnan("b02"), F.col("b02"))).where("b02 is not null")
    age = -F.unix_micros(F.col("captured_at").cast("timestamp"))
    return R.mosaic(px, ["b02"], [age, F.col("scene_id"), F.col("sample_id")], ["tile", "pix_row", "pix_col"])


@query("with n as (select * from scenes order by cloud_pct nulls last, scene_id limit 5), c as (select scene_id, avg((label is not null)::int) as clear from pixels group by 1) select scene_id, round(clear, 6) as clear from n left join c using (scene_id) order by clear desc nulls last, scene_id limit 1")
def best_scene(spark, d):
    clear = read(spark, d, "pixels").groupBy("scene_id").agg(F.avg(F.col("label").isNotNull().cast("double")).alias("clear"))
    s = read(spark, d, "scenes").join(clear, "scene_id", "left")
    return R.best_scene(s, "cloud_pct", "clear").select("scene_id", F.round("clear", 6).alias("clear"))


_SLOPE = f"""with {_G}, d as (select *, (coalesce(lead(z) over r, z) - coalesce(lag(z) over r, z)) / ((lead(z) over r is not null)::int + (lag(z) over r is not null)::int) / 10 as dx,
(coalesce(lead(z) over c, z) - coalesce(lag(z) over c, z)) / ((lead(z) over c is not null)::int + (lag(z) over c is not null)::int) / 10 as dy from g window r as (partition by "row" order by col), c as (partition by col order by "row"))"""


@query(_SLOPE + """ select "row", col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) as slope, round(case when dx = 0 and dy = 0 then -1 else fmod(degrees(atan2(-dx, dy)) + 360, 360) end, 5) as aspect from d""")
def slope_aspect(spark, d):
    t = R.terrain(_grid(spark, d), "z", 10.0)
    return t.select("row", "col", F.round("slope", 6).alias("slope"), F.round("aspect", 5).alias("aspect"))


@query(_SLOPE + """ select "row", col, round(255 * greatest(0, cos(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + sin(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(315) - case when dx = 0 and dy = 0 then 0 else atan2(-dx, dy) end)), 4) as hillshade from d""")
def hillshade(spark, d):
    return R.terrain(_grid(spark, d), "z", 10.0).select("row", "col", F.round("hillshade", 4).alias("hillshade"))


_N3 = f'with {_G}, n as (select a."row", a.col, b.z, b.cls from g a join g b on abs(a."row" - b."row") <= 1 and abs(a.col - b.col) <= 1)'


@query(_N3 + ' select "row", col, round(avg(z), 7) as mean, round(stddev_pop(z), 7) as std, round(min(z), 7) as low, round(max(z), 7) as high from n group by all')
def focal_mean3(spark, d):
    out = None
    for stat, name in (("mean", "mean"), ("std", "std"), ("min", "low"), ("max", "high")):
        f = R.focal(_grid(spark, d), "z", 3, stat, name=name).withColumn(name, F.round(name, 7))
        out = f if out is None else out.join(f, ["row", "col"])
    return out


@query(_N3 + ', c as (select "row", col, cls, count(*) as k from n group by all) select "row", col, cls as majority from c qualify row_number() over (partition by "row", col order by k desc, cls) = 1')
def focal_majority3(spark, d):
    return R.focal(_grid(spark, d), "cls", 3, "majority", name="majority")


@query(_N3.replace("b.z, b.cls", "b.z, b.\"row\" - a.\"row\" as i, b.col - a.col as j, b.cls") + ' select "row", col, round(sqrt(power(sum(z * j * (2 - abs(i))), 2) + power(sum(z * i * (2 - abs(j))), 2)), 6) as sobel from n group by all')
def focal_sobel(spark, d):
    return R.sobel(_grid(spark, d), "z").withColumn("sobel", F.round("sobel", 6))


@query(f"""with {_G}, w as (select i, exp(-0.5 * i * i) as w from range(-4, 5) t(i)), n as (select a."row", a.col, b.z, x.w * y.w as w from g a join g b on abs(a."row" - b."row") <= 4 and abs(a.col - b.col) <= 4 join w x on x.i = b."row" - a."row" join w y on y.i = b.col - a.col)
select "row", col, round(sum(z * w) / sum(w), 6) as smooth from n group by all""")
def focal_gaussian(spark, d):
    return R.kernel_filter(_grid(spark, d), "z", R.gaussian_kernel(1.0), name="smooth", normalise=True).withColumn("smooth", F.round("smooth", 6))


@query(f'with {_G} select "row" // 5 as "row", col // 5 as col, round(avg(z), 7) as z from g group by all')
def resample_avg(spark, d):
    return R.coarsen(_grid(spark, d), 5, ["z"]).withColumn("z", F.round("z", 7))


@query(f'with {_G}, c as (select "row" // 5 as "row", col // 5 as col, cls, count(*) as n from g group by all) select "row", col, cls from c qualify row_number() over (partition by "row", col order by n desc, cls) = 1')
def resample_mode(spark, d):
    return R.coarsen(_grid(spark, d), 5, ["cls"], "mode").select("row", "col", "cls")


@query(f"""with {_G}, o as (select o, abs((o + 0.5) / 2 - 0.5) as t from range(-4, 8) r(o)), k as (select o, case when t <= 1 then 1.5 * t * t * t - 2.5 * t * t + 1 when t < 2 then -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2 else 0 end as w from o),
s as (select g."row" * 2 + a.o as "row", g.col * 2 + b.o as col, z, a.w * b.w as w from g, k a, k b), e as (select max("row") * 2 + 1 as r1, max(col) * 2 + 1 as c1 from g)
select "row", col, round(sum(z * w) / sum(w), 6) as z from s, e where "row" between 0 and r1 and col between 0 and c1 group by all""")
def resample_cubic(spark, d):
    return R.refine(_grid(spark, d).select("row", "col", "z"), 2, ["z"], "cubic").withColumn("z", F.round("z", 6))


@query(f"with {_G}, q as (select quantile_cont(z, 0.02) as a, quantile_cont(z, 0.98) as b from g) select \"row\", col, round(least(1, greatest(0, (z - a) / nullif(b - a, 0))), 6) as stretched from g, q")
def enhance_stretch(spark, d):
    return R.stretch(_grid(spark, d), "z").select("row", "col", F.round("stretched", 6).alias("stretched"))


@query(f"""with {_G}, e as (select min(z) as a, max(z) as b from g), t as (select "row", col, (z - a) / (b - a) * 1024 as t from g, e), p as (select *, least(1023, floor(t))::int as bin from t), c as (select bin, count(*) as n from p group by 1),
w as (select *, coalesce(sum(n) over (order by bin rows between unbounded preceding and 1 preceding), 0) as below, sum(n) over () as k from c) select "row", col, round((below + n * (t - bin)) / k, 6) as equalized from p join w using (bin)""")
def enhance_equalize(spark, d):
    return R.equalize(_grid(spark, d), "z").select("row", "col", F.round("equalized", 6).alias("equalized"))


@query()
def enhance_clahe(spark, d):
    return R.clahe(_grid(spark, d), "z", 8).withColumn("clahe", F.round("clahe", 6))


@query(f"""with {_G}, w as (select g.*, unnest(range(greatest(0, ceil((g."row" - 9) / 5.0)::bigint), g."row" // 5 + 1)) as prow from g), v as (select w.*, unnest(range(greatest(0, ceil((col - 9) / 5.0)::bigint), col // 5 + 1)) as pcol from w),
c as (select prow, pcol, cls, count(*) as n from v group by all) select prow, pcol, sum(n)::bigint as pixels, round(sum(n) / 100.0, 6) as valid_fraction, first(cls::varchar order by n desc, cls::varchar) as dominant from c group by all having sum(n) >= 50""")
def tile_stats(spark, d):
    p = R.patches(_grid(spark, d), 10, 5, "cls")
    return p.select("prow", "pcol", "pixels", F.round("valid_fraction", 6).alias("valid_fraction"), "dominant")


@query(f"""with recursive {_G}, t as (select "row", col, cls % 3 as c, "row" * 2147483648 + col as id from g), e as (select a.id as a, b.id as b from t a join t b on a.c = b.c and abs(a."row" - b."row") + abs(a.col - b.col) = 1),
reach(a, b) as (select id, id from t union select r.a, e.b from reach r join e on r.b = e.a), l as (select a as id, min(b) as region from reach group by 1)
select region, c, count(*) as pixels, min("row") as row0, max("row") as row1, min(col) as col0, max(col) as col1, count(*) * 0.01::double as hectares from t join l using (id) group by region, c having count(*) >= 2""")
def raster_regions(spark, d):
    g = _grid(spark, d).withColumn("c", F.col("cls") % 3)
    return R.region_boxes(R.connected_regions(g, "c"), "c", 0.01, 2)


@query(f"""with {_G}, e as (select a."row", a.col, a.cls % 3 as c, b.cls % 3 as other, 'right' as side from g a join g b on b."row" = a."row" and b.col = a.col + 1 union all select a."row", a.col, a.cls % 3, b.cls % 3, 'below' from g a join g b on b."row" = a."row" + 1 and b.col = a.col) select "row", col, c, other, side from e where c <> other""")
def raster_boundaries(spark, d):
    return R.boundary_edges(_grid(spark, d).withColumn("c", F.col("cls") % 3), "c").select("row", "col", "c", "other", "side")


@query(f"""with {_G}, s as (select a."row" as r, a.col as c, a.z as z0, b.z as z1, x.z as z2, y.z as z3 from g a join g b on b."row" = a."row" and b.col = a.col + 1 join g x on x."row" = a."row" + 1 and x.col = a.col join g y on y."row" = a."row" + 1 and y.col = a.col + 1),
n as (select *, unnest(range((floor(least(z0, z1, z2, z3) / 0.1::double) + 1)::bigint, (ceil(greatest(z0, z1, z2, z3) / 0.1::double))::bigint)) * 0.1::double as l from s),
u as (select *, z0 >= l as u0, z1 >= l as u1, z2 >= l as u2, z3 >= l as u3, (z0 + z1 + z2 + z3) / 4 >= l as mid, (l - z0) / nullif(z1 - z0, 0) as tx, (l - z2) / nullif(z3 - z2, 0) as bx, (l - z0) / nullif(z2 - z0, 0) as ly, (l - z1) / nullif(z3 - z1, 0) as ry from n),
m as (select *, u0 <> u1 as t, u2 <> u3 as b, u0 <> u2 as lf, u1 <> u3 as rt from u),
p as (select l, t and b and lf and rt as saddle, (u1 and u2 and not u0 and not u3) = mid as first_way, t, b, lf, rt, sqrt(power(tx, 2) + power(ly, 2)) as tl, sqrt(power(1 - tx, 2) + power(ry, 2)) as tr, sqrt(power(bx, 2) + power(1 - ly, 2)) as bl, sqrt(power(1 - bx, 2) + power(1 - ry, 2)) as br, sqrt(1 + power(ly - ry, 2)) as lr, sqrt(1 + power(tx - bx, 2)) as tb from m),
q as (select l, unnest(case when saddle then case when first_way then [tl, br] else [tr, bl] end when t and lf then [tl] when t and rt then [tr] when b and lf then [bl] when b and rt then [br] when lf and rt then [lr] when t and b then [tb] else [] end) as len from p)
select round(l, 6) as level, count(*) as segments, round(sum(len), 4) as length from q group by 1""")
def contours(spark, d):
    s = R.contour_segments(_grid(spark, d), "z", 0.1)
    return s.groupBy(F.round("level", 6).alias("level")).agg(F.count("*").alias("segments"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 4).alias("length"))


@query()
def centrelines(spark, d):
    return R.centre_lines(_grid(spark, d).withColumn("m", (F.col("z") > 0).cast("double")), "m")


@query(f'with {_G} select "row", col, z from g where "row" % 4 = 0 and col % 4 = 0')
def raster_to_points(spark, d):
    return R.to_points(_grid(spark, d), step=4).select("row", "col", "z")


@query("with c as (select sample_id, b02, b03, label from pixels where b02 is not null and b02::varchar <> 'nan' and b02 <> -9999 and b03 is not null and b03::varchar <> 'nan' and b03 <> -9999 and label is not null) select sample_id, b02, b03 from c")
def raster_to_table(spark, d):
    return R.pixel_table(read(spark, d, "pixels"), ["b02", "b03"], "label", labelled_only=True).select("sample_id", "b02", "b03")


@query(f"with {_C}, g as (select k, floor(x / 50)::int as col, floor((1001 - y) / 50)::int as \"row\", v from c) select \"row\", col, max_by(v, k) as value, count(*) as n from g group by all")
def rasterise_points(spark, d):
    g = R.align(_customers(spark, d), "x", "y", 0.0, 1001.0, 50.0)
    return J.rasterise(g, "row", "col", "v", "k")


@query(f'with {_G}, {_C}, p as (select k, floor(x / 40)::int as col, floor((1001 - y) / 40)::int as "row" from c) select k, z as sampled from p left join g on g."row" = p."row" and g.col = p.col')
def sample_raster(spark, d):
    return R.sample_at(_grid(spark, d).withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")}), _customers(spark, d), "x", "y", 0.0, 1001.0, 40.0, "z").select("k", "sampled")


@query(f'with {_G} select "row", col, round(z, 6) as z, cls, round(z * 2 + cls, 6) as total from g')
def stack_layers(spark, d):
    g = _grid(spark, d)
    s = R.stack({"dem": g.select("row", "col", "z"), "map": g.select("row", "col", "cls")})
    return R.raster_calc(s, "z * 2 + cls", "total").select("row", "col", F.round("z", 6).alias("z"), "cls", F.round("total", 6).alias("total"))


# --- Surfaces --------------------------------------------------------------------------------------------------------

_Q = "q as (select (c + 0.5) * 100.0 as x, 1000 - (r + 0.5) * 100.0 as y, r::int as \"row\", c::int as col from range(10) t(r), range(10) u(c))"


def _surface(spark, d, method, **options):
    pts = I.control_points(_suppliers(spark, d), "x", "y", "v")
    return I.interpolate(pts, I.grid_cells(spark, 0, 0, 1000, 1000, 100.0), method, **options).select("row", "col", F.round("value", 4).alias("value"))


@query(f"with {_S}, {_Q}, d as (select \"row\", col, v, sqrt(power(s.x - q.x, 2) + power(s.y - q.y, 2)) as d, s.k from q, s), n as (select * from d qualify row_number() over (partition by \"row\", col order by d, k) <= 12) select \"row\", col, round(sum(v / (d * d)) / sum(1 / (d * d)), 4) as value from n group by all")
def idw_grid(spark, d):
    return _surface(spark, d, "idw")


@query(f"with {_S}, {_Q}, d as (select \"row\", col, v, sqrt(power(s.x - q.x, 2) + power(s.y - q.y, 2)) as d, s.k from q, s), n as (select * from d qualify row_number() over (partition by \"row\", col order by d, k) <= 12) select \"row\", col, round(sum(v / (d * d)) / sum(1 / (d * d)), 4) as value from n group by all")
def idw_join(spark, d):
    """The same surface for any number of points, by a join."""
    return I.surface_join(_suppliers(spark, d), I.grid_cells(spark, 0, 0, 1000, 1000, 100.0), "x", "y", "v", "k").withColumn("value", F.round("value", 4))


@query(f"with {_S}, {_Q} select \"row\", col, round(v, 4) as value from q, s qualify row_number() over (partition by \"row\", col order by power(s.x - q.x, 2) + power(s.y - q.y, 2)) = 1")
def nearest_grid(spark, d):
    return _surface(spark, d, "nearest")


@query()
def trend_grid(spark, d):
    return _surface(spark, d, "trend", order=2)


@query()
def tin_grid(spark, d):
    return _surface(spark, d, "tin")


@query()
def spline_grid(spark, d):
    return _surface(spark, d, "spline")


@query()
def kriging_grid(spark, d):
    pts = I.control_points(_suppliers(spark, d), "x", "y", "v")
    return _surface(spark, d, "kriging", fitted=I.fit_variogram(pts, spark=spark))


@query()
def natural_grid(spark, d):
    return _surface(spark, d, "natural")


@query()
def loo_compare(spark, d):
    pts = I.control_points(_suppliers(spark, d), "x", "y", "v")
    got = I.compare_methods(pts, ("idw", "nearest", "trend", "kriging"), spark)
    return spark.createDataFrame([(r["method"], r["rmse"], r["mae"], r["bias"], r["checked"]) for r in got], "method string, rmse double, mae double, bias double, checked double")


# --- Embeddings and models -------------------------------------------------------------------------------------------

_E = "e as (select vec_id, label, embedding::double[] as v from embeddings), x as (select label, i, avg(v[i]) as m from e, range(1, 65) t(i) group by all), mv as (select label, list(m order by i) as m from x group by 1)"


def _emb(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _means(spark, d):
    return L.mean_vectors(_emb(spark, d), ["label"], "v")


@query(f"with {_E} select vec_id, round(list_cosine_similarity(v, m), 5) as score from e join mv using (label)")
def cosine_to_mean(spark, d):
    return _emb(spark, d).join(_means(spark, d), "label").select("vec_id", F.round(L.cosine(F.col("v"), F.col("mean")), 5).alias("score"))


@query("with e as (select vec_id, embedding::double[] as v from embeddings) select vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) as first, round(sqrt(list_dot_product(v, v)), 5) as length from e")
def l2_normalise(spark, d):
    return _emb(spark, d).select("vec_id", F.round(L.unit(F.col("v"))[0], 6).alias("first"), F.round(L.norm(F.col("v")), 5).alias("length"))


@query("with e as (select vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings), c as (select vec_id, i, x, greatest(-127, least(127, round_even(sign(x) * sqrt(abs(x)) * 127.5, 0))) as q from e) select vec_id, round(max(abs(x - sign(q) * power(q / 127.5, 2))), 6) as worst from c group by 1")
def int8_roundtrip(spark, d):
    back = L.decode_sqrt(L.encode_sqrt(F.col("v")))
    gap = F.array_max(F.zip_with(F.col("v"), back, lambda a, b: F.abs(a - b)))
    return _emb(spark, d).select("vec_id", F.round(gap, 6).alias("worst"))


@query(f"with {_E} select e.vec_id, mv.label as predicted, round(list_distance(v, m), 5) as score from e, mv qualify row_number() over (partition by e.vec_id order by list_distance(v, m), mv.label) = 1")
def min_distance_classify(spark, d):
    return L.nearest_mean(_emb(spark, d), _means(spark, d), "v", "label").select("vec_id", "predicted", F.round("score", 5).alias("score"))


@query(f"with {_E} select e.vec_id, mv.label as predicted from e, mv qualify row_number() over (partition by e.vec_id order by list_cosine_similarity(v, m) desc, mv.label) = 1")
def sam_classify(spark, d):
    return L.nearest_mean(_emb(spark, d), _means(spark, d), "v", "label", angle=True).select("vec_id", "predicted")


@query("""with e as (select vec_id, label, embedding::float[64] as v from embeddings), n as (select q.vec_id as query, b.label, array_cosine_similarity(q.v, b.v) as s, b.vec_id as near from e q join e b on q.vec_id <> b.vec_id where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by s desc, near) <= 10),
w as (select query, label, sum(round(s::double, 6)) as s from n group by all) select query, label as predicted from w qualify row_number() over (partition by query order by s desc, label) = 1""")
def knn_vote(spark, d):
    """Stated query set (ids divisible by 20) against all rows, in blocks."""
    e = read(spark, d, "embeddings")
    near = L.neighbours_exact(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    return L.knn_vote(near, e, "vec_id", "label")


_FEATURES = ["b02", "b03", "b04", "b08", "b11", "b12"]


def _training(spark, d):
    return R.pixel_table(read(spark, d, "pixels"), _FEATURES, "label_code").where("label_code > 0")


@query()
def gaussian_classify(spark, d):
    df = _training(spark, d)
    out = L.gaussian_classify(df, L.gaussian_class_stats(df, "label_code", _FEATURES), "label_code", _FEATURES)
    return out.groupBy("label_code", "predicted").agg(F.count("*").alias("n"))


@query()
def lda_classify(spark, d):
    df = _training(spark, d)
    out = L.gaussian_classify(df, L.gaussian_class_stats(df, "label_code", _FEATURES), "label_code", _FEATURES, pooled=True)
    return out.groupBy("label_code", "predicted").agg(F.count("*").alias("n"))


@query()
def rf_accuracy(spark, d):
    df = L.grouped_split(_training(spark, d), F.coalesce(F.nullif("poly_id", F.lit(0)), -F.col("sample_id")), 0.25)
    df = Staged(df.select("label_code", "split", *_FEATURES)).df
    model = L.train_classifier(df.where("split = 'train'"), "label_code", _FEATURES, "rf", numTrees=20, maxDepth=8)
    out = model.transform(df.where("split = 'test'")).select(F.col("label_code").cast("string").alias("t"), F.col("predicted"))
    return out.agg(F.count("*").alias("n"), F.round(F.avg((F.col("t") == F.col("predicted")).cast("double")), 3).alias("accuracy"))


@query()
def kmeans_sizes(spark, d):
    out, _ = L.cluster(_training(spark, d), _FEATURES, "kmeans", 8)
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def pca_variance(spark, d):
    _, explained, loadings = L.principal_components(_training(spark, d), _FEATURES, 3)
    return spark.createDataFrame([(i + 1, round(v, 6), [round(float(row[i]), 6) for row in loadings]) for i, v in enumerate(explained)], "component int, explained double, loadings array<double>")


@query(f"""with recursive {_C}, near as (select a.k as a, b.k as b from c a join c b on a.k <> b.k and abs(a.x - b.x) <= 15 and abs(a.y - b.y) <= 15 where sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 15),
core as (select k from c left join near on a = k group by k having count(b) + 1 >= 4), cc as (select a, b from near where a in (from core) and b in (from core)),
reach(a, b) as (select k, k from core union select r.a, e.b from reach r join cc e on r.b = e.a), l as (select a as k, min(b) as label from reach group by 1),
border as (select near.a as k, min(label) as label from near join l on l.k = near.b group by 1) select c.k as node, coalesce(l.label, border.label, -1) as cluster from c left join l using (k) left join border using (k)""")
def dbscan_points(spark, d):
    c = _customers(spark, d)
    pairs = J.within_distance(c, c, "x", "y", "k", "k", 15.0).where("a_key < b_key").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    return L.dbscan(pairs, c.select(F.col("k").alias("node")), 4)


@query("""with e as (select min(x) as x0, min(y) as y0, greatest(max(x) - min(x), max(y) - min(y)) / 8 as w from pixels) select (floor((x - x0) / w) * 1000000 + floor((y - y0) / w))::bigint as block, count(*) as n from pixels, e group by 1""")
def spatial_block_split(spark, d):
    return L.block_key(read(spark, d, "pixels"), "x", "y").groupBy("block").agg(F.count("*").alias("n"))


@query("select label_code as cluster, unnest(['b02', 'b08']) as feature, unnest([count(a), count(b)]) as n, round(unnest([avg(a), avg(b)]), 5) as mean from (select label_code, case when b02::varchar = 'nan' or b02 = -9999 then null else b02 end as a, case when b08::varchar = 'nan' or b08 = -9999 then null else b08 end as b from pixels) group by label_code")
def cluster_profile(spark, d):
    df = R.pixel_table(read(spark, d, "pixels"), ["b02", "b08"], drop_nodata=False)
    return L.cluster_profile(df, "label_code", ["b02", "b08"]).select("cluster", "feature", "n", F.round("mean", 5).alias("mean"))


@query("with m as (select median(b02) filter (b02::varchar <> 'nan') as m from pixels where b02 is not null) select sample_id, case when b02 is null or b02::varchar = 'nan' then m else b02 end as b02, coalesce(crop, '(missing)') as crop from pixels, m")
def impute_missing(spark, d):
    return L.impute(read(spark, d, "pixels").select("sample_id", "b02", "crop"), ["b02"], ["crop"])


@query("with q as (select quantile_cont(value, 0.01) as a, quantile_cont(value, 0.99) as b from events) select event_id, least(greatest(value, a), b) as value from events, q")
def clip_outliers(spark, d):
    return L.clip_quantiles(read(spark, d, "events").select("event_id", "value"), ["value"])


# --- Streams ---------------------------------------------------------------------------------------------------------


def _stream(spark, d):
    path = f"{d}/events.parquet"
    return P.stream_parquet(spark, path, spark.read.parquet(path))


_MARK = "m as (select max(ts) - interval 1 hour as mark from events)"


@query(f"with {_MARK} select time_bucket(interval 6 hours, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events, m group by 1, 2, mark having time_bucket(interval 6 hours, any_value(ts)) + interval 6 hours <= mark")
def stream_windows(spark, d):
    """Windows that the watermark has passed."""
    w = P.window_stats(_stream(spark, d), "ts", "event_type", "value", "6 hours")
    return P.run_available(w).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select event_id, event_type from events")
def stream_distinct(spark, d):
    return P.run_available(P.distinct_readings(_stream(spark, d), ["event_id"], "ts", "1000 hours").select("event_id", "event_type"))


@query("""with m as (select max(ts) - interval 2 hours as mark from events), t as (select event_type, date_trunc('hour', ts) as hr, value from events), u as (select event_type, hr + interval 1 hour * (k + 1) as until, hr, value from t, range(24) r(k))
select event_type, until, case when count(distinct hr) >= 18 then round(avg(value), 8) end as mean from u, m where until <= mark group by all""")
def stream_trailing_means(spark, d):
    m = P.trailing_means(_stream(spark, d), "ts", "event_type", "value", 24)
    return P.run_available(m).select("event_type", F.col("until").cast("timestamp_ntz").alias("until"), F.round("mean", 8).alias("mean"))


@query(f"""with {_MARK}, g as (select event_type, ts, case when ts - lag(ts) over (partition by event_type order by ts) <= interval 20 minutes then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by event_type order by ts) as k from g)
select event_type, min(ts) as start, count(*) as n from s, m group by event_type, k, mark having max(ts) + interval 20 minutes <= mark""")
def stream_sessions(spark, d):
    """Sessions that the watermark has passed."""
    s = P.sessions(_stream(spark, d), "ts", "event_type", "20 minutes")
    return P.run_available(s).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("with s as (select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1) select n_name, n, row_number() over (order by n desc, n_name) as place from s")
def rank_by_size(spark, d):
    """Labels 1.. by falling size."""
    g = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    return L.relabel_by_size(g, "n_name", "place", noise="").groupBy("n_name", "place").agg(F.count("*").alias("n"))
