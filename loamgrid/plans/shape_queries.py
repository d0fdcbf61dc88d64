"""Queries on exact shapes, table views, codecs, detections and other small operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.functions.expressions import calculate
from loamgrid.functions.spectral import index_stack, landsat_clear, with_indices
from loamgrid.operators import detection as D
from loamgrid.operators import learning as L
from loamgrid.operators import raster as R
from loamgrid.operators import series as S
from loamgrid.operators import shapes as X
from loamgrid.operators import stats as A
from loamgrid.operators import supervised as M
from loamgrid.operators import tables as T
from loamgrid.operators import texts as W
from loamgrid.operators import vectors as V
from loamgrid.plans.spatial_queries import _B, _C, _CELLS, _G, _boxes, _customers, _grid, _shapes
from loamgrid.plans.table_queries import _PANEL, _panel
from loamgrid.sources.tables import backscatter, product_names
from loamgrid.storage import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- Joins of shapes -------------------------------------------------------------------------------------------------

_MEET = "a.x0 <= o.x1 and o.x0 <= a.x1 and a.y0 <= o.y1 and o.y0 <= a.y1"


def _layers(spark, d):
    s = _shapes(_boxes(spark, d).select("k", "cls", "x0", "y0", "x1", "y1"))
    return s.where("cls = 0"), s.where("cls = 1")


@query(f"with {_B} select k from b a where cls = 0 and exists (select 1 from b o where o.cls = 1 and {_MEET})")
def shapes_intersecting(spark, d):
    return X.select_by_location(*_layers(spark, d), "k", "k").select("k")


@query(f"with {_B} select k from b a where cls = 0 and not exists (select 1 from b o where o.cls = 1 and {_MEET})")
def shapes_disjoint(spark, d):
    return X.select_by_location(*_layers(spark, d), "k", "k", disjoint=True).select("k")


@query(f"with {_B} select k from b a where cls = 0 and exists (select 1 from b o where o.cls = 1 and power(greatest(0, o.x0 - a.x1, a.x0 - o.x1), 2) + power(greatest(0, o.y0 - a.y1, a.y0 - o.y1), 2) <= 9)")
def shapes_in_reach(spark, d):
    return X.select_by_location(*_layers(spark, d), "k", "k", "distance", 3.0).select("k")


@query(f"with {_B} select a.k as a_k, o.k as b_k from b a join b o on a.cls = 0 and o.cls = 1 and a.x0 >= o.x0 and a.x1 <= o.x1 and a.y0 >= o.y0 and a.y1 <= o.y1")
def shapes_within(spark, d):
    return X.shape_pairs(*_layers(spark, d), "k", "k", "within")


@query(f"with {_B}, q as (select a.k as a_k, o.k as b_k, (least(a.x1, o.x1) - greatest(a.x0, o.x0)) * (least(a.y1, o.y1) - greatest(a.y0, o.y0)) as overlap from b a join b o on a.cls = 0 and o.cls = 1 and a.x0 < o.x1 and o.x0 < a.x1 and a.y0 < o.y1 and o.y0 < a.y1) select a_k, b_k, round(overlap, 4) as overlap from q qualify row_number() over (partition by a_k order by overlap desc, b_k) = 1")
def shapes_largest_overlap(spark, d):
    return X.largest_overlap(*_layers(spark, d), "k", "k").withColumn("overlap", F.round("overlap", 4))


# A diamond in each box; grids and points are moved off its corners.
_D = "dm as (select k, (x0 + x1) / 2 as mx, (y0 + y1) / 2 as my, (x1 - x0) / 2 as rx, (y1 - y0) / 2 as ry from b)"


def _diamonds(spark, d):
    b = _boxes(spark, d).withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    p = lambda x, y: F.array(F.col(x), F.col(y))
    return b.select("k", F.array(F.array(F.array(p("mx", "y0"), p("x1", "my"), p("mx", "y1"), p("x0", "my"), p("mx", "y0")))).alias("shape"))


@query(f"with {_B}, {_D}, {_C} select dm.k, count(c.k) as points, coalesce(round(sum(v), 4), 0) as sum_v from dm left join c on abs(x + 0.0137 - mx) <= rx and abs(y + 0.0071 - my) <= ry and abs(x + 0.0137 - mx) / rx + abs(y + 0.0071 - my) / ry < 1 group by dm.k")
def points_in_polygons(spark, d):
    c = _customers(spark, d).withColumns({"x": F.col("x") + 0.0137, "y": F.col("y") + 0.0071})
    return X.count_points(c, _diamonds(spark, d), "k", "x", "y", "v").select("k", "points", F.round("sum_v", 4).alias("sum_v"))


_RUNS = "cell as (select k, mx, my, rx, ry, unnest(range(floor((1000.0071 - my - ry) / 5)::bigint, floor((1000.0071 - my + ry) / 5)::bigint + 1)) as \"row\" from dm), px as (select *, unnest(range(floor((mx - rx - 0.0137) / 5)::bigint, floor((mx + rx - 0.0137) / 5)::bigint + 1)) as col from cell), hit as (select k, \"row\", col from px where abs(0.0137 + (col + 0.5) * 5 - mx) / rx + abs(1000.0071 - (\"row\" + 0.5) * 5 - my) / ry < 1)"


@query(f'with {_B}, {_D}, {_RUNS} select "row", col, max(k) as value, count(*) as n from hit group by all')
def rasterise_polygons(spark, d):
    return X.rasterise(_diamonds(spark, d), "k", 0.0137, 1000.0071, 5.0)


@query(f'with {_B}, {_D}, {_RUNS}, {_G} select "row", col, round(z, 6) as z from g where ("row" + 100, col + 60) in (select ("row", col) from hit)')
def clip_raster(spark, d):
    g = _grid(spark, d).withColumns({"row": F.col("row") + 100, "col": F.col("col") + 60})
    return X.clip_pixels(g, _diamonds(spark, d), "k", 0.0137, 1000.0071, 5.0).select((F.col("row") - 100).alias("row"), (F.col("col") - 60).alias("col"), F.round("z", 6).alias("z"))


@query(f'with {_B}, {_D}, {_RUNS}, {_G} select count(*) as pixels from g where ("row" + 100, col + 60) not in (select ("row", col) from hit)')
def mask_raster(spark, d):
    g = _grid(spark, d).withColumns({"row": F.col("row") + 100, "col": F.col("col") + 60})
    return X.clip_pixels(g, _diamonds(spark, d), "k", 0.0137, 1000.0071, 5.0, invert=True).agg(F.count("*").alias("pixels"))


@query(f"with {_B} select k, (least(x1, 600) - greatest(x0, 200)) * (least(y1, 700) - greatest(y0, 150)) as area from b where x1 > 200 and x0 < 600 and y1 > 150 and y0 < 700")
def clip_features(spark, d):
    mask = _shapes(spark.createDataFrame([(1, 200.0, 150.0, 600.0, 700.0)], "mask int, x0 double, y0 double, x1 double, y1 double"))
    return V.overlay(_shapes(_boxes(spark, d).select("k", "x0", "y0", "x1", "y1")), mask, "clip", "k", 64.0).select("k", F.round(G.shape_area(F.col("shape")), 6).alias("area"))


@query(f"""with {_B}, {_CELLS}, one as (select k, null::bigint as b_k, count(*)::double as area from ca where (x, y) not in (select (x, y) from cb) group by k),
two as (select null::bigint as k, k as b_k, count(*)::double as area from cb where (x, y) not in (select (x, y) from ca) group by 2) select * from one union all select * from two""")
def overlay_symmetric(spark, d):
    s = _shapes(_boxes(spark, d).select("k", "x0", "y0", "x1", "y1"))
    u = V.overlay(s.where("k % 2 = 0"), s.where("k % 2 = 1"), "symmetric", "k", 64.0)
    return u.select("k", "b_k", F.round(G.shape_area(F.col("shape")), 3).alias("area"))


@query(f"""with recursive {_G}, t as (select "row", col, cls % 3 as c, "row" * 2147483648 + col as id from g), e as (select a.id as a, b.id as b from t a join t b on a.c = b.c and abs(a."row" - b."row") + abs(a.col - b.col) = 1),
reach(a, b) as (select id, id from t union select r.a, e.b from reach r join e on r.b = e.a), l as (select a as id, min(b) as region from reach group by 1),
deg as (select t.id, 4 - count(e.b) as sides from t left join e on e.a = t.id group by 1)
select region, c, count(*) as pixels, count(*) * 4.0::double as area, sum(sides)::double * 2 as perimeter from t join l using (id) join deg using (id) group by region, c""")
def region_polygons(spark, d):
    g = _grid(spark, d).withColumn("c", F.col("cls") % 3)
    out = X.region_outlines(R.connected_regions(g, "c"), "c", 0.0, 0.0, 2.0)
    return out.select("region", "c", "pixels", F.round(G.shape_area(F.col("shape")), 6).alias("area"), F.round(G.shape_length(F.col("shape")), 6).alias("perimeter"))


@query()
def contour_lines(spark, d):
    """Contours as lines: of each level how many are closed, and their length (that of the segments)."""
    lines = X.contour_lines(R.contour_segments(_grid(spark, d), "z", 0.1))
    return lines.groupBy(F.round("level", 6).alias("level")).agg(F.count("*").alias("lines"), F.count(F.when(F.col("closed"), 1)).alias("closed"), F.round(F.sum("length"), 4).alias("length"))


# --- Single shapes ---------------------------------------------------------------------------------------------------


def _ring(*points):
    return F.array(*(F.array(x.cast("double") if not isinstance(x, str) else F.col(x), y.cast("double") if not isinstance(y, str) else F.col(y)) for x, y in points))


@query(f"with {_B} select k, 5 as corners, (x1 - x0) * (y1 - y0) as area from b")
def simplify_rings(spark, d):
    """Points on straight sides go, corners stay."""
    m = (F.col("x0") + F.col("x1")) / 2
    s = _boxes(spark, d).select("k", F.array(F.array(_ring(("x0", "y0"), (m, "y0"), ("x1", "y0"), ("x1", "y1"), (m, "y1"), ("x0", "y1"), ("x0", "y0")))).alias("shape"))
    return V.simplify(s, 0.01).select("k", F.size(F.col("shape")[0][0]).alias("corners"), F.round(G.shape_area(F.col("shape")), 6).alias("area"))


@query(f"with {_B} select k, (x1 - x0) * (y1 - y0) / 2 as area from b")
def repair_bowties(spark, d):
    """A ring that crosses itself becomes its two halves."""
    s = _boxes(spark, d).select("k", F.array(F.array(_ring(("x0", "y0"), ("x1", "y1"), ("x1", "y0"), ("x0", "y1"), ("x0", "y0")))).alias("shape"))
    return V.repair(s).select("k", F.round(G.shape_area(F.col("shape")), 6).alias("area"))


@query(f"with {_B} select k, round((x1 - x0) * (y1 - y0) * 7 / 8, 6) as area from b")
def hull_of_features(spark, d):
    """The hull of a box without its upper right quarter."""
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    s = _boxes(spark, d).select("k", F.array(F.array(_ring(("x0", "y0"), ("x1", "y0"), ("x1", my), (mx, my), (mx, "y1"), ("x0", "y1"), ("x0", "y0")))).alias("shape"))
    closed = V.convex_hulls(s).withColumn("r", F.col("shape")[0][0])
    return closed.select("k", F.round(F.abs(G.ring_area(F.concat("r", F.slice("r", 1, 1)))), 6).alias("area"))


def _pairs_of_boxes(spark, d):
    """Each box and a copy of it further up, as two parts."""
    up = lambda y: F.col(y) + 1000
    b = _boxes(spark, d)
    return b.select("k", F.array(F.array(_ring(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))), F.array(_ring(("x0", up("y0")), ("x1", up("y0")), ("x1", up("y1")), ("x0", up("y1")), ("x0", up("y0"))))).alias("shape"))


@query(f"with {_B} select k, unnest([1, 2]) as part, (x1 - x0) * (y1 - y0) as area from b")
def multipart_to_single(spark, d):
    return V.explode_parts(_pairs_of_boxes(spark, d)).select("k", "part", F.round(G.shape_area(F.col("shape")), 6).alias("area"))


@query(f"with {_B} select k, 2 as lines, 4 * (x1 - x0 + y1 - y0) as length from b")
def polygons_as_lines(spark, d):
    return V.polygons_to_lines(_pairs_of_boxes(spark, d)).select("k", F.size("shape").alias("lines"), F.round(G.shape_length(F.col("shape")), 6).alias("length"))


@query(f"with {_B} select k, round_even(2 * (x1 - x0) * (y1 - y0) / 10000, 4) as area_ha from b")
def lines_as_polygons(spark, d):
    return V.lines_to_polygons(V.polygons_to_lines(_pairs_of_boxes(spark, d))).select("k", "area_ha")


@query(f"with {_B} select k, x0, y0, x1, y1 + 1000 as y1 from b union all select null, min(x0), min(y0), max(x1), max(y1) + 1000 from b")
def bounding_boxes(spark, d):
    """Of each feature, and (k null) of the layer."""
    s = _pairs_of_boxes(spark, d)
    return V.boxes(s).select("k", *(F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1"))).unionByName(V.layer_box(s).withColumn("k", F.lit(None).cast("long")))


@query(f"with {_B} select k, true as inside from b")
def inside_points(spark, d):
    """A point that is sure to lie in each diamond."""

    def one(parts):
        x, y = G.inside_point(parts)
        return [[[[x, y]]]]

    p = V.map_shapes(_diamonds(spark, d), one).select("k", F.col("shape")[0][0][0].alias("p"))
    return _diamonds(spark, d).join(p, "k").select("k", G.contains_point(F.col("shape"), F.col("p")[0], F.col("p")[1]).alias("inside"))


@query(f"with {_B}, {_C} select 'boxes' as source_layer, count(*) as n, count(cls) as with_class from b union all select 'points', count(*), 0 from c")
def merged_layers(spark, d):
    m = V.merge_layers({"boxes": _boxes(spark, d).select("k", "cls"), "points": _customers(spark, d).select("k", "v")})
    return m.groupBy("source_layer").agg(F.count("*").alias("n"), F.count("cls").alias("with_class"))


@query("""with p as (select kind, point_id, lat, lon, lag(lat) over w as a, lag(lon) over w as o from points where not (lat::varchar = 'nan') and not (lon::varchar = 'nan') and abs(lat) <= 90 and abs(lon) <= 180 and fetch_id is not null window w as (partition by fetch_id order by point_id)),
s as (select point_id, coalesce(2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * power(sin(radians(lon - o) / 2), 2)))), 0) as step from p)
select points.point_id, round(sum(step) over (partition by fetch_id order by points.point_id), 2) as metres from s join points using (point_id)""")
def path_lengths(spark, d):
    """Metres along the path of each fetch's points."""
    p = read(spark, d, "points").where("not isnan(lat) and not isnan(lon) and abs(lat) <= 90 and abs(lon) <= 180 and fetch_id is not null")
    return V.path_profile(p, "fetch_id", "point_id", "lon", "lat").select("point_id", F.round("metres", 2).alias("metres"))


@query("select unnest(range(3))::int as term, unnest([5.0, 2.0, 3.0])::double as x, unnest([-7.0, 1.5, -4.0])::double as y")
def georeference_terms(spark, d):
    """Control points made with known coefficients give them back."""
    got = [(r.n_nationkey, r.n_nationkey**2 % 17) for r in read(spark, d, "nation").orderBy("n_nationkey").limit(25).collect()]
    fit = V.georeference_fit([(c, r, 5 + 2 * c + 3 * r, -7 + 1.5 * c - 4 * r) for c, r in got])
    return spark.createDataFrame([(i, round(x, 6), round(y, 6)) for i, (x, y) in enumerate(fit["coefficients"])], "term int, x double, y double")


# --- Rasters ---------------------------------------------------------------------------------------------------------

_GAUSS = "w as (select i, exp(-0.5 * i * i) as w from range(-4, 5) t(i)), sm as (select a.\"row\", a.col, any_value(a.z) as z, sum(b.z * x.w * y.w) / sum(x.w * y.w) as s from g a join g b on abs(a.\"row\" - b.\"row\") <= 4 and abs(a.col - b.col) <= 4 join w x on x.i = b.\"row\" - a.\"row\" join w y on y.i = b.col - a.col group by all)"


@query(f'with {_G}, {_GAUSS} select "row", col, round(z + 1.0 * (z - s), 6) as sharp from sm')
def enhance_sharpen(spark, d):
    return R.sharpen(_grid(spark, d), "z").withColumn("sharp", F.round("sharp", 6))


@query(f'with {_G} select "row", col, round(power(least(1, greatest(0, z)), 1 / 2.2), 6) as gamma from g')
def enhance_gamma(spark, d):
    return _grid(spark, d).select("row", "col", F.round(R.gamma(F.col("z"), 2.2), 6).alias("gamma"))


@query(f'with {_G} select a."row", a.col, round(sum(case when a."row" = b."row" and a.col = b.col then -4 * b.z else b.z end), 6) as laplace from g a join g b on abs(a."row" - b."row") + abs(a.col - b.col) <= 1 group by all')
def focal_laplace(spark, d):
    return R.kernel_filter(_grid(spark, d), "z", R.LAPLACE, name="laplace").withColumn("laplace", F.round("laplace", 6))


@query(f'with {_G} select a."row", a.col, round(median(b.z), 7) as median from g a join g b on abs(a."row" - b."row") <= 1 and abs(a.col - b.col) <= 1 group by all')
def focal_median3(spark, d):
    return R.focal(_grid(spark, d), "z", 3, "median", name="median").withColumn("median", F.round("median", 7))


@query(f"""with {_G}, o as (select o, abs((o + 0.5) / 2 - 0.5) as t from range(-6, 10) r(o)), k as (select o, case when t = 0 then 1 when t >= 3 then 0 else 3 * sin(pi() * t) * sin(pi() * t / 3) / power(pi() * t, 2) end as w from o),
s as (select g."row" * 2 + a.o as "row", g.col * 2 + b.o as col, z, a.w * b.w as w from g, k a, k b), e as (select max("row") * 2 + 1 as r1, max(col) * 2 + 1 as c1 from g)
select "row", col, round(sum(z * w) / sum(w), 6) as z from s, e where "row" between 0 and r1 and col between 0 and c1 group by all""")
def resample_lanczos(spark, d):
    return R.refine(_grid(spark, d).select("row", "col", "z"), 2, ["z"], "lanczos").withColumn("z", F.round("z", 6))


@query("select count(*) as pixels, count(*) filter (" + " and ".join(f"{b} is not null and {b}::varchar not in ('nan', 'inf', '-inf')" for b in ("b02", "b08")) + ") as complete from pixels")
def finite_pixels(spark, d):
    return read(spark, d, "pixels").agg(F.count("*").alias("pixels"), F.count(F.when(R.all_finite(["b02", "b08"]), 1)).alias("complete"))


_BAND = lambda b: f"case when {b}::varchar = 'nan' then null else {b} end"


@query(f"with p as (select sample_id, {_BAND('b03')} as g, {_BAND('b04')} as r, {_BAND('b08')} as n from pixels), v as (select sample_id, round((n - r) / nullif(n + r, 0), 6) as ndvi, round((g - n) / nullif(g + n, 0), 6) as ndwi from p) select * from v")
def index_columns(spark, d):
    v = with_indices(read(spark, d, "pixels"), {"B03": "b03", "B04": "b04", "B08": "b08"}, ["NDVI", "NDWI"])
    return v.select("sample_id", F.round("NDVI", 6).alias("ndvi"), F.round("NDWI", 6).alias("ndwi"))


@query("select l_orderkey % 64 as qa, (l_orderkey % 64) & 31 = 0 as clear, count(*) as n from lineitem group by all")
def landsat_mask(spark, d):
    q = read(spark, d, "lineitem").select((F.col("l_orderkey") % 64).alias("qa"))
    return q.groupBy("qa", landsat_clear(F.col("qa")).alias("clear")).agg(F.count("*").alias("n"))


@query("""with p as (select l_orderkey // 2 // 4 as "row", l_linenumber // 4 as col, avg(power(l_quantity, 2) / power(l_tax + 1, 2)) as p from lineitem group by all) select "row", col, round(10 * log10(p), 6) as db from p""")
def sigma_nought(spark, d):
    px = read(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 2).alias("row"), F.col("l_linenumber").alias("col"), "l_quantity", (F.col("l_tax") + 1).alias("gain"))
    return backscatter(px, "l_quantity", "gain").select("row", "col", F.round("sigma0_db", 6).alias("db"))


@query("select scene_id, 'S2A' as mission, 'L2A' as level, '43P' || chr((65 + scene_id % 20)::int) || 'Q' as tile, strptime('20240115T051' || (scene_id % 10)::varchar || '00', '%Y%m%dT%H%M%S') as sensed from scenes")
def product_parts(spark, d):
    s = read(spark, d, "scenes")
    name = F.concat(F.lit("S2A_MSIL2A_20240115T051"), (F.col("scene_id") % 10).cast("string"), F.lit("00_N0510_R019_T43P"), F.chr(65 + F.col("scene_id") % 20), F.lit("Q_20240115T090000.SAFE"))
    p = product_names(s.select("scene_id", name.alias("name")), "name")
    return p.select("scene_id", "mission", "level", "tile", F.col("sensed").cast("timestamp_ntz").alias("sensed"))


# --- Tables ----------------------------------------------------------------------------------------------------------


@query("select c_custkey, (select count(*) from customer) as total, (select count(*) from customer where c_acctbal > 5000) as filtered from customer where c_acctbal > 5000 order by c_acctbal desc, c_custkey limit 20 offset 10")
def page_totals(spark, d):
    return T.page_view(read(spark, d, "customer"), 10, 20, "c_acctbal > 5000", "c_acctbal", True, ["c_custkey"]).select("c_custkey", "total", "filtered")


@query("select o_orderkey, round(o_totalprice / 1000, 6) as value from orders order by o_orderkey limit 8")
def preview_rows(spark, d):
    return T.preview(read(spark, d, "orders").where("o_orderkey is not null"), "round(o_totalprice / 1000, 6)", ties=["o_orderkey"]).select("o_orderkey", "value")


@query("with n as (select p_partkey, 'item ' || p_partkey::varchar as label from part) select label, row_number() over (order by p_partkey) as place from n")
def natural_order(spark, d):
    """item 9 comes before item 10."""
    from pyspark.sql import Window

    p = read(spark, d, "part").select(F.concat(F.lit("item "), F.col("p_partkey").cast("string")).alias("label"))
    first = T.natural_sort(p, "label").limit(5000)  # as a page would
    rank = F.row_number().over(Window.orderBy(T.natural_key(F.col("label"))))
    return first.withColumn("place", rank)


_MED = lambda c: f"(select {c} from (select {c}, row_number() over (order by {c}) - 1 as i, count(*) over () as n from part where {c} is not null) where i = n // 2)"


@query(" union all ".join(f"select '{c}' as \"column\", count({c}) as n, count(*) - count({c}) as missing, min({c})::double as min, max({c})::double as max, round(avg({c}), 4) as mean, {_MED(c)}::double as median from part" for c in ("p_size", "p_retailprice")))
def attribute_statistics(spark, d):
    return T.attribute_profile(read(spark, d, "part"), ["p_size", "p_retailprice"]).withColumn("mean", F.round("mean", 4))


@query("select request_id from table_requests where per_class = 5 union all select request_id + 100000 from table_requests where sample_size >= 100")
def loose_filters(spark, d):
    r = read(spark, d, "table_requests").withColumn("text_size", F.col("sample_size").cast("string"))
    return T.loose_filter(r, "per_class = '5.0'").select("request_id").unionByName(T.loose_filter(r, "text_size >= 100").select((F.col("request_id") + 100_000).alias("request_id")))


@query("select 'p_size' as \"column\", 'integer' as kind, count(*) as rows, count(*) - count(p_size) as missing, true as integral, 'target' as role from part union all select 'p_type', 'text', count(*), count(*) - count(p_type), null, 'target' from part union all select 'p_retailprice', 'number', count(*), count(*) - count(p_retailprice), bool_and(p_retailprice = floor(p_retailprice)), 'feature' from part")
def column_roles(spark, d):
    return T.describe_columns(read(spark, d, "part"), ["p_size", "p_type", "p_retailprice"]).select("column", "kind", "rows", "missing", "integral", "role")


@query("select c_custkey as customer, c_name as name from customer")
def renamed_columns(spark, d):
    return T.rename_columns(read(spark, d, "customer"), {"c_custkey": "customer", "c_name": "name"}).select("customer", "name")


@query("select label_code, least(50, count(*)) as n from pixels where label_code is not null group by 1")
def exact_samples(spark, d):
    """Exactly so many pixels of each class."""
    return M.exact_per_class(read(spark, d, "pixels"), "label_code", 50, "sample_id").groupBy("label_code").agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n from events where value >= 50 group by 1")
def counts_over_threshold(spark, d):
    """Detections of each class above a score."""
    return T.count_by(read(spark, d, "events"), ["event_type"], F.col("value") >= 50)


@query("select category, lang, count(*) as n from documents group by all")
def entries_by_section(spark, d):
    return T.count_by(read(spark, d, "documents"), ["category", "lang"])


@query("select 'points' as sample, (select least(25, count(*)) from part)::bigint as n, true as ok union all select 'bernoulli', null, true union all select 'stratified', null, true")
def sample_rules(spark, d):
    """An exact sample has its size; a share or a number a class holds within six standard deviations."""
    p, e = read(spark, d, "part"), read(spark, d, "events")
    size = T.sample_rows(p, 25, "p_partkey").agg(F.lit("points").alias("sample"), F.count("*").alias("n"), F.lit(True).alias("ok"))
    none = F.lit(None).cast("long")
    few = T.bernoulli(e, 400, "event_id").agg(F.lit("bernoulli").alias("sample"), none.alias("n"), (F.abs(F.count("*") - 400) < 120).alias("ok"))
    each = T.stratified(e, "event_type", 60, "event_id").groupBy("event_type").agg(F.count("*").alias("k")).agg(F.lit("stratified").alias("sample"), none.alias("n"), F.bool_and(F.abs(F.col("k") - 60) < 47).alias("ok"))
    return size.unionByName(few).unionByName(each)


@query("select event_type, count(*) as n, true as ok from events group by 1")
def stratified_split_rules(spark, d):
    """A quarter of every class is test, within six standard deviations."""
    s = L.stratified_split(read(spark, d, "events"), "event_type", "event_id", 0.25)
    g = s.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("t"))
    return g.select("event_type", "n", (F.abs(F.col("t") - 0.25 * F.col("n")) < 6 * F.sqrt(0.1875 * F.col("n"))).alias("ok"))


# --- Statistics and codecs -------------------------------------------------------------------------------------------


@query("with t as (select corr(l_quantity, l_extendedprice) as r1, corr(l_quantity, l_discount) as r2, corr(l_extendedprice, l_discount) as r3 from lineitem) select 'twice' as dropped union all select 'l_extendedprice' from t where abs(r1) >= 0.6 union all select 'constant'")
def correlated_pruning(spark, d):
    """Constant columns, and later ones of pairs that go together."""
    df = read(spark, d, "lineitem").select("l_quantity", (2 * F.col("l_quantity")).alias("twice"), "l_extendedprice", "l_discount", F.lit(1.0).alias("constant"))
    return spark.createDataFrame([(c,) for c in A.correlated_columns(df, df.columns, 0.6)], "dropped string")


_KNOWN = "px as (select label_code as c, b02, b08 from pixels where label_code is not null and b02 is not null and b08 is not null and b02::varchar <> 'nan' and b08::varchar <> 'nan' and b02 <> -9999 and b08 <> -9999)"


@query(f"""with {_KNOWN}, m as (select c, count(*) as n, avg(b02) as a, avg(b08) as b from px group by 1), w as (select c, sum(power(b02 - a, 2) + power(b08 - b, 2)) as w, avg(sqrt(power(b02 - a, 2) + power(b08 - b, 2))) as s from px join m using (c) group by 1),
g as (select count(*) as t, avg(b02) as a, avg(b08) as b from px), ch as (select sum(w) as inertia, sum(n * (power(m.a - g.a, 2) + power(m.b - g.b, 2))) as between_, count(*) as k, max(t) as t from m join w using (c), g),
db as (select x.c, max((wx.s + wy.s) / sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2))) as r from m x join m y on x.c <> y.c join w wx on wx.c = x.c join w wy on wy.c = y.c group by 1)
select round(inertia, 5) as inertia, round(between_ / (k - 1) / (inertia / (t - k)), 4) as calinski_harabasz, (select round(avg(r), 5) from db) as davies_bouldin from ch""")
def cluster_scores(spark, d):
    df = R.pixel_table(read(spark, d, "pixels"), ["b02", "b08"]).where("label_code is not null").select(F.col("label_code").alias("c"), "b02", "b08")
    q = L.cluster_quality(df, "c", ["b02", "b08"])
    return q.select(F.round("inertia", 5).alias("inertia"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 5).alias("davies_bouldin"))


@query("with e as (select vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings), s as (select i, max(abs(x)) / 127 as s from e group by 1) select vec_id, round(max(abs(x - round_even(x / s, 0) * s)), 6) as worst from e join s using (i) group by 1")
def linear_codec(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    scales = L.linear_scales(e, "v")
    back = F.zip_with(L.encode_linear(F.col("v"), scales), F.array(*map(F.lit, scales)), lambda q, s: q * s)
    return e.select("vec_id", F.round(F.array_max(F.zip_with("v", back, lambda a, b: F.abs(a - b))), 6).alias("worst"))


@query("select round(avg(value), 6) as mean, round(median(value), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(avg((value > 0.9)::int), 6) as over_09 from events")
def score_summary(spark, d):
    s = L.similarity_summary(read(spark, d, "events"), "value")
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query("with v as (select ln(1 + value) as y from events) select round(avg(y), 6) as mean, round(stddev_pop(y), 6) as std from v")
def power_transform(spark, d):
    """The power transform with exponent 0 is the logarithm of 1 + x."""
    y = read(spark, d, "events").select(L.yeo_johnson(F.col("value"), 0.0).alias("y"))
    return y.agg(F.round(F.avg("y"), 6).alias("mean"), F.round(F.stddev_pop("y"), 6).alias("std"))


@query("""with e as (select value, unnest(range(25)) as i from events), l as (select -2 + 0.25 * i as lam, case when -2 + 0.25 * i = 0 then ln(1 + value) else (power(1 + value, -2 + 0.25 * i) - 1) / (-2 + 0.25 * i) end as y, ln(1 + value) as j from e)
select round(lam, 2)::double as exponent from l group by lam order by -0.5 * ln(var_pop(y)) + (lam - 1) * avg(j) desc limit 1""")
def power_exponent(spark, d):
    """The likeliest exponent on the grid."""
    return spark.createDataFrame([(L.fit_yeo_johnson(read(spark, d, "events"), "value"),)], "exponent double")


# --- Series, texts, detections ---------------------------------------------------------------------------------------

_NEARS = "nr as (select a.event_type as key, b.event_type as near, 1.0 / (1 + abs(length(a.event_type) - length(b.event_type))) as weight from (select distinct event_type from events) a join (select distinct event_type from events) b on a.event_type <> b.event_type)"


@query(f"with {_PANEL}, {_NEARS}, b as (select event_type, step, lag(v) over (partition by event_type order by step) as v from panel), j as (select key, step, sum(weight * v) / sum(weight) as m from nr join b on b.event_type = near where v is not null group by all) select p.event_type, p.step, round(m, 9) as v_near from panel p left join j on j.key = p.event_type and j.step = p.step")
def neighbour_means(spark, d):
    """The weighted mean of the other series one step before."""
    p = _panel(spark, d)
    t = p.select("event_type").distinct()
    near = t.select(F.col("event_type").alias("key")).join(t.select(F.col("event_type").alias("near")), F.col("key") != F.col("near"))  # five series
    near = near.withColumn("weight", 1.0 / (1 + F.abs(F.length("key") - F.length("near"))))
    return S.neighbour_average(p, "event_type", "step", "v", near).select("event_type", "step", F.round("v_near", 9).alias("v_near"))


@query("select p_partkey, upper(substr(t, 1, 1)) || substr(t, 2) as label from (select p_partkey, trim(regexp_replace(lower(replace(p_type, ' ', '_')), '[_\\s]+', ' ', 'g')) as t from part)")
def label_texts(spark, d):
    return read(spark, d, "part").select("p_partkey", W.label_text(F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))).alias("label"))


@query("""with n as (select n_nationkey, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) as k from nation) select n_nationkey, case when k = 'uk' then 'United Kingdom' when k = 'china' then 'China' when k = 'united kingdom' then 'United Kingdom' when k = 'india' then 'India'
when contains(k, 'china') or (contains('china', k) and k <> '') then 'China' when contains(k, 'united kingdom') or (contains('united kingdom', k) and k <> '') then 'United Kingdom' when contains(k, 'india') or (contains('india', k) and k <> '') then 'India' end as name from n""")
def matched_names(spark, d):
    return read(spark, d, "nation").select("n_nationkey", W.match_name(F.col("n_name"), ["China", "United Kingdom", "India"], {"UK": "United Kingdom"}).alias("name"))


@query("select station, round(case when lat < 0 then -(floor(abs(lat)) + floor((abs(lat) - floor(abs(lat))) * 60) / 60) else floor(abs(lat)) + floor((abs(lat) - floor(abs(lat))) * 60) / 60 end, 7) as degrees from stations")
def exif_degrees(spark, d):
    a = F.abs("lat")
    minutes = F.floor((a - F.floor(a)) * 60)
    return read(spark, d, "stations").select("station", W.dms_degrees(F.floor(a), minutes, F.lit(0.0), F.when(F.col("lat") < 0, "S").otherwise("N")).alias("degrees"))


_WORDS = "list_distinct(string_split(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), ' '))"


@query(f"with q as (select item_id, len(list_intersect({_WORDS}, ['what', 'crop', 'water', 'soil', 'which', 'the'])) as shared from eval_items where question is not null) select item_id, shared from q where shared > 0 order by shared desc, item_id limit 10")
def ranked_skills(spark, d):
    return W.shared_words(read(spark, d, "eval_items"), "question", "what crop, water - soil: which the", "item_id", 10).select("item_id", "shared")


@query("with r as (select o_orderkey as id, o_orderstatus as status, o_orderdate as finished, o_orderpriority as request from orders where o_orderstatus = 'F') select id from r where contains(lower(request), 'urgent') order by finished desc, id limit 200")
def run_search(spark, d):
    r = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("finished"), F.col("o_orderpriority").alias("request"))
    return W.log_search(r, "URGENT", "F").select("id")


@query(f"""with {_B}, c as (select k, x0, y0, x1, y1, unnest(range(greatest(0, ceil((x0 - 200) / 150)::bigint), floor(x1 / 150)::bigint + 1)) as tcol from b), t as (select *, unnest(range(greatest(0, ceil((y0 - 200) / 150)::bigint), floor(y1 / 150)::bigint + 1)) as trow from c),
p as (select *, greatest(x0, tcol * 150) as a0, least(x1, tcol * 150 + 200) as a1, greatest(y0, trow * 150) as b0, least(y1, trow * 150 + 200) as b1 from t)
select k, trow, tcol, round(((a0 + a1) / 2 - tcol * 150) / 200, 6) as cx, round(((b0 + b1) / 2 - trow * 150) / 200, 6) as cy, round((a1 - a0) / 200, 6) as w, round((b1 - b0) / 200, 6) as h from p where a1 > a0 and b1 > b0 and (a1 - a0) * (b1 - b0) / ((x1 - x0) * (y1 - y0)) >= 0.4""")
def tiled_labels(spark, d):
    t = D.tile_boxes(_boxes(spark, d), 200.0, 0.25)
    return t.select("k", "trow", "tcol", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")))


@query("select case when p_size < 10 then 'too small' when p_partkey % 100 < 5 then 'too dark' when p_partkey % 100 > 95 then 'too bright' when p_size < 12 then 'no detail' when p_size < 15 then 'blurry' end as issue, count(*) as n from part group by 1")
def photo_gates(spark, d):
    p, k = F.col("p_size"), F.col("p_partkey") % 100
    issue = D.photo_issue(F.when(p < 10, 50).otherwise(500), F.when(k < 5, 10).otherwise(100), F.when(k > 95, 250).otherwise(120), F.when(p < 12, 2).otherwise(50), F.when(p < 15, 20).otherwise(100))
    return read(spark, d, "part").groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


@query(f"with {_B} select k, round(((x1 - x0) * (y1 - y0)) / 10000 * 2 + k, 6) as value, round(2 * (x1 - x0 + y1 - y0), 6) as around from b")
def calculated_geometry(spark, d):
    """Geometry values in field expressions."""
    g = V.geometry_fields(_shapes(_boxes(spark, d).select("k", "x0", "y0", "x1", "y1")))
    out = calculate(calculate(g, "value", "[$area_ha] * 2 + [k]"), "around", "[$perimeter]")
    return out.select("k", F.round("value", 6).alias("value"), F.round("around", 6).alias("around"))


@query("select station, true as right_size from stations where abs(lat) < 80")
def own_zone_areas(spark, d):
    """Squares of 2 km around stations, measured in the UTM zone of each: 4 km2 within a percent."""
    s = V.point_squares(read(spark, d, "stations").where("abs(lat) < 80"), "lon", "lat", 1000.0)
    g = V.geometry_fields(s, lonlat=True)
    return g.select("station", (F.abs(F.col("$area_km2") / 4 - 1) < 0.01).alias("right_size"))


@query("select kind, n from (values ('box', 1), ('geojson', 1), ('point', 1)) t(kind, n)")
def areas_of_interest(spark, d):
    """An area given in three ways."""
    text = '{"type": "Polygon", "coordinates": [[[77, 12], [78, 12], [78, 13], [77, 12]]]}'
    each = {"box": V.area_of_interest(spark, box=(77, 12, 78, 13)), "geojson": V.area_of_interest(spark, geojson=text), "point": V.area_of_interest(spark, point=(77.5, 12.9))}
    out = None
    for name, df in each.items():
        row = df.agg(F.lit(name).alias("kind"), F.count("shape").cast("int").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""with recursive {_B}, e as (select a.k as a, c.k as b from b a join b c on a.cls = c.cls and a.k <> c.k and a.k % 4 <> c.k % 4 and a.x0 < c.x1 and c.x0 < a.x1 and a.y0 < c.y1 and c.y0 < a.y1 where (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) >= 0.5),
reach(a, b) as (select k, k from b union select r.a, e.b from reach r join e on r.b = e.a), l as (select a as k, min(b) as label from reach group by 1)
select label as k, cls, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, max(score) as score, count(*) as pieces from b join l using (k) group by 1, 2""")
def merged_pieces(spark, d):
    """Boxes that tiles have cut become one object."""
    return D.merge_cut(_boxes(spark, d).withColumn("tile", F.col("k") % 4), "k", "cls", "score", "tile", 64.0)


@query(f"with p as (select sample_id, {_BAND('b04')} as r, {_BAND('b08')} as n from pixels) select sample_id, round(sqrt(greatest(0, n)) + r, 6) as mixed, round((n - r) / nullif(n + r, 0), 6) as ndvi from p where n >= 0 and r is not null")
def index_export(spark, d):
    """A formula and a named index side by side."""
    px = read(spark, d, "pixels").where("b08 >= 0 and not isnan(b08) and b04 is not null and not isnan(b04)")
    s = index_stack(px, ["sample_id"], {"B04": "b04", "B08": "b08"}, {"mixed": "sqrt(B08) + B04", "ndvi": "NDVI"})
    return s.select("sample_id", F.round("mixed", 6).alias("mixed"), F.round("ndvi", 6).alias("ndvi"))


@query(f"""with recursive {_G}, t as (select "row", col, floor(z * 8)::int as c, "row" * 2147483648 + col as id from g), e as (select a.id as a, b.id as b from t a join t b on a.c = b.c and abs(a."row" - b."row") + abs(a.col - b.col) = 1),
reach(a, b) as (select id, id from t union select r.a, e.b from reach r join e on r.b = e.a), l as (select a as id, min(b) as region from reach group by 1)
select region, c, count(*) as pixels, count(*) * 100.0::double as area from t join l using (id) group by 1, 2 having count(*) >= 2""")
def classed_polygons(spark, d):
    """Values in equal classes as polygons of at least two pixels of 10 m."""
    g = _grid(spark, d).withColumn("c", F.floor(F.col("z") * 8).cast("int"))
    big = X.region_outlines(R.connected_regions(g, "c"), "c", 0.0, 0.0, 10.0).where("pixels >= 2")
    return big.select("region", "c", "pixels", F.round(G.shape_area(F.col("shape")), 6).alias("area"))


@query("with e as (select event_type, count(*) as n from events group by 1) select event_type || ',' || string_agg(case when o = event_type then n else 0 end::varchar, ',' order by o) as line from e, (select event_type as o from e) group by event_type, n")
def matrix_text(spark, d):
    """A confusion matrix as text, without its head line."""
    e = read(spark, d, "events").select("event_type", F.col("event_type").alias("again"))
    return spark.createDataFrame([(x,) for x in A.matrix_csv(A.confusion(e, "event_type", "again")).splitlines()[1:]], "line string")


_OKB = lambda b: f"case when {b}::varchar = 'nan' or {b} = -9999 then null else {b} end"


@query(" union all ".join(f"select '{b}' as band, min({_OKB(b)}) as min, max({_OKB(b)}) as max, round(avg({_OKB(b)}), 6) as mean, round(100.0 * (count(*) - count({_OKB(b)})) / count(*), 6) as empty_pct, null::varchar as warning from pixels" for b in ("b02", "b08")))
def band_description(spark, d):
    return T.describe_bands(read(spark, d, "pixels"), ["b02", "b08"]).select("band", "min", "max", F.round("mean", 6).alias("mean"), F.round("empty_pct", 6).alias("empty_pct"), "warning")


@query(f"with {_B}, q as (select count(*) as p, count(*) filter (k % 2 = 0) as t from b) select round(t / p, 6)::double as precision, round(t / t, 6)::double as recall, p as predicted, t as matched from q")
def detection_quality(spark, d):
    """Boxes against every second of them as the truth."""
    b = _boxes(spark, d)
    truth = b.where("k % 2 = 0")
    n, p, t = D.match_truth(b, truth, "k", "cls", "score", 64.0, 0.999999).count(), b.count(), truth.count()
    s = D.detection_scores(n, p, t)
    return spark.createDataFrame([(round(s["precision"], 6), round(s["recall"], 6), p, n)], "precision double, recall double, predicted long, matched long")
