"""The pN_ queries of the general problems (3, 4 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions.timeparse import wall_text
from loamgrid.operators.nearby import points_inside, points_near
from loamgrid.operators.regrid import reading_bounds, regular_grid, step_values, step_widths
from loamgrid.operators.rolling import trailing_totals
from loamgrid.storage import read


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_totals(read(spark, sf_dir, "rain_daily"), "gauge", "date_text", "rain", "received_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = _totals(spark, sf_dir).where((F.col("since") >= 29) & (4 * F.col("micro_7") > 3 * F.col("micro_30")))
    return hit.select(F.col("series").alias("gauge"), wall_text(F.col("day").cast("long") * 86400, minutes=False).alias("obs_day"))


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _totals(spark, sf_dir).select(
        F.col("series").alias("gauge"), wall_text(F.col("day").cast("long") * 86400, minutes=False).alias("obs_day"), r("total"), r("total_7"), r("mean_7"), r("total_30"), r("mean_30")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "points")
    near = points_near(points, "point_id", "lat", "lon", 100.0).select(F.lit("near").alias("kind"), "key_a", "key_b")
    inside = points_inside(points, "point_id", "lat", "lon", read(spark, sf_dir, "regions"), "region_id", "geojson")
    return near.unionByName(inside.select(F.lit("inside").alias("kind"), "key_a", "key_b"))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each usable point: how many others lie within 1 km, and the distance of the nearest of them."""
    pairs = points_near(read(spark, sf_dir, "points"), "point_id", "lat", "lon", 1000.0)
    both = pairs.select(F.explode(F.array("key_a", "key_b")).alias("point_id"), "metres")
    return both.groupBy("point_id").agg(F.count("*").alias("others"), F.round(F.min("metres"), 3).alias("nearest_m"))


def _steps(spark: SparkSession, sf_dir: str):
    widths = step_widths(read(spark, sf_dir, "stations"))
    readings = read(spark, sf_dir, "station_readings")
    return readings, widths, step_values(readings, widths, "station", "time_text", "aqi", "received_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regular_grid(_steps(spark, sf_dir)[2]).where("status <> 'observed'")
    return grid.select(F.col("series").alias("station"), wall_text(F.col("step") * F.col("width")).alias("period"))


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid: steps filled across gaps of up to 3, marked beyond, and extended to the last row."""
    readings, widths, values = _steps(spark, sf_dir)
    grid = regular_grid(values, 3, reading_bounds(readings, widths, "station", "time_text"))
    return grid.select(F.col("series").alias("station"), wall_text(F.col("step") * F.col("width")).alias("period"), F.round("value", 4).alias("value"), "status")


QUERIES = {f.__name__: f for f in (p3_found, p3_totals, p4_found, p4_neighbours, p5_found, p5_grid)}


def _parsed(text: str) -> str:
    """DuckDB expression of the wall-clock timestamp in ``text``."""
    clock = r"(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?)?\s*(?:Z|[+-]\d{2}(?::?\d{2})?)?\s*$"
    ask = lambda date, y, m, d: (
        f"try_cast(case when regexp_matches({text}, '{date}{clock}') then regexp_replace({text}, '{date}{clock}', '\\{y}-\\{m}-\\{d}') end || ' ' || "
        f"case when regexp_extract({text}, '{date}{clock}', 4) = '' then '00:00' else regexp_replace({text}, '{date}{clock}', '\\4:\\5') end || ':' || "
        f"lpad(regexp_extract({text}, '{date}{clock}', 6), 2, '0') as timestamp)"
    )
    return "coalesce(" + ", ".join((ask(r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 1, 2, 3), ask(r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", 3, 2, 1), ask(r"^\s*(\d{4})(\d{2})(\d{2})", 1, 2, 3))) + ")"


_P3 = f"""
with raw as (select upper(trim(gauge)) as g, {_parsed('date_text')} as ts, received_at,
    case when rain is null or (rain::varchar = 'nan') or rain = -999 then null else rain end as v from rain_daily),
last_sent as (select g, ts, v from raw where g <> '' and ts is not null
    qualify row_number() over (partition by g, ts order by received_at desc, v desc nulls last) = 1),
daily as (select g, ts::date as d, sum(round(v * 1000000)::hugeint) as micro from last_sent where v is not null group by all),
ends as (select g, min(d) as a, max(d) as b from daily group by g),
days as (select e.g, unnest(generate_series(e.a, e.b, interval 1 day))::date as d, e.a from ends e),
full_days as (select x.g, x.d, x.d - x.a as since, coalesce(y.micro, 0) as micro from days x left join daily y on x.g = y.g and x.d = y.d),
sums as (select g, d, since, micro, sum(micro) over (partition by g order by d rows 6 preceding) as m7,
    sum(micro) over (partition by g order by d rows 29 preceding) as m30 from full_days)
"""

_P5 = f"""
with widths as (select upper(trim(station)) as s, min(step_minutes) * 60 as width from stations group by 1),
raw as (select upper(trim(station)) as s, {_parsed('time_text')} as ts, received_at,
    case when aqi is null or (aqi::varchar = 'nan') or aqi = -999 then null else aqi end as v from station_readings),
readable as (select raw.*, width, floor(epoch(ts) / width)::bigint as step from raw join widths using (s) where ts is not null),
readings as (select * from readable where v is not null qualify row_number() over (partition by s, ts order by received_at desc, v desc) = 1),
vals as (select s, width, step, avg(v) as v from readings group by all),
ends as (select s, width, min(step) as a, max(step) as b from vals group by all),
span as (select s, min(step) as lo, max(step) as hi from readable group by s)
"""

ORACLE = {
    "p3_found": _P3 + "select g as gauge, strftime(d, '%Y-%m-%d') as obs_day from sums where since >= 29 and 4 * m7 > 3 * m30",
    "p3_totals": _P3 + """select g as gauge, strftime(d, '%Y-%m-%d') as obs_day, round(micro / 1e6, 6) as total, round(m7 / 1e6, 6) as total_7,
        round(m7 / 1e6 / least(7, since + 1), 6) as mean_7, round(m30 / 1e6, 6) as total_30, round(m30 / 1e6 / least(30, since + 1), 6) as mean_30 from sums""",
    "p5_found": _P5 + """, grid as (select s, width, unnest(generate_series(a, b)) as step from ends)
        select s as station, strftime(make_timestamp(step * width * 1000000), '%Y-%m-%dT%H:%M') as period
        from grid anti join vals using (s, step)""",
    "p5_grid": _P5 + """, grid as (select s, width, unnest(generate_series(least(lo, a), greatest(hi, b))) as step, a, b from ends join span using (s)),
        put as (select grid.*, vals.v from grid left join vals using (s, step)),
        near as (select *, last_value(v ignore nulls) over p as v0, max(case when v is not null then step end) over p as s0,
            first_value(v ignore nulls) over f as v1, min(case when v is not null then step end) over f as s1 from put
            window p as (partition by s order by step rows unbounded preceding), f as (partition by s order by step rows between current row and unbounded following))
        select s as station, strftime(make_timestamp(step * width * 1000000), '%Y-%m-%dT%H:%M') as period,
            round(case when v is not null then v when step between a and b and s1 - s0 - 1 <= 3 then v0 + (v1 - v0) * (step - s0) / (s1 - s0) end, 4) as value,
            case when v is not null then 'observed' when step < a or step > b then 'outside' when s1 - s0 - 1 <= 3 then 'filled' else 'missing' end as status
        from near""",
    "p4_found": """
with pts as (select point_id as k, lat, lon, radians(lat) as p, radians(lon) as l, floor(lat / 0.01)::int as band from points
    where not (lat::varchar = 'nan') and not (lon::varchar = 'nan') and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)),
near as (select a.k as ka, b.k as kb, 2 * 6371008.8 * asin(least(1.0, sqrt(power(sin((b.p - a.p) / 2), 2) + cos(a.p) * cos(b.p) * power(sin((b.l - a.l) / 2), 2)))) as m
    from (select *, unnest([band - 1, band, band + 1]) as near_band from pts) a join pts b on a.near_band = b.band and a.k < b.k),
r as (select region_id, geojson::json as g from regions),
part as (select region_id, unnest(case when g->>'type' = 'Polygon' then [from_json(g->'coordinates', '[[["DOUBLE"]]]')] when g->>'type' = 'MultiPolygon' then from_json(g->'coordinates', '[[[["DOUBLE"]]]]') end) as rings from r),
numbered as (select *, row_number() over () as n from part), ring as (select region_id, n, unnest(rings) as q from numbered),
edge as (select region_id, n, q[i][1] as x1, q[i][2] as y1, q[i + 1][1] as x2, q[i + 1][2] as y2 from (select *, unnest(range(1, len(q))) as i from ring)),
inside as (select distinct k, region_id from (select k, region_id, n from pts join edge on (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 group by all having count(*) % 2 = 1))
select 'near' as kind, ka as key_a, kb as key_b from near where m <= 100 union all select 'inside', k, region_id from inside""",
    "p4_neighbours": """
with pts as (select point_id as k, lat, lon, radians(lat) as p, radians(lon) as l, floor(lat / 0.01)::int as band from points
    where not (lat::varchar = 'nan') and not (lon::varchar = 'nan') and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)),
near as (select a.k as ka, b.k as kb, 2 * 6371008.8 * asin(least(1.0, sqrt(power(sin((b.p - a.p) / 2), 2) + cos(a.p) * cos(b.p) * power(sin((b.l - a.l) / 2), 2)))) as m
    from (select *, unnest([band - 1, band, band + 1]) as near_band from pts) a join pts b on a.near_band = b.band and a.k <> b.k)
select ka as point_id, count(*) as others, round(min(m), 3) as nearest_m from near where m <= 1000 group by ka""",
}
