"""Queries on tables, expressions, joins, windows and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.functions.airquality import sub_index, trailing_mean, with_aqi
from loamgrid.functions.curves import great_circle
from loamgrid.functions.expressions import FieldDialect, RasterDialect, calculate, cast_column, select_where
from loamgrid.functions.timeparse import clean_number
from loamgrid.functions.spectral import INDICES, index_column, reflectance
from loamgrid.operators import series as S
from loamgrid.operators import stats as A
from loamgrid.operators import tables as T
from loamgrid.operators import texts as X
from loamgrid.operators.joins import attribute_join
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


def _calc(spark, d, table, key, **fields):
    df = read(spark, d, table)
    dialect = FieldDialect(df.schema)
    return df.select(*key, *(dialect.compile(e).col.alias(n) for n, e in fields.items()))


# --- Flagship: index, classes, groups, page --------------------------------------------------------------------------


@query("""with v as (select l_returnflag, (l_quantity - l_extendedprice / 1000) / nullif(l_quantity + l_extendedprice / 1000, 0) as x from lineitem where l_discount > 0.02),
c as (select l_returnflag, x, case when x < -0.6 then 1 when x < -0.2 then 2 when x < 0.2 then 3 when x < 0.6 then 4 else 5 end as class from v where x is not null)
select l_returnflag, class, count(*) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from c group by all""")
def flagship_index_classes(spark, d):
    df = T.filter_rows(read(spark, d, "lineitem"), "l_discount > 0.02")
    x = index_column("NDVI", {"B08": F.col("l_quantity"), "B04": F.col("l_extendedprice") / 1000})
    v = df.select("l_returnflag", x.alias("x")).where("x is not null")
    return v.groupBy("l_returnflag", A.classify(F.col("x"), [-1, -0.6, -0.2, 0.2, 0.6, 1]).alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


# --- Filters and browsing --------------------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 400000")
def table_filter_num(spark, d):
    return T.filter_rows(read(spark, d, "orders"), "o_totalprice >= 400000").select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority < '2'")
def table_filter_text(spark, d):
    return T.filter_rows(read(spark, d, "orders"), "o_orderpriority < '2'").select("o_orderkey", "o_orderpriority")


@query("select p_partkey, p_name from part where contains(lower(p_partkey::varchar || '|' || p_name || '|' || p_brand || '|' || p_type || '|' || p_size::varchar), 'brass')")
def table_search_all(spark, d):
    return T.search_rows(read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "Brass").select("p_partkey", "p_name")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus <> 'F' order by o_totalprice desc nulls last, o_orderkey limit 100 offset 200")
def sort_page(spark, d):
    return T.page(read(spark, d, "orders"), 200, 100, "o_orderstatus != F", "o_totalprice", True, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("select c_custkey from customer where (c_nationkey in (1, 2, 3) or lower(c_mktsegment) = 'building') and c_acctbal > 100 and not c_custkey = 7")
def where_in(spark, d):
    return select_where(read(spark, d, "customer"), "(c_nationkey in (1, 2, 3) or c_mktsegment = building) and C_ACCTBAL > 100 and not c_custkey = 7").select("c_custkey")


@query("select p_partkey from part where lower(p_type) like '%steel%' or contains(lower(p_name), 'red')")
def where_like(spark, d):
    return select_where(read(spark, d, "part"), "p_type like '%Steel%' or contains(p_name, 'Red')").select("p_partkey")


@query("select request_id from table_requests where per_class is null or per_class <> 5")
def where_null(spark, d):
    return select_where(read(spark, d, "table_requests"), "per_class = null or per_class != 5").select("request_id")


# --- Field calculator ------------------------------------------------------------------------------------------------


@query("""select o_orderkey, round_even(o_totalprice * 1.5 / 7, 2) as a, floor(o_totalprice / 1000) as b, o_totalprice - 7 * floor(o_totalprice / 7) as c, round(power(o_totalprice, 0.5), 6) as e,
(case when o_totalprice > 200000 then 1 else -1 end)::double as f, o_totalprice / nullif(o_orderkey % 3, 0) as g from orders""")
def calc_arith(spark, d):
    return _calc(spark, d, "orders", ["o_orderkey"], a="round([o_totalprice] * 1.5 / 7, 2)", b="o_totalprice // 1000", c="o_totalprice % 7", e="round(o_totalprice ^ 0.5, 6)", f="1 if o_totalprice > 200000 else -1", g="o_totalprice / (o_orderkey % 3)")


@query("""select p_partkey, upper(p_name) as a, p_brand || '-' || p_size::varchar as b, length(trim(p_type))::double as c, replace(p_type, ' ', '_') as e, substr(p_name, 2, 4) as f, contains(lower(p_type), 'tin') as g from part""")
def calc_text(spark, d):
    return _calc(spark, d, "part", ["p_partkey"], a="upper(p_name)", b="p_brand + '-' + p_size", c="len(strip(p_type))", e="replace(p_type, ' ', '_')", f="substr(p_name, 2, 4)", g="contains(p_type, 'TIN')")


@query("""select sample_id, case when b08 is null or (b08::varchar = 'nan') then null when b08 < 0 then 'missing' when b08 > 0.5 then 'high' else 'low' end as a, case when b02 is not null and not (b02::varchar = 'nan') then least(greatest(b02, 0), 1) end as b,
coalesce(nullif(crop, ''), 'none') as c, poly_id is null as e from pixels""")
def calc_iif(spark, d):
    df = read(spark, d, "pixels")
    c = FieldDialect(df.schema).compile
    a = F.when(c("b08").col.isNotNull(), c("iif(b08 < 0, 'missing', iif(b08 > 0.5, 'high', 'low'))").col)
    return df.select("sample_id", a.alias("a"), c("clip(b02, 0, 1)").col.alias("b"), c("coalesce(crop, 'none')").col.alias("c"), c("isnull(poly_id)").col.alias("e"))


@query("select c_custkey, case when c_nationkey = 3 then c_acctbal * 2 else c_acctbal end as c_acctbal from customer")
def calc_where_rows(spark, d):
    return calculate(read(spark, d, "customer"), "c_acctbal", "c_acctbal * 2", "c_nationkey = 3").select("c_custkey", "c_acctbal")


@query("select count(time_text) as had, count(try_cast(time_text as double)) as kept, count(time_text) - count(try_cast(time_text as double)) as emptied from station_readings")
def cast_counts(spark, d):
    return T.cast_report(read(spark, d, "station_readings"), "time_text", "number")


@query("select gauge, date_text, rain::varchar is not null as known from rain_daily where rain > 0 and not (rain::varchar = 'nan')")
def calc_known(spark, d):
    df = read(spark, d, "rain_daily").where("rain > 0 and not isnan(rain)")
    return df.select("gauge", "date_text", cast_column(F.col("rain"), "text").isNotNull().alias("known"))


@query("select c_custkey, c_name, case when c_custkey = 5 then 1.0 else c_acctbal end as c_acctbal from customer where c_nationkey <> 4 or c_nationkey is null union all select -1, 'new', null")
def edit_rows(spark, d):
    df = T.set_cells(read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), "c_custkey", {5: {"c_acctbal": 1.0}})
    df = T.delete_rows(df, "c_nationkey = 4")
    return T.append_row(df, {"c_custkey": -1, "c_name": "new"}).drop("c_nationkey")


# --- Profiles --------------------------------------------------------------------------------------------------------

_PROFILE = " union all ".join(f"select '{c}' as \"column\", 'number' as kind, count(*) as n, count(*) - count({c}) as missing, count(distinct {c}) as distinct_values, min({c}) as min, max({c}) as max, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std, quantile_cont({c}, 0.25) as q1, median({c}) as median, quantile_cont({c}, 0.75) as q3 from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount"))


@query(_PROFILE)
def profile_numeric(spark, d):
    p = T.profile(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return p.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("""with e as (select min(value) as a, max(value) as b from events), g as (select unnest(range(20)) as bin, a, b from e),
c as (select least(19, floor((value - a) / (b - a) * 20))::int as bin, count(*) as n from events, e group by 1)
select g.bin::int as bin, round(a + (b - a) / 20 * g.bin, 6) as lo, round(a + (b - a) / 20 * (g.bin + 1), 6) as hi, coalesce(n, 0) as n from g left join c using (bin)""")
def profile_hist20(spark, d):
    h = T.histogram(read(spark, d, "events"), "value", 20)
    return h.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query("select crop as value, count(*) as n from pixels group by 1 order by n desc, value nulls last limit 8")
def profile_top8(spark, d):
    return T.top_values(read(spark, d, "pixels"), "crop", 8)


@query("""with c as (select coalesce(nullif(label, ''), '(empty)') as value, count(*) as n from pixels group by 1), r as (select *, row_number() over (order by n desc, value) as k from c)
select case when k <= 19 then value else 'other' end as value, sum(n)::bigint as n from r group by 1""")
def categories_legend(spark, d):
    return T.categories(read(spark, d, "pixels"), "label", 19)


@query("""select count(*) filter (not (b02::varchar = 'nan')) as n, min(b02) filter (not (b02::varchar = 'nan')) as min, max(b02) filter (not (b02::varchar = 'nan')) as max, round(avg(b02) filter (not (b02::varchar = 'nan')), 6) as mean, round(stddev_pop(b02) filter (not (b02::varchar = 'nan')), 6) as std,
round(quantile_cont(b02, 0.02) filter (not (b02::varchar = 'nan')), 6) as p2, round(quantile_cont(b02, 0.25) filter (not (b02::varchar = 'nan')), 6) as p25, round(median(b02) filter (not (b02::varchar = 'nan')), 6) as median,
round(quantile_cont(b02, 0.75) filter (not (b02::varchar = 'nan')), 6) as p75, round(quantile_cont(b02, 0.98) filter (not (b02::varchar = 'nan')), 6) as p98 from pixels where b02 is not null""")
def layer_statistics(spark, d):
    v = A.value_statistics(read(spark, d, "pixels"), "b02")
    return v.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p2", "p25", "median", "p75", "p98")})


# --- Joins -----------------------------------------------------------------------------------------------------------


@query("""with r as (select *, row_number() over (partition by lower(trim(name)) order by order_no) as k from (select c_mktsegment as name, c_name as first_customer, c_custkey as order_no from customer))
select c_custkey, first_customer, first_customer is not null as matched from customer c left join (select * from r where k = 1) on lower(trim(c.c_mktsegment)) = lower(trim(name))""")
def attr_join_first(spark, d):
    c = read(spark, d, "customer")
    right = c.select(F.upper("c_mktsegment").alias("name"), F.col("c_name").alias("first_customer"), F.col("c_custkey").alias("order_no"))
    return attribute_join(c.select("c_custkey", "c_mktsegment"), right, "c_mktsegment", "name", ["order_no"]).select("c_custkey", "first_customer", "matched")


@query("select count(*) filter (n_nationkey is null) as unmatched, count(*) as n from customer left join (select * from nation where n_nationkey < 20) on c_nationkey = n_nationkey")
def attr_join_unmatched(spark, d):
    right = read(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit(" "), F.col("n_nationkey").cast("double").cast("string")).alias("key"), "n_name")
    j = attribute_join(read(spark, d, "customer"), right, "c_nationkey", "key", ["n_name"])
    return j.agg(F.count(F.when(~F.col("matched"), 1)).alias("unmatched"), F.count("*").alias("n"))


@query("""with r as (select upper(trim(station)) as name, received_at::date::varchar as day, case when aqi::varchar = 'nan' or aqi = -999 then null else aqi end as aqi, case when temperature::varchar = 'nan' or temperature = -999 then null else temperature end as t from station_readings),
a as (select name, day, round(avg(aqi), 8) as aqi from r where aqi is not null group by all), w as (select name, day, round(avg(t), 8) as temperature from r where t is not null group by all)
select coalesce(a.name, w.name) as name, coalesce(a.day, w.day) as day, aqi, temperature from a full join w on a.name = w.name and a.day = w.day""")
def air_weather_merge(spark, d):
    """Air and weather of each station and day of delivery side by side; either may be missing."""
    r = read(spark, d, "station_readings").select(F.upper(F.trim("station")).alias("name"), F.col("received_at").cast("date").cast("string").alias("day"), clean_number(F.col("aqi"), -999.0).alias("aqi"), clean_number(F.col("temperature"), -999.0).alias("temperature"))
    air, weather = (r.where(f"{c} is not null").groupBy("name", "day").agg(F.round(F.avg(c), 8).alias(c)) for c in ("aqi", "temperature"))
    return S.side_by_side(air, weather, ["name", "day"])


@query("select tile, captured_at::date::varchar as day, max(scene_id) as scene_id from scenes group by all")
def scene_dedupe(spark, d):
    from loamgrid.operators.raster import dedupe_scenes

    return dedupe_scenes(read(spark, d, "scenes").withColumn("day", F.col("captured_at").cast("date").cast("string")), ["tile", "day"], "scene_id").select("tile", "day", "scene_id")


# --- Windows and series ----------------------------------------------------------------------------------------------

_PANEL = """panel as (select s.event_type, h.step, p.v from (select distinct event_type from events) s
cross join (select unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), interval 1 hour)) as step from events) h
left join (select event_type, date_trunc('hour', ts) as step, avg(value) as v from events group by all) p on p.event_type = s.event_type and p.step = h.step)"""


def _panel(spark, d):
    return S.panel(read(spark, d, "events").withColumn("v", F.col("value")), "event_type", "ts", ["v"], "h")


@query(f"with {_PANEL} select event_type, step, round(v, 6) as v from panel")
def panel_hourly(spark, d):
    return _panel(spark, d).select("event_type", "step", F.round("v", 6).alias("v"))


@query(f"with {_PANEL} select event_type, step, round(lag(v, 1) over w, 6) as v_lag_1, round(lag(v, 24) over w, 6) as v_lag_24 from panel window w as (partition by event_type order by step)")
def lags(spark, d):
    return S.with_lags(_panel(spark, d), "event_type", "step", "v", (1, 24)).select("event_type", "step", F.round("v_lag_1", 6).alias("v_lag_1"), F.round("v_lag_24", 6).alias("v_lag_24"))


@query(f"""with {_PANEL} select event_type, step, round(avg(v) over (w rows between 3 preceding and 1 preceding), 8) as v_mean_3, round(avg(v) over (w rows between 24 preceding and 1 preceding), 8) as v_mean_24,
round(stddev_samp(v) over (w rows between 24 preceding and 1 preceding), 8) as v_std_24 from panel window w as (partition by event_type order by step)""")
def rolling_mean_excl(spark, d):
    r = S.with_rolling(_panel(spark, d), "event_type", "step", "v", (3, 24))
    return r.select("event_type", "step", *(F.round(c, 8).alias(c) for c in ("v_mean_3", "v_mean_24", "v_std_24")))


_NEAR = """n as (select *, row_number() over (partition by event_type order by step) as k from panel),
m as (select *, last_value(v ignore nulls) over p as v0, max(case when v is not null then k end) over p as k0, first_value(v ignore nulls) over f as v1, min(case when v is not null then k end) over f as k1 from n
window p as (partition by event_type order by step rows unbounded preceding), f as (partition by event_type order by step rows between current row and unbounded following))"""


@query(f"with {_PANEL}, {_NEAR} select event_type, step, round(case when v is not null then v when k - k0 <= 2 then v0 + (v1 - v0) * (k - k0) / (k1 - k0) end, 5) as v from m")
def gap_interp(spark, d):
    return S.interpolate_gaps(_panel(spark, d), "event_type", "step", "v", 2).select("event_type", "step", F.round("v", 5).alias("v"))


@query(f"with {_PANEL} select event_type, step, round(last_value(v ignore nulls) over (partition by event_type order by step rows unbounded preceding), 6) as v from panel")
def ffill(spark, d):
    return S.forward_fill(_panel(spark, d), "event_type", "step", "v").select("event_type", "step", F.round("v", 6).alias("v"))


@query(f"""with {_PANEL} select event_type, step, round(case when row_number() over w >= 24 and count(v) over (w rows 23 preceding) >= 18 then avg(v) over (w rows 23 preceding) end, 8) as mean_24 from panel window w as (partition by event_type order by step)""")
def trailing_mean_24h(spark, d):
    return _panel(spark, d).select("event_type", "step", F.round(trailing_mean(F.col("v"), "event_type", "step", 24), 8).alias("mean_24"))


def _sub_sql(p: str, c: str) -> str:
    from loamgrid.functions.airquality import BREAKPOINTS, SCALE

    b = BREAKPOINTS[p]
    return f"case when {c} is null then null when {c} <= 0 then 0 " + " ".join(f"when {c} <= {b[i + 1]} then {SCALE[i]} + {SCALE[i + 1] - SCALE[i]} * ({c} - {b[i]}) / {b[i + 1] - b[i]}" for i in range(6)) + " else 500 end"


@query("select event_id, round(" + _sub_sql("PM2.5", "value") + ", 6) as pm25, round(" + _sub_sql("O3", "value") + ", 6) as o3 from events")
def aqi_sub_index(spark, d):
    return read(spark, d, "events").select("event_id", F.round(sub_index("PM2.5", F.col("value")), 6).alias("pm25"), F.round(sub_index("O3", F.col("value")), 6).alias("o3"))


_WIDE = "wide as (select date_trunc('hour', ts) as step, 'all' as place, avg(case when event_type = 'click' then value end) as p1, avg(case when event_type = 'view' then value end) as p2, avg(case when event_type = 'purchase' then value end) as p3, avg(case when event_type = 'signup' then value end) as p4 from events group by 1)"
_MEANS = ", ".join(f"case when row_number() over w >= {h} and count({c}) over (w rows {h - 1} preceding) >= {0.75 * h} then avg({c}) over (w rows {h - 1} preceding) end as {c}" for c, h in (("p1", 24), ("p2", 24), ("p3", 24), ("p4", 8)))


@query(f"""with {_WIDE}, means as (select step, {_MEANS} from wide window w as (order by step)),
s as (select step, {_sub_sql("PM2.5", "p1")} as s1, {_sub_sql("PM10", "p2")} as s2, {_sub_sql("NO2", "p3")} as s3, {_sub_sql("O3", "p4")} as s4 from means),
t as (select *, greatest(s1, s2, s3, s4) as top, (s1 is not null)::int + (s2 is not null)::int + (s3 is not null)::int + (s4 is not null)::int as k from s)
select step, case when k >= 3 and (s1 is not null or s2 is not null) then round_even(top, 0)::int end as aqi,
case when k >= 3 and (s1 is not null or s2 is not null) then case when s1 = top then 'PM2.5' when s2 = top then 'PM10' when s3 = top then 'NO2' else 'O3' end end as main_pollutant from t""")
def indian_aqi(spark, d):
    v = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    wide = read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("step")).agg(v("click").alias("p1"), v("view").alias("p2"), v("purchase").alias("p3"), v("signup").alias("p4")).withColumn("place", F.lit("all"))
    return with_aqi(wide, "place", "step", {"PM2.5": "p1", "PM10": "p2", "NO2": "p3", "O3": "p4"}).select("step", "aqi", "main_pollutant")


@query("""select event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 as hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 as hour_cos, round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) + 0.0 as doy_sin,
round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) + 0.0 as doy_cos, (isodow(ts) - 1)::int as dow from events""")
def calendar_cyc(spark, d):
    c = S.calendar_features(read(spark, d, "events").select("event_id", "ts"), "ts", "h")
    return c.select("event_id", *((F.round(n, 6) + 0.0).alias(n) for n in ("hour_sin", "hour_cos", "doy_sin", "doy_cos")), "dow")


@query("""with g as (select epoch(ts - lag(ts) over (partition by event_type order by ts)) / 3600 as gap from events) select round(median(gap), 6) as hours, case when median(gap) <= 1.5 then 'h' when median(gap) <= 36 then 'D' when median(gap) <= 240 then 'W' else 'MS' end as freq from g where gap > 0""")
def frequency_guess(spark, d):
    return S.guess_frequency(read(spark, d, "events"), ["event_type"], "ts").select(F.round("hours", 6).alias("hours"), "freq")


_BASE = f"""with {_PANEL}, n as (select *, row_number() over (partition by event_type order by step) as k from panel),
l as (select *, last_value(v ignore nulls) over (partition by event_type order by k rows unbounded preceding) as lv from n),
q as (select s.event_type, c.cutoff, h.h from (select distinct event_type from panel) s cross join (select unnest([600, 650]) as cutoff) c cross join (select unnest(range(1, 25)) as h) h),
f as (select q.*, a.v as actual, b.lv as naive, coalesce(z.v, b.lv) as seasonal from q left join n a on a.event_type = q.event_type and a.k = cutoff + h left join l b on b.event_type = q.event_type and b.k = cutoff
left join n z on z.event_type = q.event_type and z.k = cutoff + h - 24 * ceil(h / 24.0))"""


def _baselines(spark, d):
    cut = spark.createDataFrame([(600,), (650,)], "cutoff int")
    return S.baseline_forecasts(_panel(spark, d), "event_type", "step", "v", cut, 24, 24)


@query(_BASE + " select event_type, cutoff, h, round(actual, 6) as actual, round(naive, 6) as naive, round(seasonal, 6) as seasonal from f")
def seasonal_naive(spark, d):
    b = _baselines(spark, d)
    return b.select("event_type", "cutoff", "h", *(F.round(c, 6).alias(c) for c in ("actual", "naive", "seasonal")))


@query(_BASE + """, e as (select 'naive' as model, naive - actual as err, actual from f union all select 'seasonal', seasonal - actual, actual from f)
select model, count(*) as n, round(avg(abs(err)), 6) as mae, round(sqrt(avg(err * err)), 6) as rmse, round(avg(err), 6) as bias, case when avg((actual <> 0)::int) > 0.5 then round(avg(case when actual <> 0 then abs(err / actual) end) * 100, 5) end as mape from e where err is not null group by model""")
def forecast_metrics(spark, d):
    m = S.forecast_errors(_baselines(spark, d), "actual", ["naive", "seasonal"])
    return m.select("model", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("bias", 6).alias("bias"), F.round("mape", 5).alias("mape"))


@query(_BASE + """, e as (select h, abs(naive - actual) as e from f where naive - actual is not null), w as (select unnest(range(1, 25)) as h)
select w.h::int as h, case when count(*) >= 5 then round(quantile_cont(e, 0.8), 6) end as half_width from w join e on e.h between w.h - 2 and w.h + 2 group by w.h""")
def band_quantile(spark, d):
    b = _baselines(spark, d).withColumn("err", F.col("naive") - F.col("actual"))
    return S.uncertainty(b, "h", "err", 24).select("h", F.round("half_width", 6).alias("half_width"))


@query(f"with {_PANEL} select event_type, step, round(lag(v, 48) over w, 6) as v_season_1, round(lag(v, 72) over w, 6) as v_season_2 from panel window w as (partition by event_type order by step)")
def same_season_values(spark, d):
    s = S.same_season(_panel(spark, d), "event_type", "step", "v", 24, 48, 2)
    return s.select("event_type", "step", F.round("v_season_1", 6).alias("v_season_1"), F.round("v_season_2", 6).alias("v_season_2"))


@query(f"with {_PANEL} select event_type, step, round(coalesce(v, lag(v, 24) over w, lag(v, 48) over w), 6) as v from panel window w as (partition by event_type order by step)")
def future_input_fill(spark, d):
    return S.future_inputs(_panel(spark, d), "event_type", "step", "v", 24, 2).select("event_type", "step", F.round("v", 6).alias("v"))


@query("""with p as (select station as key, radians(lat) as p, radians(lon) as l from stations), f as (select a.key, b.key as near, 2 * 6371 * asin(least(1, sqrt(greatest(0, 2 - 2 * (sin(a.p) * sin(b.p) + cos(a.p) * cos(b.p) * cos(a.l - b.l)))) / 2)) as km from p a join p b on a.key <> b.key)
select key, near, round(km, 4) as km, round(1 / power(km + 0.5, 2), 8) as weight from f qualify row_number() over (partition by key order by km, near) <= 5""")
def series_neighbours(spark, d):
    n = S.neighbours(read(spark, d, "stations"), "station", "lat", "lon", 5)
    return n.select("key", "near", F.round("km", 4).alias("km"), F.round("weight", 8).alias("weight"))


@query("""select a.point_id, round(2 * 6371008.8 * asin(sqrt(power(sin(radians(s.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - a.lon) / 2), 2))), 2) as metres
from points a join stations s on a.point_name = s.station where abs(a.lat) <= 90 and abs(a.lon) <= 180""")
def haversine(spark, d):
    p = read(spark, d, "points").where("abs(lat) <= 90 and abs(lon) <= 180")
    s = read(spark, d, "stations").select("station", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.join(s, F.col("point_name") == F.col("station")).select("point_id", F.round(great_circle(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 2).alias("metres"))


@query("""with g as (select s.tile, s.captured_at::date::varchar as day, p.scene_id, avg(case when label is not null and x between -1 and 1 then x end) as mean, count(case when label is not null and x between -1 and 1 then x end) as pixels, avg((label is not null)::int) * 100 as clear_pct
from (select scene_id, label, (b08 - b04) / nullif(b08 + b04, 0) as x from pixels where not (b08::varchar = 'nan') and not (b04::varchar = 'nan')) p join scenes s using (scene_id) group by all)
select tile, day, scene_id, round(mean, 6) as mean, pixels, round(clear_pct, 4) as clear_pct from g qualify row_number() over (partition by tile, day order by mean is null, clear_pct desc, scene_id desc) = 1""")
def index_time_series(spark, d):
    px = read(spark, d, "pixels").where("b08 is not null and b04 is not null and not isnan(b08) and not isnan(b04)")
    x = F.try_divide(F.col("b08") - F.col("b04"), F.col("b08") + F.col("b04"))
    px = px.select("scene_id", x.alias("x"), F.col("label").isNotNull().alias("clear"))
    sc = read(spark, d, "scenes").select("scene_id", "tile", F.col("captured_at").cast("date").cast("string").alias("day"))
    out = S.index_series(px.join(sc, "scene_id"), "tile", "day", "scene_id", "x", "clear")
    return out.select("tile", "day", "scene_id", F.round("mean", 6).alias("mean"), "pixels", F.round("clear_pct", 4).alias("clear_pct"))


# --- Indices, calculator, reclassification ---------------------------------------------------------------------------

_BANDS = {"B02": "l_discount", "B03": "l_tax", "B04": "l_quantity", "B05": "l_linenumber", "B08": "l_extendedprice", "B11": "l_suppkey", "B12": "l_partkey", "VV": "l_discount", "VH": "l_tax"}


def _index_sql(formula: str) -> str:
    import re

    s = re.sub(r"\b(B\d\d|VV|VH)\b", lambda m: f"{_BANDS[m[1]]}::double", formula)
    s = re.sub(r"(\([^()]*(?:\([^()]*\)[^()]*)*\)|10) \*\* (2|\([^()]*\))", r"power(\1, \2)", s)
    i = s.find(" / (")
    if " / " in s and "sqrt" not in s:
        # The last division's denominator.
        parts = s.rsplit(" / ", 1) if not s.endswith(")") else None
        if parts is None:
            depth, k = 0, len(s) - 1
            while True:
                depth += (s[k] == ")") - (s[k] == "(")
                if not depth:
                    break
                k -= 1
            s = f"{s[:k]}nullif({s[k:]}, 0)" if s[:k].endswith("/ ") else s
        else:
            a, b = parts
            head, _, tail = b.partition(" ")
            s = f"{a} / nullif({head}, 0) {tail}"
    del i
    return f"({s})"


def _register_index(name: str) -> None:
    def run(spark, d):
        df = read(spark, d, "lineitem")
        c = index_column(name, {b: F.col(col) for b, col in _BANDS.items()})
        return df.select("l_orderkey", "l_linenumber", "l_returnflag", c.alias("x")).groupBy("l_returnflag").agg(F.count("x").alias("n"), F.round(F.avg("x"), 5).alias("mean"), F.round(F.min("x"), 5).alias("low"), F.round(F.max("x"), 5).alias("high"))

    run.__name__ = f"index_{name.lower()}"
    QUERIES[run.__name__] = run
    ORACLE[run.__name__] = f"with v as (select l_returnflag, {_index_sql(INDICES[name])} as x from lineitem) select l_returnflag, count(x) as n, round(avg(x), 5) as mean, round(min(x), 5) as low, round(max(x), 5) as high from v group by 1"


for _name in INDICES:
    _register_index(_name)


@query("""select sample_id, case when b02 is null or b03 is null or (b02::varchar = 'nan') or (b03::varchar = 'nan') then null when b02 > b03 then sqrt(abs(b02 - b03)) else least(b02, b03) * 2 end as value from pixels""")
def raster_calc(spark, d):
    df = read(spark, d, "pixels")
    return df.select("sample_id", RasterDialect(df.schema).compile("where(b02 > b03, sqrt(abs(b02 - b03)), min(b02, b03) * 2)").col.alias("value"))


@query("""select sample_id, case when b02 = 0 and b03 = 0 then null when (b02::varchar = 'nan') then null else greatest(b02 * 0.0001 - 0.1, 0) end as b02, case when b02 = 0 and b03 = 0 then null when (b03::varchar = 'nan') then null else greatest(b03 * 0.0001 - 0.1, 0) end as b03 from pixels where b02 is not null and b03 is not null""")
def reflectance_scaling(spark, d):
    px = read(spark, d, "pixels").where("b02 is not null and b03 is not null")
    return reflectance(px.select("sample_id", "b02", "b03"), ["b02", "b03"], "s2_offset")


# --- Accuracy and agreement ------------------------------------------------------------------------------------------

_CM = "cm as (select regexp_replace(lower(label), '[^a-z]', '', 'g') as map, case when poly_id > 0 then case (poly_id % 4)::int when 0 then 'cropland' when 1 then 'forest' when 2 then 'builtup' else 'grassland' end else 'barren' end as ref, count(*) as n from pixels where label is not null group by all)"


def _cm(spark, d):
    k = F.col("poly_id") % 4
    ref = F.when(F.col("poly_id") > 0, F.when(k == 0, "cropland").when(k == 1, "forest").when(k == 2, "builtup").otherwise("grassland")).otherwise("barren")
    px = read(spark, d, "pixels").where("label is not null").select(F.regexp_replace(F.lower("label"), "[^a-z]", "").alias("m"), ref.alias("r"))
    return A.confusion(px, "m", "r")


@query(f"with {_CM} select * from cm")
def confusion_matrix(spark, d):
    return _cm(spark, d)


_MARGIN = f"""with {_CM}, m as (select map as class, sum(n) as mapped, 0 as referenced, sum(case when map = ref then n else 0 end) as hit from cm group by 1 union all select ref, 0, sum(n), 0 from cm group by 1),
g as (select class, sum(mapped)::double as mapped, sum(referenced)::double as referenced, sum(hit)::double as hit from m group by 1)"""


@query(_MARGIN + " select class, round(hit / nullif(mapped, 0), 6) as users, round(hit / nullif(referenced, 0), 6) as producers, round(2 * hit / nullif(mapped + referenced, 0), 6) as f1, round(hit / nullif(mapped + referenced - hit, 0), 6) as iou, referenced::bigint as support from g")
def class_accuracy(spark, d):
    c = A.class_accuracy(_cm(spark, d))
    return c.select("class", *(F.round(n, 6).alias(n) for n in ("users", "producers", "f1", "iou")), "support")


@query(_MARGIN + """, t as (select sum(mapped) as n, sum(hit) as hit, sum(mapped * referenced) as agree, sum(mapped * mapped) as m2, sum(referenced * referenced) as r2, avg(hit / nullif(referenced, 0)) as ba, avg(2 * hit / nullif(mapped + referenced, 0)) as mf,
sum(2 * hit / nullif(mapped + referenced, 0) * referenced) / sum(referenced) as wf, avg(hit / nullif(mapped + referenced - hit, 0)) as mi from g)
select n::bigint as n, round(hit / n, 6) as accuracy, round((hit / n - agree / n / n) / (1 - agree / n / n), 6) as kappa, round(ba, 6) as balanced_accuracy, round(mf, 6) as macro_f1, round(wf, 6) as weighted_f1, round(mi, 6) as miou,
round((hit * n - agree) / (sqrt(n * n - m2) * sqrt(n * n - r2)), 6) as mcc from t""")
def accuracy_kappa(spark, d):
    o = A.overall_accuracy(_cm(spark, d))
    return o.select("n", *(F.round(c, 6).alias(c) for c in o.columns if c != "n"))


@query(f"""with {_CM}, a as (select map as class, sum(n) * 0.01 as area from cm group by 1), w as (select class, area / sum(area) over () as w, sum(area) over () as t from a),
p as (select cm.map, cm.ref, w, t, n / sum(n) over (partition by cm.map) as q, sum(n) over (partition by cm.map) as ni from cm join w on w.class = cm.map),
v as (select *, w * q as p, w * w * q * (1 - q) / (ni - 1) as v from p), o as (select sum(p) as overall, 1.96 * sqrt(sum(v)) as ci from v where map = ref)
select ref as class, round(sum(p) * any_value(t), 4) as area, round(1.96 * sqrt(sum(v)) * any_value(t), 4) as ci, round(sum(case when map = ref then q end), 6) as users_own, round(any_value(overall), 6) as overall, round(any_value(o.ci), 6) as overall_ci from v cross join o group by ref""")
def olofsson_area(spark, d):
    cm = _cm(spark, d)
    strata = cm.groupBy(F.col("map").alias("class")).agg((F.sum("n") * 0.01).alias("area"))
    e = A.area_estimates(cm, strata)
    return e.select("class", F.round("area", 4).alias("area"), F.round("ci", 4).alias("ci"), F.round("users", 6).alias("users_own"), F.round("overall", 6).alias("overall"), F.round("overall_ci", 6).alias("overall_ci"))


@query("""with f as (select l_extendedprice as a, l_quantity * 2000 as p from lineitem), s as (select count(*) as n, avg((p - a) * (p - a)) as mse, avg(abs(p - a)) as mae, median(abs(p - a)) as med, avg(p - a) as bias, var_pop(a) as va, var_pop(p - a) as ve, corr(a, p) as r, avg(abs((p - a) / a)) as ape, max(a) - min(a) as rng from f)
select n, round(1 - mse / va, 6) as r2, round(sqrt(mse), 4) as rmse, round(mae, 4) as mae, round(med, 4) as median_ae, round(bias, 4) as bias, round(1 - ve / va, 6) as explained_variance, round(r, 6) as pearson, round(1 - (mse / va) * (n - 1) / (n - 2), 6) as adjusted_r2, round(ape * 100, 4) as mape, round(sqrt(mse) / rng, 6) as nrmse from s""")
def reg_metrics(spark, d):
    m = A.regression_metrics(read(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 2000), "l_extendedprice", "p")
    r = {c: 4 if c in ("rmse", "mae", "median_ae", "bias", "mape") else 6 for c in m.columns if c != "n"}
    return m.select("n", *(F.round(c, k).alias(c) for c, k in r.items()))


@query("""with c as (select regexp_replace(lower(label), '[^a-z]', '', 'g') as a, scene_id % 5 as b, count(*)::double as n from pixels where label is not null group by all),
m as (select *, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as t from c),
s as (select max(t) as t, sum(n * (n - 1) / 2) as same, sum((na - 1) / 2 * n) as pa, sum((nb - 1) / 2 * n) as pb, sum(n / t * ln(n * t / na / nb)) as mi, sum(-n / t * ln(na / t)) as ha, sum(-n / t * ln(nb / t)) as hb from m)
select round((same - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) as ari, round(mi / ((ha + hb) / 2), 6) as nmi, round(mi / hb, 6) as homogeneity, round(mi / ha, 6) as completeness, round(2 * (mi / hb) * (mi / ha) / (mi / hb + mi / ha), 6) as v_measure from s""")
def cluster_agreement(spark, d):
    px = read(spark, d, "pixels").where("label is not null").select(F.regexp_replace(F.lower("label"), "[^a-z]", "").alias("a"), (F.col("scene_id") % 5).alias("b"))
    g = A.agreement(px, "a", "b")
    return g.select(*(F.round(c, 6).alias(c) for c in g.columns))


@query("""with g as (select label_code as class, count(*) as pixels, sum(100.0) / 10000 as hectares from pixels group by 1) select class, pixels, round(hectares, 4) as hectares, round(hectares / sum(hectares) over () * 100, 6) as percent from g where class is not null""")
def area_statistics(spark, d):
    a = A.area_by_class(read(spark, d, "pixels").withColumn("m2", F.lit(100.0)), "label_code", "m2")
    return a.select("class", "pixels", F.round("hectares", 4).alias("hectares"), F.round("percent", 6).alias("percent"))


@query("""with r as (select least(1.0, greatest(0.0, value / 200)) as p, (event_type = 'purchase')::int as y from events), b as (select p, sum(y) as pos, count(*) as n from r group by 1),
w as (select *, coalesce(sum(n - pos) over (order by p rows between unbounded preceding and 1 preceding), 0) as below from b), a as (select sum(pos * (below + (n - pos) / 2.0)) / (sum(pos) * sum(n - pos)) as auc from w),
l as (select count(*) as n, avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) as ll from r), k as (select least(9, floor(p * 10)) as bin, count(*) as n, avg(p) as p, avg(y) as y from r group by 1), e as (select sum(n * abs(p - y)) / sum(n) as ece from k)
select n, round(auc, 6) as auc, round(ll, 6) as log_loss, round(ece, 6) as ece from l, a, e""")
def probability_quality(spark, d):
    e = read(spark, d, "events").withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 200)))
    m = A.probability_metrics(e, "event_type", "p", "purchase")
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("auc", "log_loss", "ece")))


# --- Sampling and text -----------------------------------------------------------------------------------------------


@query()
def sample_points(spark, d):
    return T.sample_rows(read(spark, d, "points"), 20_000, "point_id").select("point_id", "lat", "lon")


@query()
def sample_bernoulli(spark, d):
    return T.bernoulli(read(spark, d, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber", "l_partkey")), 5000, "key").select("l_orderkey", "l_linenumber")


@query()
def sample_stratified(spark, d):
    return T.stratified(read(spark, d, "pixels"), "label_code", 500, "sample_id").groupBy("label_code").agg(F.count("*").alias("n"))


@query("""with n as (select doc_id, trim(regexp_replace(lower(coalesce(category, '')), '[^a-z0-9]+', ' ', 'g')) as h, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) as b from documents)
select doc_id, (3 * ((length(h) - length(replace(h, 'water', ''))) // 5 + (length(h) - length(replace(h, 'leaf', ''))) // 4) + (length(b) - length(replace(b, 'water', ''))) // 5 + (length(b) - length(replace(b, 'leaf', ''))) // 4)::int as score
from n where (contains(h, 'water') or contains(b, 'water')) and (contains(h, 'leaf') or contains(b, 'leaf')) order by score desc, doc_id limit 200""")
def kb_search_rank(spark, d):
    return X.search(read(spark, d, "documents"), "Water leaf", "category", "text", "doc_id").select("doc_id", "score")


@query("""with n as (select doc_id, lower(coalesce(source, '')) as s, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as q from documents where text is not null)
select min(doc_id) as doc_id from n group by s, q""")
def kb_dedupe(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    return X.first_of_each(docs, [F.lower(F.coalesce("source", F.lit(""))), X.normalise(F.col("text"))], ["doc_id"]).select("doc_id")


@query("""select doc_id, case when contains(lower(category), 'weather') or contains(lower(category), 'climate') then 'weather' when contains(lower(category), 'land') then 'land' when contains(lower(category), 'manage') then 'care' else 'growing' end as section from documents""")
def section_names(spark, d):
    s = X.section_of(F.col("category"), {"weather": ("weather", "climate"), "land": ("land",), "care": ("manage",)}, "growing")
    return read(spark, d, "documents").select("doc_id", s.alias("section"))


@query("select scene_id, left(regexp_replace(regexp_replace(raster_path, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 60) as stem from scenes")
def safe_names(spark, d):
    return read(spark, d, "scenes").select("scene_id", X.safe_stem(F.col("raster_path")).alias("stem"))


@query("""with s as (select value from events), q as (select quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) as b from s)
select case when value < b[2] then 1 when value < b[3] then 2 when value < b[4] then 3 else 4 end as class, count(*) as n from s, q group by 1""")
def quantile_classes(spark, d):
    e = read(spark, d, "events")
    return e.groupBy(A.classify(F.col("value"), A.class_breaks(e, "value", "quantile", 4)).alias("class")).agg(F.count("*").alias("n"))


_SEG = "seg as (select a.x as a, b.x as b, sum(c.n * c.x * c.x) - power(sum(c.n * c.x), 2) / sum(c.n) as cost from v a join v b on b.x >= a.x join v c on c.x between a.x and b.x group by all)"


@query(f"""with v as (select p_size::double as x, count(*) as n, row_number() over (order by p_size) as i from part group by p_size), {_SEG}, nxt as (select a.x as x, b.x as y from v a join v b on b.i = a.i + 1),
c1 as (select b as top, cost, [a, b] as cuts from seg where a = (select min(x) from v)),
c2 as (select s.b as top, c.cost + s.cost as cost, list_append(c.cuts, s.b) as cuts from c1 c join nxt on nxt.x = c.top join seg s on s.a = nxt.y qualify row_number() over (partition by s.b order by c.cost + s.cost) = 1),
c3 as (select s.b as top, c.cost + s.cost as cost, list_append(c.cuts, s.b) as cuts from c2 c join nxt on nxt.x = c.top join seg s on s.a = nxt.y qualify row_number() over (partition by s.b order by c.cost + s.cost) = 1),
c4 as (select s.b as top, c.cost + s.cost as cost, list_append(c.cuts, s.b) as cuts from c3 c join nxt on nxt.x = c.top join seg s on s.a = nxt.y qualify row_number() over (partition by s.b order by c.cost + s.cost) = 1),
c5 as (select s.b as top, c.cost + s.cost as cost, list_append(c.cuts, s.b) as cuts from c4 c join nxt on nxt.x = c.top join seg s on s.a = nxt.y where s.b = (select max(x) from v) qualify row_number() over (order by c.cost + s.cost) = 1)
select unnest(range(6))::int as i, unnest(cuts) as at from c5""")
def jenks_breaks(spark, d):
    return spark.createDataFrame(list(enumerate(A.class_breaks(read(spark, d, "part"), "p_size", "natural", 5))), "i int, at double")


@query("select label_code, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from pixels group by 1")
def label_distribution(spark, d):
    return A.label_distribution(read(spark, d, "pixels"), "label_code").select("label_code", "n", F.round("percent", 6).alias("percent"))
