"""Panels of time series: resampling, features, gaps, baselines and errors of forecasts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.curves import great_circle, sphere_xyz
from loamgrid.functions.expressions import finite
from loamgrid.operators.meeting import meet
from loamgrid.operators.quantiles import exact_quantiles
from loamgrid.storage import Staged

#: Fixed values of the four frequencies: season, default horizon, rolling windows, lags, steps a year, unit.
FREQUENCIES = {
    "h": {"season": 24, "horizon": 48, "windows": (3, 6, 24, 168), "lags": (1, 2, 3, 4, 6, 12, 24, 48, 72, 168), "year": 8760, "unit": "hour"},
    "D": {"season": 7, "horizon": 14, "windows": (3, 7, 28), "lags": (1, 2, 3, 7, 14, 21, 28, 365), "year": 365, "unit": "day"},
    "W": {"season": 52, "horizon": 8, "windows": (4, 13), "lags": (1, 2, 3, 4, 8, 13, 26, 52), "year": 52, "unit": "week"},
    "MS": {"season": 12, "horizon": 12, "windows": (3, 12), "lags": (1, 2, 3, 6, 12, 24), "year": 12, "unit": "month"},
}


def guess_frequency(df: DataFrame, series: Sequence[str], time: str) -> DataFrame:
    """``hours`` (median positive gap within a series) and ``freq``: h, D, W or MS."""
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(Window.partitionBy(*series).orderBy(time)).cast("timestamp"))
    gaps = df.select((gap / 3.6e9).alias("gap")).where("gap > 0")
    median = exact_quantiles(gaps, {"gap": F.col("gap")}, (0.5,))["gap"][0]
    hours = df.sparkSession.range(1).select(F.lit(median).cast("double").alias("hours"))
    freq = F.when(F.col("hours") <= 1.5, "h").when(F.col("hours") <= 36, "D").when(F.col("hours") <= 240, "W").otherwise("MS")
    return hours.select("hours", F.when(F.col("hours").isNotNull(), freq).alias("freq"))


def panel(df: DataFrame, series: str, time: str, values: Sequence[str], freq: str) -> DataFrame:
    """Means of the readings of each series and step, for every step between the first and last of all series.

    Aggregated first, so the calendar meets one row a series and step. Steps without a reading are null.
    """
    unit = FREQUENCIES[freq]["unit"]
    means = df.where(F.col(time).isNotNull()).groupBy(F.col(series), F.date_trunc(unit, time).cast("timestamp_ntz").alias("step"))
    means = means.agg(*(F.avg(finite(F.col(v).cast("double"))).alias(v) for v in values))
    ends = means.agg(F.min("step").alias("a"), F.max("step").alias("b")).where("a is not null")
    steps = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("step"))
    # Every series at every step is the result itself: series x steps rows.
    grid = means.select(series).distinct().join(steps)
    return grid.join(means, [series, "step"], "left")


def with_lags(df: DataFrame, series: str, order: str, value: str, lags: Sequence[int]) -> DataFrame:
    w = Window.partitionBy(series).orderBy(order)
    return df.withColumns({f"{value}_lag_{n}": F.lag(value, n).over(w) for n in lags})


def with_rolling(df: DataFrame, series: str, order: str, value: str, windows: Sequence[int]) -> DataFrame:
    """Means of the previous n steps (this one excluded), and the sample deviation over the longest."""
    w = Window.partitionBy(series).orderBy(order)
    span = lambda n: w.rowsBetween(-n, -1)
    out = {f"{value}_mean_{n}": F.avg(value).over(span(n)) for n in windows}
    longest = max(windows)
    return df.withColumns(out | {f"{value}_std_{longest}": F.stddev_samp(value).over(span(longest))})


def interpolate_gaps(df: DataFrame, series: str, order: str, value: str, limit: int) -> DataFrame:
    """Straight lines inside gaps of a regular panel; of a longer gap the first ``limit`` steps are filled."""
    w = Window.partitionBy(series).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    n = F.row_number().over(w)
    at = df.withColumn("__n", n)
    at = at.withColumns({"__n0": F.last(F.when(F.col(value).isNotNull(), F.col("__n")), True).over(back), "__v0": F.last(value, True).over(back), "__n1": F.first(F.when(F.col(value).isNotNull(), F.col("__n")), True).over(ahead), "__v1": F.first(value, True).over(ahead)})
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__n") - F.col("__n0")) / (F.col("__n1") - F.col("__n0"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("__n") - F.col("__n0") <= limit, line)
    return at.withColumn(value, filled).drop("__n", "__n0", "__v0", "__n1", "__v1")


def forward_fill(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, True).over(w))


def calendar_features(df: DataFrame, time: str, freq: str = "h") -> DataFrame:
    """Sine and cosine of the hour, the day of the year, the week and the month, and the day of the week (0 Monday)."""
    t = F.col(time)
    circle = {"hour": F.hour(t) / 24, "doy": F.dayofyear(t) / 365.25, "week": F.weekofyear(t) / 52.18, "month": F.month(t) / 12}
    keep = {"h": ("hour", "doy"), "D": ("doy",), "W": ("week",), "MS": ("month",)}[freq]
    cols = {f"{n}_{f.__name__}": f(2 * math.pi * circle[n]) for n in keep for f in (F.sin, F.cos)}
    return df.withColumns(cols | ({"dow": F.weekday(t)} if freq in ("h", "D") else {}))


def neighbours(places: DataFrame, key: str, lat: str, lon: str, k: int = 5, radius_km: float = 6371.0) -> DataFrame:
    """``key, near, km, weight``: the k nearest other series, weight 1 / (km + 0.5)^2; ties by key. Fewer where there are fewer series.

    ``places`` has one row a series. Reaches that double: places within a reach meet in cells of a cube around the sphere (full cells are cut into parts), those
    with k partners are settled, only the rest goes on. The first reach is small against the mean spacing, so dense regions are settled early.
    """
    kind = dict(places.dtypes)[key]
    a = Staged(places.select(F.col(key).alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).dropna())
    all_, n = a.df, a.rows
    xyz = lambda: sphere_xyz(F.col("lat"), F.col("lon"), radius_km)
    rest, done, reach = a, None, radius_km * math.sqrt(4 * math.pi * k / max(1, n)) / 64
    while True:
        cell = lambda c: F.floor(c / reach)  # noqa: B023, E731
        near = lambda c: F.explode(F.sequence(cell(c - reach), cell(c + reach)))  # noqa: B023, E731
        at = lambda df: df.select("*", *(c.alias(n_) for c, n_ in zip(xyz(), "xyz", strict=True)))
        homes = at(all_).select(F.col("key").alias("near"), F.col("lat").alias("q"), F.col("lon").alias("m"), *(cell(F.col(c)).alias(i) for c, i in zip("xyz", "hij", strict=True)))
        asks = at(rest.df).withColumn("h", near(F.col("x"))).withColumn("i", near(F.col("y"))).withColumn("j", near(F.col("z"))).select("key", "lat", "lon", "h", "i", "j")
        km = great_circle(F.col("lat"), F.col("lon"), F.col("q"), F.col("m"), radius_km)
        # A chord within the reach: cells hold all such pairs.
        met = meet(homes, asks, ["h", "i", "j"]).where("key <> near").withColumn("km", km).where(2 * radius_km * F.sin(F.col("km") / (2 * radius_km)) <= reach)
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("km", "near"))).where(F.col("rank") <= k)
        best = Staged(ranked.withColumn("found", F.count("*").over(Window.partitionBy("key"))).select("key", "near", "km", "found"))
        last = reach > 2 * radius_km
        mine = best.df if last else best.df.where(F.col("found") >= k)
        done = mine if done is None else done.unionByName(mine)
        if not last:
            left = Staged(rest.df.join(mine.select("key").distinct(), "key", "left_anti"))
            last, rest = not left.rows, left
        if last:
            return done.select(F.col("key").cast(kind).alias("key"), "near", "km", (1 / F.pow(F.col("km") + 0.5, 2)).alias("weight"))
        reach *= 2


def neighbour_average(df: DataFrame, series: str, order: str, value: str, near: DataFrame) -> DataFrame:
    """Adds ``<value>_near``: the weighted mean of the neighbours' values one step before; missing ones skipped."""
    w = Window.partitionBy(series).orderBy(order)
    before = df.select(F.col(series).alias("near"), F.col(order).alias("__at"), F.lag(value).over(w).alias("__v"))
    joined = near.join(before, "near").where("__v is not null").groupBy(F.col("key").alias("__key"), "__at").agg((F.sum(F.col("weight") * F.col("__v")) / F.sum("weight")).alias(f"{value}_near"))
    return df.join(joined, (F.col(series) == F.col("__key")) & (F.col(order) == F.col("__at")), "left").drop("__key", "__at")


def same_season(df: DataFrame, series: str, order: str, value: str, season: int, horizon: int, cycles: int = 3) -> DataFrame:
    """Values one, two ... cycles back that are known ``horizon`` steps ahead of time."""
    w, first = Window.partitionBy(series).orderBy(order), -(-horizon // season)
    return df.withColumns({f"{value}_season_{i + 1}": F.lag(value, season * (first + i)).over(w) for i in range(cycles)})


def future_inputs(df: DataFrame, series: str, order: str, value: str, season: int, cycles: int = 8) -> DataFrame:
    """Missing future inputs take the value one cycle before, repeated."""
    w = Window.partitionBy(series).orderBy(order)
    return df.withColumn(value, F.coalesce(value, *(F.lag(value, season * c).over(w) for c in range(1, cycles + 1))))


def baseline_forecasts(df: DataFrame, series: str, order: str, value: str, cutoffs: DataFrame, season: int, horizon: int) -> DataFrame:
    """``series, cutoff, h, actual, naive, seasonal`` for each cut-off (step number of the last known row) and h = 1..horizon.

    Naive: the last known value. Seasonal: the value whole seasons back that is known, else the naive one.
    """
    n = df.withColumn("__n", F.row_number().over(Window.partitionBy(series).orderBy(order)))
    last = n.withColumn("__last", F.last(value, True).over(Window.partitionBy(series).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)))
    steps = cutoffs.select("cutoff", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    keys = n.select(series).distinct().join(F.broadcast(steps))  # a few cut-offs times the horizon
    at = lambda d, name, col: d.select(F.col(series).alias(f"__s_{name}"), F.col("__n").alias(f"__n_{name}"), F.col(col).alias(name))
    out = keys.join(at(n, "actual", value), (F.col(series) == F.col("__s_actual")) & (F.col("cutoff") + F.col("h") == F.col("__n_actual")), "left")
    out = out.join(at(last, "naive", "__last"), (F.col(series) == F.col("__s_naive")) & (F.col("cutoff") == F.col("__n_naive")), "left")
    back = F.col("cutoff") + F.col("h") - season * F.ceil(F.col("h") / season)
    out = out.join(at(n, "seasonal", value), (F.col(series) == F.col("__s_seasonal")) & (back == F.col("__n_seasonal")), "left")
    return out.select(series, "cutoff", "h", "actual", "naive", F.coalesce("seasonal", "naive").alias("seasonal"))


def backtest_cutoffs(steps: int, horizon: int, freq: str, windows: int) -> list[int]:
    """Step numbers of the last known step of each backtest: evenly spread over the last year, each with enough history."""
    last, least = steps - horizon, max(2 * horizon, steps // 3)
    if last < least:
        return []
    first = max(least, last - FREQUENCIES[freq]["year"])
    return sorted({last - round(i * (last - first) / max(1, windows)) for i in range(windows)})


def forecast_errors(df: DataFrame, actual: str, forecasts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``model, n, mae, rmse, bias, mape`` of forecast columns (mape only where over half of the actual values aren't 0)."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("model"), F.col(f).alias("forecast")) for f in forecasts)))
    rows = df.select(*by, F.col(actual).alias("a"), each.alias("e")).select(*by, "a", "e.model", "e.forecast").where("a is not null and forecast is not null")
    err, nz = F.col("forecast") - F.col("a"), F.col("a") != 0
    share = F.avg(nz.cast("double"))
    return rows.groupBy(*by, "model").agg(F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"), F.when(share > 0.5, F.avg(F.when(nz, F.abs(err / F.col("a")))) * 100).alias("mape"))


def uncertainty(df: DataFrame, step: str, error: str, horizon: int, level: float = 0.8, least: int = 5) -> DataFrame:
    """``h, half_width``: the level-quantile of absolute errors pooled over neighbouring steps (a tenth of the horizon to both sides); null under ``least`` errors."""
    near = max(1, horizon // 10)
    rows = df.select(F.explode(F.sequence(F.greatest(F.lit(1), F.col(step) - near), F.least(F.lit(horizon), F.col(step) + near))).alias("h"), F.abs(error).alias("e")).where("e is not null")
    return rows.groupBy("h").agg(F.when(F.count("*") >= least, F.percentile("e", F.lit(level))).alias("half_width"))


def side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "full_outer") -> DataFrame:
    """Rows of two tables with equal keys (place and time) in one row; by default rows of either side alone as well."""
    return left.join(right, list(keys), how)


def guess_roles(columns: Mapping[str, str]) -> dict[str, str | None]:
    """Time, target, series, latitude and longitude columns of a table by their names and types."""
    import re

    low = {c: c.lower() for c in columns}
    pick = lambda pattern, ok=lambda c: True: next((c for c in columns if re.search(pattern, low[c]) and ok(c)), None)
    numeric = lambda c: columns[c] in ("double", "float", "int", "bigint")
    time = pick(r"(^|_)(time|date|datetime|timestamp|month|year|ts)(_|$)")
    lat, lon = pick(r"^lat", numeric), pick(r"^(lon|lng)", numeric)
    series = pick(r"(^|_)(station|name|series|id|site|point|gauge|city)(_|$)", lambda c: not numeric(c) and c != time)
    target = pick(r"(aqi|rain|precip|yield|value|target|price|pm2)", lambda c: numeric(c) and c not in (lat, lon))
    return {"time": time, "series": series, "target": target, "lat": lat, "lon": lon}


def recursive_forecast(df: DataFrame, series: str, order: str, value: str, horizon: int, coefficients: Sequence[float], intercept: float = 0.0) -> DataFrame:
    """``series, h, forecast`` of a linear model on the last p values, each forecast fed back.

    Only the last p values of a series are gathered (a bounded array); the recursion is a fold over the horizon in the JVM.
    """
    p = len(coefficients)
    w = Window.partitionBy(series).orderBy(F.desc(order))
    last = df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= p)
    state = last.groupBy(series).agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", F.col(value).cast("double").alias("v")))), lambda r: r["v"]).alias("__state")).where(F.size("__state") == p)
    weights = F.array(*(F.lit(float(c)) for c in coefficients))

    def step(s: Column, _: Column) -> Column:
        # Newest first; all forecasts are kept in front.
        nxt = F.aggregate(F.zip_with(F.slice(s, 1, p), weights, lambda a, b: a * b), F.lit(float(intercept)), lambda x, y: x + y)
        return F.concat(F.array(nxt), s)

    run = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("__state"), step)
    out = state.select(series, F.slice(run, 1, horizon).alias("f"))
    return out.select(series, F.posexplode(F.reverse("f")).alias("i", "forecast")).select(series, (F.col("i") + 1).alias("h"), "forecast")


def index_series(df: DataFrame, place: str, date: str, scene: str, value: str, clear: str, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """One row a place and date: statistics of plausible clear values of the date's best scene (one with a mean, then the clearest, then the larger scene)."""
    ok = F.col(clear) & F.col(value).between(lo, hi)
    v = F.when(ok, F.col(value))
    stats = df.groupBy(place, date, scene).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("pixels"), (F.avg(F.col(clear).cast("double")) * 100).alias("clear_pct"))
    best = Window.partitionBy(place, date).orderBy(F.col("mean").isNull(), F.desc("clear_pct"), F.desc(scene))
    return stats.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
