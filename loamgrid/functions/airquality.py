"""The Indian air-quality index: sub-indices and trailing means."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Published breakpoints of concentration (ug/m3, CO in mg/m3) and of the index, and averaging hours.
SCALE = (0, 50, 100, 200, 300, 400, 500)
BREAKPOINTS = {
    "PM2.5": (0, 30, 60, 90, 120, 250, 380),
    "PM10": (0, 50, 100, 250, 350, 430, 600),
    "NO2": (0, 40, 80, 180, 280, 400, 600),
    "SO2": (0, 40, 80, 380, 800, 1600, 2400),
    "CO": (0, 1, 2, 10, 17, 34, 50),
    "O3": (0, 50, 100, 168, 208, 748, 1000),
}
HOURS = {"PM2.5": 24, "PM10": 24, "NO2": 24, "SO2": 24, "CO": 8, "O3": 8}


def sub_index(pollutant: str, conc: Column) -> Column:
    """Linear between breakpoints, at most 500."""
    points = BREAKPOINTS[pollutant]
    out = F.when(conc <= points[0], F.lit(0.0))
    for i in range(len(points) - 1):
        a, b, x, y = points[i], points[i + 1], SCALE[i], SCALE[i + 1]
        out = out.when(conc <= b, x + (y - x) * (conc - a) / (b - a))
    return out.otherwise(F.when(conc.isNotNull(), 500.0))


def trailing_mean(value: Column, series: str, order: str, steps: int, least: float = 0.75) -> Column:
    """Mean of the last ``steps`` rows, this one included; null in the first steps - 1 rows and where under ``least`` of them have a value."""
    w = Window.partitionBy(series).orderBy(order)
    span = w.rowsBetween(1 - steps, 0)
    return F.when((F.row_number().over(w) >= steps) & (F.count(value).over(span) >= least * steps), F.avg(value).over(span))


def with_aqi(df: DataFrame, series: str, order: str, pollutants: Mapping[str, str]) -> DataFrame:
    """Adds ``aqi`` (int) and ``main_pollutant`` to a regular hourly panel; ``pollutants`` maps names to columns.

    Needs PM2.5 or PM10 and at least three sub-indices; the index is the largest one, rounded half-even; of equal ones the
    first in BREAKPOINTS' order is the main one. One ordering serves all windows.
    """
    names = [p for p in BREAKPOINTS if p in pollutants]
    means = df.withColumns({f"__mean_{i}": trailing_mean(F.col(pollutants[p]), series, order, HOURS[p]) for i, p in enumerate(names)})
    subs = means.withColumns({f"__sub_{i}": sub_index(p, F.col(f"__mean_{i}")) for i, p in enumerate(names)})
    cols = [F.col(f"__sub_{i}") for i in range(len(names))]
    known = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    dust = [c.isNotNull() for p, c in zip(names, cols, strict=True) if p in ("PM2.5", "PM10")]
    ok = (known >= 3) & (dust[0] | dust[1] if len(dust) > 1 else dust[0] if dust else F.lit(False))
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    main = F.coalesce(*(F.when(c == top, F.lit(p)) for p, c in zip(names, cols, strict=True)))
    out = subs.withColumn("aqi", F.when(ok, F.bround(top).cast("int"))).withColumn("main_pollutant", F.when(ok, main))
    return out.drop(*(f"__mean_{i}" for i in range(len(names))), *(f"__sub_{i}" for i in range(len(names))))
