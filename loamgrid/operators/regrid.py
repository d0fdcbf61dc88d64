"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.timeparse import clean_key, clean_number, each_known, wall_seconds


def step_values(df: DataFrame, steps: DataFrame, series: str, time_text: str, value: str, received: str, missing=(-999.0,)) -> DataFrame:
    """``series, width, step, value`` for each series and step that has a value.

    ``steps`` gives ``series, width`` (seconds). A step's value is the mean of its readings; of several valued
    rows for one instant the one received last counts. Aggregated before anything is ordered.
    """
    rows = df.select(
        clean_key(F.col(series)).alias("series"),
        each_known(wall_seconds(F.col(time_text))).alias("at"),
        F.struct(F.col(received).alias("received"), clean_number(F.col(value), *missing).alias("value")).alias("sent"),
    ).where(F.col("series").isNotNull() & F.col("sent.value").isNotNull())
    readings = rows.groupBy("series", "at").agg(F.max("sent").alias("sent"))
    onto = readings.join(steps, "series").withColumn("step", F.floor(F.col("at") / F.col("width")))
    return onto.groupBy("series", "width", "step").agg(F.avg("sent.value").alias("value"))


def regular_grid(values: DataFrame, max_fill: int = 3, bounds: DataFrame | None = None) -> DataFrame:
    """Every step from a series' first to its last step with a value, as ``series, width, step, value, status``.

    Consecutive valued steps are paired with ``lead`` and only the grid times between them are generated.
    Steps inside a gap of at most ``max_fill`` empty steps are interpolated on the straight line (status
    ``filled``); those of longer gaps stay null (``missing``); steps with readings are ``observed``.
    ``bounds`` (``series, lo, hi`` steps) extends each series explicitly: the steps before the first and after
    the last value come out as ``outside`` with null. A series has one row a step in its window, however many
    readings it had. A series without a value has no grid; an empty table gives an empty one.
    """
    w = Window.partitionBy("series").orderBy("step")
    pairs = values.select("*", F.lead("step").over(w).alias("next"), F.lead("value").over(w).alias("next_value"))
    gap = F.coalesce(F.col("next") - F.col("step"), F.lit(1)).cast("long")
    each = pairs.withColumn("gap", gap).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gap") - 1)))
    line = F.col("value") + (F.col("next_value") - F.col("value")) * F.col("i") / F.col("gap")
    grid = each.select(
        "series",
        "width",
        (F.col("step") + F.col("i")).alias("step"),
        F.when(F.col("i") == 0, F.col("value")).when(F.col("gap") - 1 <= max_fill, line).alias("value"),
        F.when(F.col("i") == 0, "observed").when(F.col("gap") - 1 <= max_fill, "filled").otherwise("missing").alias("status"),
    )
    if bounds is None:
        return grid
    ends = values.groupBy("series", "width").agg(F.min("step").alias("first"), F.max("step").alias("last")).join(bounds, "series")
    run = lambda a, b: F.when(F.col(a) <= F.col(b), F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
    ends = ends.withColumn("before", F.col("first") - 1).withColumn("after", F.col("last") + 1)
    outside = ends.select("series", "width", F.explode(F.concat(run("lo", "before"), run("after", "hi"))).alias("step"))
    return grid.unionByName(outside.select("*", F.lit(None).cast("double").alias("value"), F.lit("outside").alias("status")))


def reading_bounds(df: DataFrame, steps: DataFrame, series: str, time_text: str) -> DataFrame:
    """``series, lo, hi``: the steps of the first and last row with a readable time, with a value or without."""
    rows = df.select(clean_key(F.col(series)).alias("series"), each_known(wall_seconds(F.col(time_text))).alias("at")).where("series is not null")
    ends = rows.groupBy("series").agg(F.min("at").alias("a"), F.max("at").alias("b")).join(steps, "series")
    return ends.select("series", F.floor(F.col("a") / F.col("width")).alias("lo"), F.floor(F.col("b") / F.col("width")).alias("hi"))


def step_widths(stations: DataFrame, series: str = "station", minutes: str = "step_minutes") -> DataFrame:
    """``series, width`` in seconds; one row a series (the least width, should a name repeat)."""
    return stations.select(clean_key(F.col(series)).alias("series"), (F.col(minutes) * 60).cast("long").alias("width")).where("series is not null and width > 0").groupBy("series").agg(F.min("width").alias("width"))
