"""Totals over trailing periods by binary doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.timeparse import clean_key, clean_number, each_known, wall_seconds

MICRO = 1_000_000


def latest_readings(df: DataFrame, series: str, time_text: str, value: str, received: str, missing: Sequence[float] = (-999.0,)) -> DataFrame:
    """One row ``series, at, value`` for each series and time: the row received last holds, missing or not.

    Rows without a readable time or a series are left out; of rows received at the same instant the one with
    the larger value holds, so repeated rows have no effect.
    """
    rows = df.select(
        clean_key(F.col(series)).alias("series"),
        each_known(wall_seconds(F.col(time_text))).alias("at"),
        F.struct(F.col(received).alias("received"), clean_number(F.col(value), *missing).alias("value")).alias("sent"),
    ).where(F.col("series").isNotNull())
    return rows.groupBy("series", "at").agg(F.max("sent").alias("sent")).select("series", "at", F.col("sent.value").alias("value"))


def daily_totals(readings: DataFrame) -> DataFrame:
    """``series, day, micro`` for every day from a series' first to its last day with a value.

    ``day`` counts from 1970-01-01; ``micro`` is the day's total in millionths (whole numbers add up exactly
    in any order), 0 for days without activity. The readings are summed to days before any row is ordered, so
    a series with most of the rows still has but one row a day in its window.
    """
    daily = readings.where(F.col("value").isNotNull()).groupBy("series", F.floor(F.col("at") / 86400).cast("int").alias("day"))
    daily = daily.agg(F.sum(F.round(F.col("value") * MICRO).cast("long")).alias("micro"))
    following = F.lead("day").over(Window.partitionBy("series").orderBy("day"))
    last = F.coalesce(following - 1, F.col("day"))
    gaps = daily.withColumn("each", F.sequence("day", last))
    return gaps.select("series", F.explode("each").alias("at_day"), "day", "micro").select(
        "series", F.col("at_day").alias("day"), F.when(F.col("at_day") == F.col("day"), F.col("micro")).otherwise(0).cast("long").alias("micro")
    )


def doubling_sums(df: DataFrame, series: str, order: str, value: str, windows: Sequence[int]) -> DataFrame:
    """Adds ``sum_<n>`` for each n of ``windows``: the sum of ``value`` over the last n rows of the series.

    The rows must be regular (one for each step). Block sums of 1, 2, 4, 8 ... rows come from the block half as
    long and the same block shifted; any window is put together from the blocks of its binary digits. All
    shifts share one ordering: one shuffle and one sort, and work that grows with log2 of the window.
    """
    w = Window.partitionBy(series).orderBy(order)
    shifted = lambda c, n: F.lag(c, n, 0).over(w) if n else F.col(c)
    size, blocks = 1, {1: value}
    while size * 2 <= max(windows):
        name = f"__block_{size * 2}"
        df = df.withColumn(name, F.col(blocks[size]) + shifted(blocks[size], size))
        size *= 2
        blocks[size] = name
    for n in windows:
        total, done = None, 0
        for size in sorted(blocks, reverse=True):
            if n & size:
                part = shifted(blocks[size], done)
                total, done = part if total is None else total + part, done + size
        df = df.withColumn(f"sum_{n}", total)
    return df.drop(*(b for s, b in blocks.items() if s > 1))


def trailing_totals(df: DataFrame, series: str, time_text: str, value: str, received: str, windows: Sequence[int] = (7, 30), missing: Sequence[float] = (-999.0,)) -> DataFrame:
    """Each series and day with its total and the totals and averages over the last n days of ``windows``.

    Columns: series, day (int, days since 1970-01-01), since (days after the first), total, and for each n
    total_n, mean_n. An average is over the days of the period that exist (fewer than n at a series' start).
    Unreadable times, missing values and null series are left out; an empty table gives an empty one.
    Columns of ``df`` beyond those named are ignored, whatever their names.
    """
    days = daily_totals(latest_readings(df, series, time_text, value, received, missing))
    w = Window.partitionBy("series").orderBy("day")
    sums = doubling_sums(days, "series", "day", "micro", windows).withColumn("since", F.row_number().over(w) - 1)
    out = [F.col("series"), F.col("day"), F.col("since"), (F.col("micro") / MICRO).alias("total")]
    for n in windows:
        out += [F.col(f"sum_{n}").alias(f"micro_{n}"), (F.col(f"sum_{n}") / MICRO).alias(f"total_{n}"), (F.col(f"sum_{n}") / MICRO / F.least(F.lit(n), F.col("since") + 1)).alias(f"mean_{n}")]
    return sums.select(*out)
