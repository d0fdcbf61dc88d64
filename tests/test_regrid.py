from datetime import datetime

from pyspark.sql import functions as F

from loamgrid.functions.timeparse import wall_text
from loamgrid.operators.regrid import reading_bounds, regular_grid, step_values, step_widths

SCHEMA = "station string, time_text string, aqi double, received_at timestamp_ntz, series string, step int, width int, value double"
T0 = datetime(2026, 1, 1)


def _grid(spark, rows, bounds=False, max_fill=2):
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3.0) for r in rows], SCHEMA)
    steps = step_widths(spark.createDataFrame([("st1", 60), ("ST1 ", 60), ("st2", 15), (None, 60)], "station string, step_minutes int"))
    values = step_values(df, steps, "station", "time_text", "aqi", "received_at")
    g = regular_grid(values, max_fill, reading_bounds(df, steps, "station", "time_text") if bounds else None)
    return {(r.series, r.period): (r.value, r.status) for r in g.select("series", wall_text(F.col("step") * F.col("width")).alias("period"), "value", "status").collect()}


def test_gaps_are_filled_or_marked(spark):
    rows = [
        (" st1", "2026-01-01T00:10", 10.0, T0), ("ST1", "2026-01-01 00:40:00", 20.0, T0), ("st1", "01-01-2026 03:05", 60.0, T0), ("st1", "01/01/2026 07:00:00", 100.0, T0),
        ("st1", "2026-01-01T05:00", None, T0), ("st1", "2026-01-01T05:30", float("nan"), T0), ("st1", "NaT", 5.0, T0), ("st1", "2026-01-01T09:00", -999.0, T0), (None, "2026-01-01T01:00", 1.0, T0),
    ]
    got = _grid(spark, rows + rows, bounds=True)
    p = lambda h: ("ST1", f"2026-01-01T{h:02d}:00")
    assert got == {p(0): (15.0, "observed"), p(1): (30.0, "filled"), p(2): (45.0, "filled"), p(3): (60.0, "observed"), p(4): (None, "missing"), p(5): (None, "missing"), p(6): (None, "missing"), p(7): (100.0, "observed"), p(8): (None, "outside"), p(9): (None, "outside")}


def test_latest_value_of_an_instant_holds(spark):
    rows = [("st2", "2026-01-01T00:01", 1.0, T0), ("st2", "2026-01-01T00:01:00", 9.0, datetime(2026, 1, 2)), ("st2", "2026-01-01T00:01", None, datetime(2026, 1, 3))]
    assert _grid(spark, rows) == {("ST2", "2026-01-01T00:00"): (9.0, "observed")}


def test_empty_and_unknown_station(spark):
    assert _grid(spark, []) == {}
    assert _grid(spark, [("other", "2026-01-01T00:01", 1.0, T0)]) == {}
    assert _grid(spark, [("st1", "2026-01-01T00:01", None, T0)], bounds=True) == {}
