import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loamgrid.functions.timeparse import wall_seconds, wall_text
from loamgrid.operators.rolling import doubling_sums, trailing_totals

SCHEMA = "gauge string, date_text string, rain double, received_at timestamp_ntz, series string, day int, at int"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2026-01-02T17:00", "2026-01-02T17:00"), ("2026-01-02 10:47:13", "2026-01-02T10:47"), ("01-02-2026 00:00", "2026-02-01T00:00"), ("31/08/2026 21:45:26", "2026-08-31T21:45"),
        ("2026-01-02T11:00:00+05:30", "2026-01-02T11:00"), ("20250402", "2025-04-02T00:00"), ("2025-04-01", "2025-04-01T00:00"), ("1/2/2025", "2025-02-01T00:00"), ("2024-02-29", "2024-02-29T00:00"),
        ("2023-02-29", None), ("NaT", None), ("n/a", None), ("", None), (None, None), ("31-04-2025", None), ("2025-01-01 24:00", None), ("2025-01-01 10:60", None), ("x" * 100_000, None),
    ],
)
def test_wall_clock(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(wall_text(wall_seconds(F.col("t"))).alias("w")).first().w
    assert got == want


def _brute(rows):
    last = {}
    for g, at, v, r in rows:
        key = (g.strip().upper(), at)
        if key not in last or (r, v is not None, v or 0) > last[key][0]:
            last[key] = ((r, v is not None, v or 0), v)
    days = {}
    for (g, at), (_, v) in last.items():
        if v is not None:
            d = days.setdefault(g, {})
            d[at.date()] = d.get(at.date(), 0) + round(v * 10)
    out = {}
    for g, d in days.items():
        day, n = min(d), 0
        while day <= max(d):
            out[g, str(day)] = tuple(sum(d.get(day - timedelta(days=k), 0) for k in range(w) if day - timedelta(days=k) >= min(d)) for w in (1, 7, 30)) + (n,)
            day, n = day + timedelta(days=1), n + 1
    return out


def test_totals_against_brute_force(spark):
    rng = random.Random(3)
    start = datetime(2025, 1, 1)
    rows = []
    for _ in range(1500):
        at = start + timedelta(days=rng.choice([0, 1, 5, 40, 41, rng.randrange(90)]), hours=rng.choice([8, 17]))
        # A third of all rows belong to one gauge.
        rows.append((rng.choice(["a ", "A", " b", "c", "a"]), at, rng.choice([None, 0.0, 1.5, 2.25 // 0.1 / 10, 30.1]), start + timedelta(days=rng.randrange(200))))
    rows += rows[:50]
    df = spark.createDataFrame([(g, at.strftime(rng.choice(["%Y-%m-%dT%H:%M", "%d/%m/%Y %H:%M:%S", "%d-%m-%Y %H:%M"])), v, r, "clash", 1, 2) for g, at, v, r in rows], SCHEMA)
    got = trailing_totals(df, "gauge", "date_text", "rain", "received_at").collect()
    want = _brute(rows)
    assert len(got) == len(want)
    for r in got:
        day = str((datetime(1970, 1, 1) + timedelta(days=r.day)).date())
        total, w7, w30, since = want[r.series, day]
        assert (round(r.total * 10), round(r.total_7 * 10), round(r.total_30 * 10), r.since) == (total, w7, w30, since)
        assert r.mean_30 == pytest.approx(w30 / 10 / min(30, since + 1))


def test_latest_row_holds_even_if_missing(spark):
    t = datetime(2025, 5, 1)
    df = spark.createDataFrame([("g", "2025-05-01", 5.0, t, None, None, None), ("g", "20250501", None, t + timedelta(hours=1), None, None, None), ("g", "2025-05-02", 1.0, t, None, None, None)], SCHEMA)
    assert [r.total for r in trailing_totals(df, "gauge", "date_text", "rain", "received_at").collect()] == [1.0]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "2025-05-01", 5.0, None, None, None, None), ("g", None, 5.0, None, None, None, None), ("g", "2025-05-01", float("nan"), None, None, None, None), ("g", "2025-05-01", -999.0, None, None, None, None)], SCHEMA)
    assert trailing_totals(df, "gauge", "date_text", "rain", "received_at").count() == 0
    assert trailing_totals(df.limit(0), "gauge", "date_text", "rain", "received_at").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 31, 64])
def test_any_window(spark, n):
    df = spark.createDataFrame([("s", i, i * i) for i in range(100)], "series string, day int, v long")
    got = {r.day: r[f"sum_{n}"] for r in doubling_sums(df, "series", "day", "v", (n,)).collect()}
    assert got == {i: sum(k * k for k in range(max(0, i - n + 1), i + 1)) for i in range(100)}
