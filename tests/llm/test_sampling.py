import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loamgrid.llm.sampling import TargetSample, letters, request_targets

ROWS = "pool long, kind string, category string, r int, c int, id long, complete boolean, u double, needed long, gid string"
TARGETS = "request_id long, pool long, kind string, category string, needed long, complete_only boolean"


def _rows(seed=1):
    rng, rows = random.Random(seed), []
    for i in range(6000):
        # Pool 1 has a third of all rows.
        pool = rng.choice([1, 1, 2, 3, 4, 5])
        cat = rng.choice(["paddy", "ragi", "ragi", "ragi", None])
        rows.append((pool, "crop", cat, rng.randrange(60), rng.choice([None, *range(40)]), i, rng.random() < 0.9, 1.0, 2, "x"))
    return rows


TARGET_ROWS = [(10, 1, "crop", "paddy", 50, False), (10, 1, "crop", "ragi", 300, False), (11, 1, "crop", "ragi", 10**6, True), (12, 2, "crop", "maize", 5, False), (13, None, "crop", "ragi", 5, False), (14, 3, "crop", "ragi", 0, False), (15, 4, "crop", "ragi", 100, True)]


def _available(rows):
    places = defaultdict(set)
    for pool, kind, cat, r, c, _, complete, *_ in rows:
        if cat and c is not None:
            places[pool, kind, cat, False].add((r, c))
            if complete:
                places[pool, kind, cat, True].add((r, c))
    return places


def _sample(spark, rows, targets=TARGET_ROWS, **options):
    return TargetSample(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(rows, ROWS), ["r", "c"], **options)


def test_counts_are_exact_and_deficits_reported(spark):
    rows = _rows()
    places = _available(rows)
    s = _sample(spark, rows)
    want = {(q, cat): (need, len(places[p, k, cat, full])) for q, p, k, cat, need, full in TARGET_ROWS}
    assert {(r.request_id, r.category): (r.needed, r.available) for r in s.plan().collect()} == want
    assert {(r.request_id, r.category): r.drawn for r in s.report().collect()} == {k: min(n, a) for k, (n, a) in want.items()}
    assert {(r.request_id, r.category): r.deficit for r in s.deficits().collect()} == {k: n - a for k, (n, a) in want.items() if a < n}
    drawn = s.draw().collect()
    assert Counter((r.request_id, r.category) for r in drawn) == Counter({k: min(n, a) for k, (n, a) in want.items() if min(n, a)})
    by_id = {r[5]: r for r in rows}
    seen = set()
    for r in drawn:
        row = by_id[r.id]
        assert (row[2], row[3], row[4]) == (r.category, r.r, r.c)
        assert row[6] or r.request_id not in (11, 15)
        assert (r.request_id, r.category, r.r, r.c) not in seen
        seen.add((r.request_id, r.category, r.r, r.c))


def test_the_same_draw_at_every_run_and_without_broadcast(spark):
    rows = _rows(2)
    a = {tuple(r) for r in _sample(spark, rows).draw().collect()}
    b = {tuple(r) for r in _sample(spark, rows[::-1], broadcast_rows=0).draw().collect()}
    assert a == b and a


def test_empty(spark):
    s = _sample(spark, [])
    assert s.draw().count() == 0
    assert {r.available for r in s.plan().collect()} == {0}
    assert _sample(spark, _rows(), []).draw().count() == 0


def test_requests_and_letters(spark):
    req = spark.createDataFrame([(1, "a.tif", "crop", " Stratified ", 250, None, None), (2, "a.tif", "crop", "random", 250, 5, True), (3, "b.tif", "label", "STRATIFIED", 100, 7, True)], "request_id long, raster_path string, label_name string, sampling string, sample_size long, per_class long, drop_nodata boolean")
    tgt = spark.createDataFrame([(1, "paddy", 33), (1, "paddy", 33), (1, "ragi", 67), (2, "ragi", 100), (3, "water", 1)], "request_id long, category string, share_pct int")
    sc = spark.createDataFrame([(7, "a.tif")], "scene_id long, raster_path string")
    got = {(r.request_id, r.category): (r.pool, r.needed, r.complete_only) for r in request_targets(req, tgt, sc).collect()}
    assert got == {(1, "paddy"): (7, 83, False), (1, "ragi"): (7, 168, False), (3, "water"): (None, 7, True)}
    words = spark.createDataFrame([(" Crop_land-",), ("",), ("--",), (None,)], "w string").select(letters(F.col("w")).alias("w"))
    assert [r.w for r in words.collect()] == ["cropland", None, None, None]
