from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import forecasting as S
from loamgrid.operators import learning as L
from loamgrid.operators import supervised as M


@pytest.fixture(scope="module")
def hourly(spark):
    rng, t0 = np.random.default_rng(1), datetime(2026, 1, 1)
    rows = []
    for s in range(3):
        for h in range(24 * 20):
            v = 50 + 10 * s + 20 * np.sin(2 * np.pi * (h - 3 * s) / 24) + float(rng.normal(0, 1))
            rows.append((f"st{s}", t0 + timedelta(hours=h), None if h % 97 == 5 else float(v)))
    return spark.createDataFrame(rows, "s string, at timestamp_ntz, y double")


def test_feature_rows_know_nothing_of_the_future(spark):
    df = spark.createDataFrame([("a", datetime(2026, 1, 1) + timedelta(days=i), float(i) if i != 4 else None) for i in range(20)], "s string, at timestamp_ntz, y double")
    rows, names = S.feature_rows(df, "s", "at", "y", "D", (1, 3), (1,), (3,))
    got = {(r.origin, r.lead): r for r in rows.collect()}
    assert len(got) == 40 and "y_last" in names and "lead" in names
    r = got[10, 3]
    assert (r.y_last, r.y_lag_1, r.target, r.y_season, r.y_mean_3) == (9.0, 8.0, 12.0, 5.0, 8.0)
    assert got[4, 1].target is None and got[5, 1].y_last is None and got[20, 1].target is None
    assert got[20, 3].at == datetime(2026, 1, 23) and got[3, 1].y_season is None


def test_report_sets_models_beside_the_baselines(hourly):
    report = {r.model: r for r in S.backtest(hourly, "s", "at", "y", "h", [400, 440], 24, ("linear",), leads=(1, 12, 24), lags=(1, 2, 24), windows=(3, 24)).collect()}
    assert set(report) == {"linear", "naive", "seasonal"} and report["linear"].n == 18
    # A pure daily wave: the value a day before is as good as the noise allows, so only the last value is beaten, and the skill says so.
    best = min(report["naive"].mae, report["seasonal"].mae)
    assert report["linear"].mae < 2.5 and report["linear"].mae < report["naive"].mae
    assert report["linear"].skill == pytest.approx(1 - report["linear"].mae / best) and max(report["naive"].skill, report["seasonal"].skill) == 0


def test_saved_models_early_stopping_and_tuning(hourly, tmp_path):
    from pyspark.ml import PipelineModel

    rows, names = S.feature_rows(hourly, "s", "at", "y", "h", (1, 6), (1, 24), (3,))
    model = S.train(rows, names, "linear")
    model.save(str(tmp_path / "m"))
    last = S.latest(rows, "s")
    a, b = ({(r.s, r.lead): r.forecast for r in S.predict(m, last, names, "s").collect()} for m in (model, PipelineModel.load(str(tmp_path / "m"))))
    assert a == b and len(a) == 6
    assert abs(sum(v for _, v in S.importance(model, names)) - 1) < 1e-9
    short = S.train(rows, names, "gbt", validation=0.15, maxIter=6, maxDepth=2)
    assert 1 <= short.stages[-1].getNumTrees <= 6
    best, mae = S.tune(rows, names, "linear", [{"regParam": 1e6}, {"regParam": 0.0}], "s")
    assert best == {"regParam": 0.0} and mae < 3


def test_classifiers_of_every_kind(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "abc"[c], "test" if i % 4 == 0 else "train", *map(float, rng.normal([0, 6, 12][c], 1, 2))) for i, c in enumerate(rng.integers(0, 3, 240).tolist())]
    df = spark.createDataFrame(rows, "id long, label string, split string, p double, q double")
    board = {r.model: r.accuracy for r in M.compare(df, "label", ["p", "q"], ("rf", "dt", "nb", "lr", "mlp")).collect()}
    assert len(board) == 5 and min(board.values()) > 0.9
    cv = M.cross_validate(df, "label", ["p", "q"], "dt", F.col("id"), 3).collect()
    assert sum(r.n for r in cv) == 240 and min(r.accuracy for r in cv) > 0.9
    model = M.fit(df, "label", ["p", "q"], "rf")
    shares = M.permutation_importance(model, df, "label", ["p", "q"], "id", repeats=1)
    assert {f for f, _ in shares} == {"p", "q"} and all(0 <= v <= 1 for _, v in shares)
    out, _ = M.classify_raster(df, "label", ["p", "q"], "id", per_class=20)
    assert out.where("label = predicted").count() > 215 and sum(r.percent for r in M.class_shares(out).collect()) == pytest.approx(100)
    assert {r.label: r["count"] for r in M.exact_per_class(df, "label", 7, "id", parts=3).groupBy("label").count().collect()} == dict.fromkeys("abc", 7)
    votes = M.vote_unfitted(df.where("id % 2 = 0").select("label", "p", "q"), df.where("id % 2 = 1").select("id", "p", "q", F.col("label").alias("own")), ["p", "q"], "label")
    assert votes.where("own = label").count() == votes.count() > 100


def test_distances_merges_and_trust(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 20)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(99, None, 1.0)], "k long, a double, b double")
    got, eps = M.k_distances(df, "k", ["a", "b"], 4)
    d = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), 1)[:, 4]
    assert np.allclose(got["d"], np.sort(d)) and 0 < eps <= d.max()
    z = M.linkage(x)
    assert len(z) == 59 and (np.diff(z[:, 2]) >= -1e-12).all() and z[-1, 3] == 60 and z[-1, 2] > 10 and z[-3, 2] < 2
    own = M.spectral(x, 3, near=5)
    assert all(len(set(own[a : a + 20].tolist())) == 1 for a in (0, 20, 40)) and len(set(own.tolist())) == 3
    assert M.trustworthiness(x, x) == 1.0 and M.trustworthiness(x, rng.normal(size=(60, 2))) < 0.8
    assert L.cluster_quality(df.dropna().withColumn("c", F.floor(F.col("k") / 20)), "c", ["a", "b"]).first().davies_bouldin < 0.2
