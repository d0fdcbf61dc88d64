import numpy as np
from pyspark.sql import functions as F

from loamgrid.operators import quantiles
from loamgrid.operators.quantiles import exact_quantiles

SHARES = (0.0, 0.02, 0.25, 0.5, 0.501, 0.98, 1.0)


def _check(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, {"x": F.col("x")}, SHARES)["x"]
    known = np.array([v for v in values if np.isfinite(v)])
    assert np.allclose(got, np.quantile(known, SHARES), rtol=1e-12, atol=0)


def test_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    _check(spark, rng.normal(size=3000).tolist() + [float("nan"), float("inf")])
    # Stretches that are split several times, equal values and far outliers.
    monkeypatch.setattr(quantiles, "LISTED", 5)
    monkeypatch.setattr(quantiles, "BINS", 4)
    _check(spark, [*rng.integers(0, 3, 900).tolist(), *(10.0 ** rng.integers(-200, 200, 60)).tolist()])
    _check(spark, [7.0] * 50)
    _check(spark, [1.0, 2.0])


def test_ranks_and_empty_columns(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(10)], "x double, y double")
    got = exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, (0.5, lambda n: n // 2))
    assert got == {"x": [4.5, 5.0], "y": [None, None]}
    assert exact_quantiles(df.limit(0), {"x": F.col("x")}, (0.5,)) == {"x": [None]}
