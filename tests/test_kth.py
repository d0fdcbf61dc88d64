import numpy as np

from loamgrid.operators import supervised as M


def test_distances_to_the_kth_of_one_value(spark, monkeypatch):
    monkeypatch.setattr(M, "SORTED_ROWS", 7)
    v = np.round(np.random.default_rng(9).normal(0, 5, 60), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(90, None)], "k long, x double")
    d = np.abs(v[:, None] - v[None])
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, 3]
    got = {r.key: r.d for r in M.kth_distances(df, "k", "x", 4).collect()}
    assert set(got) == set(range(60)) and all(np.isclose(got[i], want[i]) for i in range(60))
    assert [r.d for r in M.kth_distances(df.where("k < 3"), "k", "x", 4).collect()] == [None] * 3
