import random

import numpy as np

from loamgrid.llm import clusters
from loamgrid.llm.clusters import GridClusters

COLS = ["sample_id", "a", "b", "c", "k1", "n", "first"]
SCHEMA = "sample_id long, a double, b double, c double, k1 string, n string, first string"


def _data(seed, clusters=25, noise=60):
    rng = np.random.default_rng(seed)
    centres, rows = [], []
    while len(centres) < clusters:
        c = rng.uniform(0, 1, 3)
        if all(np.linalg.norm(c - o) > 0.05 for o in centres):
            centres.append(c)
    for i, c in enumerate(centres):
        for _ in range(300 if i == 0 else int(rng.integers(3, 20))):
            v = rng.normal(size=3)
            rows.append(tuple(c + v / np.linalg.norm(v) * 0.0099 * rng.uniform()))
    while noise:
        c = rng.uniform(0, 1, 3)
        if all(np.linalg.norm(c - o) > 0.05 for o in rows):
            rows.append(tuple(c))
            noise -= 1
    rows += rows[:10]  # copies
    order = list(range(len(rows)))
    random.Random(seed).shuffle(order)
    return [(order[i], *map(float, r)) for i, r in enumerate(rows)]


def _brute(rows, eps, least):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    return {(int(ids[near[i]].min()), int(ids[i])) for i in range(len(rows)) if near[i].sum() >= least}


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = _data(seed)
        bad = [(10_001, None, 0.1, 0.1), (10_002, float("nan"), 0.1, 0.1), (10_003, -9999.0, 0.1, 0.1), (10_004, float("inf"), 0.1, 0.1), (None, 0.5, 0.5, 0.5)]
        g = GridClusters(_frame(spark, rows + bad), "sample_id", ["a", "b", "c"], 0.02, 8)
        got = [(r.cluster_id, r.id) for r in g.members().collect()]
        assert len(got) == len(set(got))
        assert set(got) == _brute(rows, 0.02, 8)
        # The same without a broadcast.
        assert {(r.cluster_id, r.id) for r in g.members(broadcast_rows=0).collect()} == set(got)


def test_description(spark):
    rows = _data(3)
    g = GridClusters(_frame(spark, rows), "sample_id", ["a", "b", "c"], 0.02, 8)
    want = {}
    for c, i in _brute(rows, 0.02, 8):
        want.setdefault(c, set()).add(i)
    got = {r.cluster_id: r for r in g.describe(3).collect()}
    assert set(got) == set(want)
    for c, r in got.items():
        assert r.cluster_rows == len(want[c])
        assert set(r.typical) <= want[c] and 1 <= len(r.typical) == min(3, r.core_rows)


def test_chains_join_and_edges_of_cells(spark):
    # Cells of a chain whose neighbours are near form one cluster, however long it is.
    rows = [(i, 0.008 * i, 0.5, 0.5) for i in range(120)]
    g = GridClusters(_frame(spark, rows), "sample_id", ["a", "b", "c"], 0.02, 2)
    assert {r.cluster_id for r in g.members().collect()} == {0}
    assert g.members().count() == 120


def test_empty_and_negative(spark):
    assert GridClusters(_frame(spark, []), "sample_id", ["a", "b", "c"], 0.02, 8).members().count() == 0
    rows = [(i, -0.5, -1.0, 0.0) for i in range(9)]
    assert GridClusters(_frame(spark, rows), "sample_id", ["a", "b", "c"], 0.02, 8).members().count() == 9


def test_wide_small_clusters_at_any_origin(spark):
    # Three groups of three rows nearly a diameter apart: the middle of each pair lies in a block that holds few rows.
    rows = [(3 * g + k, x + k * 1e-4, y, 0.0) for g, (x, y) in enumerate([(-0.2, -0.2), (0.52, -0.17), (-0.17, 0.52)]) for k in range(3)]
    for shift in (0.0, 100.7, 0.31, -3.3):
        g = GridClusters(_frame(spark, [(i, a + shift, b + shift, c) for i, a, b, c in rows]), "sample_id", ["a", "b"], 1.0, 8)
        assert sorted(r.id for r in g.members().collect()) == list(range(9)), shift


def test_random_wide_clusters_at_random_origins(spark):
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for c in range(150):
        # Eight to ten rows at full diameter around a random centre, clusters far apart.
        centre, n = rng.uniform(-1, 1, 3) + np.array([10.0 * c, 0, 0]), int(rng.integers(8, 11))
        v = rng.normal(size=(n, 3))
        points = centre + v / np.linalg.norm(v, axis=1)[:, None] * 0.577 * 0.99
        if max(np.linalg.norm(points[:, None] - points[None], axis=2).ravel()) > 0.99:
            points = centre + (points - centre) * 0.85
        for k in range(n):
            rows.append((100 * c + k, *map(float, points[k])))
            want.add((100 * c, 100 * c + k))
    got = {(r.cluster_id, r.id) for r in GridClusters(_frame(spark, rows), "sample_id", ["a", "b", "c"], 1.0, 8).members().collect()}
    assert got == want


def test_full_blocks_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_CELLS", 3)
    rows = _data(4)
    assert {(r.cluster_id, r.id) for r in GridClusters(_frame(spark, rows), "sample_id", ["a", "b", "c"], 0.02, 8).members().collect()} == _brute(rows, 0.02, 8)
