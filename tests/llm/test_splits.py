import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loamgrid.llm import splits
from loamgrid.llm.queries import p6_found, p6_shares, p6_splits
from loamgrid.llm.splits import grouped_split, hash_to_min, rendezvous, star_edges


def _components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_hash_to_min_against_union_find(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5000, 5000 + i) for i in range(1, 300)]
    loose = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    edges = [e for e in chain + star + loose + loose[:20] if e[0] != e[1]] + [(7, 7)]
    got = {r.node: r.component for r in hash_to_min(spark.createDataFrame(edges, "src long, dst long")).df.collect()}
    assert got == _components([e for e in edges if e[0] != e[1]])
    assert hash_to_min(spark.createDataFrame([], "src long, dst long")).df.count() == 0


def test_star_edges_join_all_nodes_of_a_place(spark):
    rows = [(5, 1, 1), (3, 1, 1), (9, 1, 1), (3, 1, 1), (None, 1, 1), (4, None, 2), (6, None, 2), (8, 2, 2)]
    got = {tuple(r) for r in star_edges(spark.createDataFrame(rows, "p long, x int, y int"), "p", "x", "y").collect()}
    assert got == {(3, 5), (3, 9)}


def test_rendezvous_shares_and_stability(spark):
    df = spark.range(20_000)
    a = df.select("id", rendezvous(F.col("id"), {"train": 0.8, "validation": 0.1, "test": 0.1}).alias("s"))
    n = Counter(r.s for r in a.collect())
    assert abs(n["train"] / 20_000 - 0.8) < 0.02 and abs(n["test"] / 20_000 - 0.1) < 0.01
    # A larger test share moves rows into test only.
    b = df.select("id", rendezvous(F.col("id"), {"train": 0.8, "validation": 0.1, "test": 0.2}).alias("t"))
    assert a.join(b, "id").where("s <> t and t <> 'test'").count() == 0


def test_groups_stay_together(spark):
    rng = random.Random(4)
    schema = "sample_id long, poly long, tile string, r int, group_id string, node string, component string"
    rows = [(i, rng.choice([0, None, *range(1, 60)]), rng.choice("ab"), rng.randrange(25), "x", "y", "z") for i in range(900)]
    df = spark.createDataFrame(rows, schema).drop("group_id")
    for limit in (10**6, 0):
        out = grouped_split(df, "poly", ["tile", "r"], ["tile", "r"], {"train": 0.6, "test": 0.4}, broadcast_rows=limit).collect()
        assert len(out) == len(rows)
        together = defaultdict(set)
        for r in out:
            together[("g", r.group_id) if r.group_id is not None else ("r", r.tile, r.r)].add(r.split)
        assert all(len(s) == 1 for s in together.values())
        edges = defaultdict(set)
        for r in out:
            if r.poly:
                edges[r.tile, r.r].add(r.poly)
        want = _components([(min(s), p) for s in edges.values() for p in s])
        assert all(r.group_id == want[r.poly] for r in out if r.poly)
    assert grouped_split(df.limit(0), "poly", ["tile", "r"], ["tile"], {"train": 1.0}).count() == 0


def test_unlabelled_rows_link_the_split_groups(spark, tmp_path):
    # Polygons 2i and 2i + 1 meet only through a row without label on another date.
    rows, n = [], 40
    for i in range(1, n + 1):
        rows += [(4 * i, 1, i, 0, 2 * i, "Crop"), (4 * i + 1, 1, i, 1, 2 * i + 1, "crop"), (4 * i + 2, 2, i, 0, 2 * i + 1, None)]
    rows += [(1000, 1, 900, 900, 0, "Water"), (1001, 2, 900, 900, None, "water"), (1002, 9, 1, 0, 500, "Crop")]
    spark.createDataFrame(rows, "sample_id long, scene_id long, pix_row int, pix_col int, poly_id long, label string").write.parquet(f"{tmp_path}/pixels.parquet")
    spark.createDataFrame([(1, "a"), (2, "a")], "scene_id long, tile string").write.parquet(f"{tmp_path}/scenes.parquet")
    groups = {r.poly_id: r.group_id for r in p6_found(spark, str(tmp_path)).collect()}
    assert groups == {2 * i + 1: 2 * i for i in range(1, n + 1)}
    got = {r.sample_id: r for r in p6_splits(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows if r[5]}
    splits = defaultdict(set)
    for sample, _, _, _, poly, label in rows:
        if label and poly:
            assert got[sample].group_id == groups.get(poly, poly)
            splits[groups.get(poly, poly)].add(got[sample].split)
    assert all(len(s) == 1 for s in splits.values())
    assert got[1000].group_id is None and got[1000].split == got[1001].split
    shares = p6_shares(spark, str(tmp_path)).collect()
    assert sum(r.n for r in shares if r.label is None) == len(got)


def test_rows_without_a_node_go_with_the_node_on_their_place(spark):
    rows = [(1, 7, "a", 1), (2, None, "a", 1), (3, 0, "a", 2), (4, 9, "a", 3), (5, None, None, 3), (6, None, "a", 3)]
    df = spark.createDataFrame(rows, "sample_id long, poly long, tile string, r int")
    got = {r.sample_id: r.group_id for r in grouped_split(df, "poly", ["tile", "r"], ["sample_id"], {"train": 0.5, "test": 0.5}).collect()}
    assert got == {1: 7, 2: 7, 3: None, 4: 9, 5: None, 6: 9}


def test_hot_clusters_are_cut(spark, monkeypatch):
    monkeypatch.setattr(splits, "CLUSTER_ROWS", 7)
    edges = [(1, i) for i in range(2, 200)] + [(i, i + 1) for i in range(500, 560)]
    got = {r.node: r.component for r in hash_to_min(spark.createDataFrame(edges, "src long, dst long")).df.collect()}
    assert got == _components(edges)


def test_best_seed_balances_classes(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for poly in range(1, 120):
        for _ in range(rng.choice([5, 20, 300])):
            rows.append((i, poly, "a", i, "xyz"[poly % 3]))
            i += 1
    df = spark.createDataFrame(rows, "sample_id long, poly long, tile string, r int, label string")

    def worst(out):
        n = Counter((r.label, r.split) for r in out.collect())
        total = Counter()
        for (c, _), k in n.items():
            total[c] += k
        return max(abs(n[c, s] / total[c] - p) / p for c in total for s, p in (("train", 0.8), ("test", 0.2)))

    shares = {"train": 0.8, "test": 0.2}
    one = worst(grouped_split(df, "poly", ["tile", "r"], ["r"], shares, label=F.col("label")))
    best = worst(grouped_split(df, "poly", ["tile", "r"], ["r"], shares, label=F.col("label"), tries=16))
    assert best <= one and best < 0.35


def test_splits_agree_with_found_on_every_group(spark):
    groups = {r.poly_id: r.group_id for r in p6_found(spark, "/root/testdata/sf0.001").collect()}
    pixels = spark.read.parquet("/root/testdata/sf0.001/pixels.parquet").select("sample_id", "poly_id")
    for r in p6_splits(spark, "/root/testdata/sf0.001").join(pixels, "sample_id").where("poly_id > 0").collect():
        assert r.group_id == groups.get(r.poly_id, r.poly_id)
