"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.storage import Staged, broadcast_upto


def star_edges(df: DataFrame, node: str, *places: str) -> DataFrame:
    """Distinct links ``src < dst`` between nodes that share a place: each place's least node to its others.

    A star a place connects what all pairs would. Repeated (place, node) rows collapse map-side before anything is
    gathered. Null nodes or places link nothing.
    """
    at = df.select(F.col(node).cast("long").alias("node"), *places).dropna()
    at = at.groupBy(*places, "node").agg(F.lit(1).alias("one"))
    least = at.groupBy(*places).agg(F.min("node").alias("src"))
    return at.join(least, list(places)).select("src", F.col("node").alias("dst")).where("src < dst").distinct()


#: Members of one cluster that one task joins; a larger cluster is cut into parts of about this many.
CLUSTER_ROWS = 200_000


def hash_to_min(edges: DataFrame) -> Staged:
    """``node, component`` of every node with a link; component is the least node id.

    Hash-to-min: each node v knows a cluster C(v), at first itself and its neighbours. In each round v sends C(v) to
    its minimum m and m to each member of C(v), until nothing changes, however many rounds that takes; the minimum then holds the
    component. The clusters are rows (v, member) and are never gathered: a giant component is only many rows, and its rows are
    cut into counted parts before they meet their minimum. Rounds are written to the shared folder; that the rows of a round are the
    same as before shows in their count, sum and xor of hashes, without a shuffle.
    """
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    v = lambda a, b: F.struct(F.col(a).alias("v"), F.col(b).alias("u"))
    pairs = e.select(F.explode(F.array(v("src", "src"), v("src", "dst"), v("dst", "dst"), v("dst", "src"))).alias("p"))
    h = F.xxhash64("v", "u")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())
    now = Staged(pairs.select("p.v", "p.u").distinct())
    seen = mark(now.df)
    while True:
        least = Staged(now.df.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")))
        # At most pairs / CLUSTER_ROWS rows.
        big = F.broadcast(least.df.where(F.col("n") > CLUSTER_ROWS).select("v", F.ceil(F.col("n") / CLUSTER_ROWS).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        members = now.df.join(big, "v", "left").select("v", "u", F.pmod(F.xxhash64("u"), parts).cast("int").alias("part"))
        minima = least.df.select("v", "m", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / CLUSTER_ROWS).cast("int") - 1)).alias("part"))
        sent = members.join(minima, ["v", "part"])
        new = Staged(sent.select(F.explode(F.array(v("m", "u"), v("u", "m"))).alias("p")).select("p.v", "p.u").distinct())
        now.drop()
        least.drop()
        now, before = new, seen
        seen = mark(now.df)
        if seen == before:
            break
    out = Staged(now.df.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node"))
    now.drop()
    return out


def rendezvous(key: Column, shares: Mapping[str, float], seed: int = 17) -> Column:
    """The split of a key by weighted rendezvous hashing: the largest -share / ln(u), u a hash of key and split.

    Depends on nothing but key, shares and seed: adding rows or executors moves no key, and changing one share moves only
    keys into or out of that split.
    """
    draws = []
    for name, share in shares.items():
        if share > 0:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{seed}:{name}")), 11)
            u = (bits.cast("double") + 0.5) / float(1 << 53)
            draws.append(F.struct((-F.lit(float(share)) / F.log(u)).alias("score"), F.lit(name).alias("split")))
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["split"]


def balanced_seed(rows: DataFrame, key: Column, weigh: Sequence[str], shares: Mapping[str, float], seeds: Sequence[int]) -> int:
    """Of ``seeds``, the one under which the splits' rows deviate least from ``shares`` in the worst class.

    A class is a combination of the ``weigh`` columns; its deviation is the gap over the wanted rows of the split. Rows are counted by key
    and class first, so a seed costs a hash a key; the driver gets seeds x classes x splits sums.
    """
    counts = rows.groupBy(key.alias("__k"), *weigh).agg(F.count("*").alias("__n"))
    put = counts.select("*", F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), rendezvous(F.col("__k"), shares, s).alias("split")) for s in seeds))).alias("__p"))
    by = put.groupBy("__p.seed", "__p.split", *weigh).agg(F.sum("__n").alias("n"))
    wanted = {k: v / sum(shares.values()) for k, v in shares.items() if v > 0}
    total: dict = {}
    got: dict = {}
    for r in by.collect():
        c = tuple(r[w] for w in weigh)
        got[r["seed"], c, r["split"]] = r["n"]
        if r["seed"] == seeds[0]:
            total[c] = total.get(c, 0) + r["n"]
    worst = {s: max((abs(got.get((s, c, k), 0) - n * p) / (n * p) for c, n in total.items() for k, p in wanted.items()), default=0.0) for s in seeds}
    return min(seeds, key=lambda s: (worst[s], s))


def grouped_split(
    df: DataFrame, node: str, places: Sequence[str], alone: Sequence[str], shares: Mapping[str, float], seed: int = 17, broadcast_rows: int = 400_000, label: Column | None = None, tries: int = 1
) -> DataFrame:
    """Adds ``group_id`` (the component's least node; null without one) and ``split``.

    Rows whose ``node`` is above 0 go by their component, and so do rows without a node on a place where some row has one; other
    rows go by their own ``alone`` columns, so that repeated deliveries stay together as well. The shares hold in expectation
    over groups, overall and in each class. With ``label`` and ``tries`` above 1, the best of that many seeds is taken, the one whose
    splits deviate least in the worst class (``balanced_seed``); rows of no group need no balance, since each is drawn for itself. Rows with a null label
    are split but don't count there. With one try nothing but key, shares and seed decides.
    """
    with_node = df.where(F.col(node) > 0)
    found = hash_to_min(star_edges(with_node, node, *places))
    # As columns of their own: clashing names in df do no harm.
    anchors = with_node.dropna(subset=list(places)).groupBy(*(F.col(p).alias(f"__p{i}") for i, p in enumerate(places))).agg(F.min(node).alias("__anchor"))
    same = F.lit(True)
    for i, p in enumerate(places):
        same = same & (F.col(p) == F.col(f"__p{i}"))
    free = df.where(F.coalesce(F.col(node) <= 0, F.lit(True))).join(anchors, same, "left").drop(*(f"__p{i}" for i in range(len(places))))
    linked = with_node.withColumn("__anchor", F.col(node)).unionByName(free)
    named = broadcast_upto(found, broadcast_rows).select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    out = linked.join(named, F.col("__anchor") == F.col("__node"), "left").withColumn("__group", F.coalesce("__component", "__anchor"))
    key = F.when(F.col("__group").isNotNull(), F.concat(F.lit("g"), F.col("__group").cast("string"))).otherwise(F.concat_ws("|", F.lit("r"), *(F.col(c).cast("string") for c in alone)))
    if label is not None and tries > 1:
        grouped = out.where(F.col("__group").isNotNull()).select("__group", label.alias("__label")).where(F.col("__label").isNotNull())
        seed = balanced_seed(grouped, F.concat(F.lit("g"), F.col("__group").cast("string")), ["__label"], shares, range(seed, seed + tries))
    return out.withColumn("split", rendezvous(key, shares, seed)).withColumn("group_id", F.col("__group")).drop("__node", "__component", "__anchor", "__group")
