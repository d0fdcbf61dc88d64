"""Similarity clusters by grid density, in SQL operators only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.storage import Staged, broadcast_upto


def present(col: Column, *missing: float) -> Column:
    """Whether a value is a finite number and none of the ``missing`` codes."""
    v = col.cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return ok & ~v.isin(*missing) if missing else ok


def min_labels(nodes: DataFrame, edges: DataFrame) -> Staged:
    """``node, label`` for each node: the least ``start`` label of its component.

    ``nodes``: node, start. ``edges``: src, dst, each once in one direction. Every round takes the minimum over neighbours and then
    jumps to the label of the node that label stands for, so long chains halve; it ends when no label changes, however many rounds
    that takes. Each round is written to the shared folder and the one before it deleted.
    """
    both = Staged(edges.select("src", "dst").union(edges.select("dst", "src")))
    now = Staged(nodes.select("node", F.col("start").alias("label"), "start"))
    while True:
        near = both.df.join(now.df, both.df.dst == now.df.node).groupBy("src").agg(F.min("label").alias("near"))
        # The node that carries a label as its own start tells how far that label has come meanwhile.
        heads = now.df.select(F.col("start").alias("head"), F.col("label").alias("jump"))
        met = now.df.join(near, now.df.node == near.src, "left").select("node", "start", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("best"))
        new = Staged(met.join(heads, met.best == heads["head"], "left").select("node", F.least("best", F.coalesce("jump", "best")).alias("label"), "start", "old"))
        stable = new.df.where("label < old").isEmpty()
        now.drop()
        now = new
        if stable:
            both.drop()
            return now


#: Cells of one block that one task compares with all others of it; a fuller block is cut into parts of about this many.
BLOCK_CELLS = 4096


class GridClusters:
    """Clusters of rows whose ``features`` lie within ``eps`` of one another (Euclidean), directly or in chains of cells.

    1. quantise: cells of edge 0.98 * eps / sqrt(d), so that all rows of a cell are similar; rows become cells with a
       count, the least id and one row's place inside the cell (the representative), in one map-side combined aggregation.
       A group of copies with a third of all rows is one cell.
    2. count: the cells go to the blocks (of edge 2 * eps) that a cube of edge eps around them touches. Cubes
       that all overlap in pairs share a point, so the block of that point holds a whole cluster of mutually similar rows and all
       its pairs: blocks with fewer than ``min_size`` rows are not dense and are left out without loss, wherever the origin lies.
    3. join: adjacent dense cells, those of one dense block whose representatives are at most ``eps`` apart. A pair may meet in
       several dense blocks and is kept once. A block of more than BLOCK_CELLS cells is cut into parts: each part's cells meet all
       cells of the block in a task of their own. A block holds a number of cells that depends on the features' number only.
    4. propagate minimum labels to convergence.

    Rows with a null, NaN, infinite or ``missing`` feature or a null id belong to no cluster. Repeated rows count as often as they
    occur. Clusters with fewer than ``min_size`` rows don't come out. Features are read by position, so other columns may have any name.
    Distances between representatives are exact to about eps / 1000.
    """

    def __init__(self, df: DataFrame, id_col: str, features: Sequence[str], eps: float, min_size: int = 8, missing: Sequence[float] = (-9999.0,)):
        d = len(features)
        self.d, self.eps, self.min_size, self.edge = d, eps, min_size, 0.98 * eps / math.sqrt(d)
        ok = F.col(id_col).isNotNull()
        for f in features:
            ok = ok & present(F.col(f), *missing)
        self.rows = self._keyed(df.where(ok).select(F.col(id_col).cast("long").alias("id"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features))))
        self.cells = self._count()
        self.labels = self._label()

    def _keyed(self, df: DataFrame) -> DataFrame:
        """Adds the cell's numbers q0.., its 96-bit key and the row's place in the cell."""
        bits = 60 // self.d
        for i in range(self.d):
            df = df.withColumn(f"q{i}", F.floor(F.col(f"x{i}") / self.edge))
        place = None
        for i in range(self.d):
            inside = F.floor((F.col(f"x{i}") / self.edge - F.col(f"q{i}")) * (1 << bits)).cast("long")
            inside = F.shiftleft(F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), inside)).cast("long"), bits * i)
            place = inside if place is None else place.bitwiseOR(inside)
        qs = [f"q{i}" for i in range(self.d)]
        return df.select("id", *qs, F.xxhash64(*qs).alias("k1"), F.hash(*qs).alias("k2"), place.alias("place"))

    def _count(self) -> Staged:
        qs = [F.min(f"q{i}").alias(f"q{i}") for i in range(self.d)]
        grouped = self.rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("place").alias("place"), *qs)
        bits = 60 // self.d
        r = [((F.col(f"q{i}") + (F.shiftright("place", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) / (1 << bits)) * self.edge).alias(f"r{i}") for i in range(self.d)]
        return Staged(grouped.select("k1", "k2", "n", "first", *r))

    def _label(self) -> Staged:
        block = 2 * self.eps
        at = lambda x: F.floor(x / block)
        put = self.cells.df
        for i in range(self.d):
            put = put.withColumn(f"b{i}", F.explode(F.array_distinct(F.array(at(F.col(f"r{i}") - self.eps / 2), at(F.col(f"r{i}") + self.eps / 2)))))
        put = put.withColumn("block", F.xxhash64(*(f"b{i}" for i in range(self.d))))
        counts = put.groupBy("block").agg(F.sum("n").alias("rows"), F.count("*").alias("cells"))
        dense = counts.where((F.col("rows") >= self.min_size) & (F.col("cells") > 1)).select("block", F.ceil(F.col("cells") / BLOCK_CELLS).cast("int").alias("parts"))
        side = Staged(put.join(dense, "block").select("block", "parts", F.col("first").alias("src"), *(F.col(f"r{i}").alias(f"s{i}") for i in range(self.d))))
        home = side.df.withColumn("part", F.pmod(F.xxhash64("src"), F.col("parts")).cast("int"))
        other = side.df.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("src").alias("dst"), *(F.col(f"s{i}").alias(f"t{i}") for i in range(self.d)))
        close = F.col("src") < F.col("dst")
        for i in range(min(2, self.d)):
            close = close & (F.abs(F.col(f"s{i}") - F.col(f"t{i}")) <= self.eps)
        gap = sum((F.pow(F.col(f"s{i}") - F.col(f"t{i}"), 2) for i in range(self.d)), F.lit(0.0))
        edges = Staged(home.join(other, ["block", "part"]).where(close & (gap <= self.eps**2)).select("src", "dst").distinct())
        side.drop()
        # A cell is named by its least id. Cells without an edge are clusters of their own and need no round.
        linked = edges.df.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        found = min_labels(linked.select("node", F.col("node").alias("start")), edges.df)
        edges.drop()
        all_cells = self.cells.df.join(found.df.select(F.col("node").alias("first"), "label"), "first", "left").select("k1", "k2", "n", *(f"r{i}" for i in range(self.d)), F.coalesce("label", "first").alias("cluster_id"))
        sizes = all_cells.groupBy("cluster_id").agg(F.sum("n").alias("cluster_rows")).where(F.col("cluster_rows") >= self.min_size)
        out = Staged(all_cells.join(sizes, "cluster_id"))
        found.drop()
        return out

    def members(self, broadcast_rows: int = 400_000) -> DataFrame:
        """``cluster_id, id`` of every row of a cluster. Cell labels are broadcast only while counted at most ``broadcast_rows``."""
        cells = Staged(self.labels.df.select("k1", "k2", "cluster_id"))
        return self.rows.select("id", "k1", "k2").join(broadcast_upto(cells, broadcast_rows), ["k1", "k2"]).select("cluster_id", "id")

    def describe(self, typical: int = 3, broadcast_rows: int = 400_000) -> DataFrame:
        """One row a cluster: ``cluster_id, cluster_rows, cells, core_rows`` and the ids of its ``typical`` rows.

        The typical members are the rows of the densest cell (ties: least key) nearest to its centre row, ties by id. Ranked in a
        map-side combined way: only rows of densest cells are gathered, and the least (place distance, id) are kept.
        """
        first = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "k1", "k2")
        ranked = self.labels.df.withColumn("rank", F.row_number().over(first)).withColumn("cells", F.count("*").over(Window.partitionBy("cluster_id")))
        core = Staged(ranked.where("rank = 1").select("k1", "k2", "cluster_id", "cluster_rows", "cells", F.col("n").alias("core_rows")))
        bits = 60 // self.d
        off = sum((F.pow(F.shiftright("place", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) / (1 << bits) - 0.5, 2) for i in range(self.d)), F.lit(0.0))
        rows = self.rows.select("id", "k1", "k2", F.round(off, 9).alias("off")).join(broadcast_upto(core, broadcast_rows), ["k1", "k2"])
        # Salted top-k: a cell with a third of all rows is ranked in 64 parts, then its parts' best rows.
        part = Window.partitionBy("cluster_id", "salt").orderBy("off", "id")
        best = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= typical)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("off", "id"))).where(F.col("rank") <= typical)
        named = best.groupBy("cluster_id", "cluster_rows", "cells", "core_rows").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("best"))
        return named.select("cluster_id", "cluster_rows", "cells", "core_rows", F.transform("best", lambda b: b["id"]).alias("typical"))
