"""Attribute joins and spatial joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.expressions import number_text
from loamgrid.operators.meeting import meet
from loamgrid.operators.vectors import box_pairs, spread


def join_key(c: Column) -> Column:
    """Numbers and number-like text as one text (7, 7.0 and "7" are equal), other text trimmed and in lower case."""
    s = F.lower(F.trim(c.cast("string")))
    return F.coalesce(number_text(s.try_cast("double")), s)


def attribute_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: Sequence[str], prefix: str = "t_") -> DataFrame:
    """Left join in which the first match (in ``order``) of each key wins; a null key matches a null key.

    Clashing columns get the prefix; ``matched`` tells whether there was a match.
    """
    # The least row of each key, combined map-side: null keys or a key with most rows are never ordered in one task.
    rank = F.struct(*(s for i, c in enumerate(order) for s in (F.col(c).isNotNull().alias(f"n{i}"), F.col(c).alias(f"o{i}"))))
    first = right.groupBy(join_key(F.col(right_key)).alias("__key")).agg(F.min_by(F.struct(*right.columns), rank).alias("__row"))
    named = first.select("__key", F.lit(True).alias("__hit"), *(F.col("__row")[c].alias(prefix + c if c in left.columns else c) for c in right.columns if c != right_key))
    out = left.join(named, join_key(F.col(left_key)).eqNullSafe(F.col("__key")), "left")
    return out.withColumn("matched", F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def boxes_of(df: DataFrame, side: str, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Columns renamed for box_pairs: everything gets the side as prefix."""
    cols = {x0: "x0", y0: "y0", x1: "x1", y1: "y1"}
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in cols), *(F.col(c).cast("double").alias(f"{side}_{n}") for c, n in cols.items()))


def common_area() -> Column:
    """Area that the boxes of a pair share."""
    w = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    h = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_iou() -> Column:
    area = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    c = common_area()
    return F.try_divide(c, area("a") + area("b") - c)


def largest_overlap(a: DataFrame, b: DataFrame, a_key: str, b_key: str, size: float, others: bool = False) -> DataFrame:
    """``a_key, b_key, overlap``: of each a the b with the largest common area (boxes; touching counts when nothing better, ties to the smaller b).

    ``others`` leaves out pairs of equal keys, for a layer against itself.
    """
    from loamgrid.operators import cells
    from loamgrid.storage import Staged

    cols = lambda s, k: [f"{s}_{k}", *(f"{s}_{c}" for c in cells.CORNERS)]
    left, right = (Staged(spread(df)).df for df in (a.select(cols("a", a_key)), b.select(cols("b", b_key))))
    return cells.best(left, right, f"a_{a_key}", f"b_{b_key}", size, others)


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Pairs of points and boxes (a_*, b_*) that contain them, borders included. Points and boxes meet in grid cells."""
    a = points.select(*(F.col(c).alias(f"a_{c}") for c in points.columns)).withColumns({"a_x0": F.col(f"a_{x}"), "a_x1": F.col(f"a_{x}"), "a_y0": F.col(f"a_{y}"), "a_y1": F.col(f"a_{y}")})
    return box_pairs(a, boxes, size)


def select_by_location(a: DataFrame, pairs: DataFrame, key: str, disjoint: bool = False) -> DataFrame:
    """Rows of ``a`` with (or without) a partner among spatial ``pairs`` (a_<key>): a semi or anti join."""
    hit = pairs.select(F.col(f"a_{key}").alias("__k"))
    return a.join(hit, F.col(key) == F.col("__k"), "left_anti" if disjoint else "left_semi")


def count_points(zones: DataFrame, pairs: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Zones with ``points`` and the ``sum_<value>`` (numbers only, 6 places); zones without points have 0. ``pairs``: points a_*, zones b_*."""
    aggs = [F.count("*").alias("__n")] + ([F.sum(F.col(f"a_{value}").try_cast("double")).alias("__s")] if value else [])
    counts = pairs.groupBy(F.col(f"b_{key}").alias("__k")).agg(*aggs)
    out = zones.join(counts, F.col(key) == F.col("__k"), "left").withColumn("points", F.coalesce("__n", F.lit(0)))
    if value:
        out = out.withColumn(f"sum_{value}", F.round(F.coalesce("__s", F.lit(0.0)), 6))
    return out.drop("__k", "__n", "__s")


def within_distance(a: DataFrame, b: DataFrame, x: str, y: str, a_key: str, b_key: str, reach: float) -> DataFrame:
    """``a_key, b_key, dist`` of all pairs at most ``reach`` apart in the plane; each b goes to the 3 x 3 cells around it."""
    cell = lambda c: F.floor(F.col(c) / reach)
    left = a.select(F.col(a_key).alias("a_key"), F.col(x).alias("ax"), F.col(y).alias("ay"), cell(x).alias("i"), cell(y).alias("j"))
    near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    right = b.select(F.col(b_key).alias("b_key"), F.col(x).alias("bx"), F.col(y).alias("by"), near(x).alias("i"), F.col(y)).withColumn("j", near(y)).drop(y)
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return meet(left, right, ["i", "j"]).withColumn("dist", d).where(F.col("dist") <= reach).select("a_key", "b_key", "dist")


def nearest(a: DataFrame, b: DataFrame, x: str, y: str, a_key: str, b_key: str, start: float | None = None, limit: float | None = None, grow: float = 4.0) -> DataFrame:
    """``a_key, b_key, join_dist_m``: of each a the nearest b (ties to the smaller key), null beyond ``limit``.

    Rings that grow: pairs within a reach are joined by cells, rows without a partner go on with a wider reach, until the reach covers the extent of all points. A
    partner found within the reach is the nearest there is. Each round only the rest is joined. Without ``start`` the first reach is
    half the mean spacing of b over the extent, so that dense places are settled before the reach is wide.
    """
    from loamgrid.storage import Staged

    ends = a.select(x, y).union(b.select(x, y)).agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    extent = 0.0 if ends[0] is None else float(((ends[1] - ends[0]) ** 2 + (ends[3] - ends[2]) ** 2) ** 0.5)
    if start is None:
        start = max(extent / 2 / max(1, b.count()) ** 0.5, 1e-9)
    rest, found, reach = a, None, start
    while True:
        reach = min(reach, limit) if limit else reach
        hits = within_distance(rest, b, x, y, a_key, b_key, reach)
        best = Staged(hits.groupBy("a_key").agg(F.min(F.struct("dist", "b_key")).alias("m")).select("a_key", F.col("m.b_key").alias("b_key"), F.col("m.dist").alias("dist")))
        found = best.df if found is None else found.unionByName(best.df)
        if reach > extent or (limit and reach >= limit):
            break
        rest = rest.join(best.df.select(F.col("a_key").alias("__k")), F.col(a_key) == F.col("__k"), "left_anti")
        reach *= grow
    out = a.select(F.col(a_key).alias("a_key")).join(found, "a_key", "left")
    return out.select("a_key", "b_key", F.round("dist", 2).alias("join_dist_m"))


def nearest_k(a: DataFrame, b: DataFrame, x: str, y: str, a_key: str, b_key: str, k: int) -> DataFrame:
    """``a_key, b_key, dist``: of each a the k nearest b in the plane (fewer where there are fewer), ties to the smaller key.

    Reaches that grow by two from a small share of b's mean spacing: an a with k partners within a reach is settled, only the rest goes on, until the reach
    covers the extent. So dense places are settled while the reach is small, and nothing depends on the number of b in one task.
    """
    from loamgrid.storage import Staged

    ends = a.select(x, y).union(b.select(x, y)).agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    extent = 0.0 if ends[0] is None else float(((ends[1] - ends[0]) ** 2 + (ends[3] - ends[2]) ** 2) ** 0.5)
    reach = max(extent * (k / max(1, b.count())) ** 0.5 / 4, 1e-9)
    rest, done = Staged(a.select(F.col(a_key).alias("key"), x, y)), None
    while True:
        hits = within_distance(rest.df, b, x, y, "key", b_key, reach)
        ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("a_key").orderBy("dist", "b_key"))).where(F.col("r") <= k)
        best = Staged(ranked.withColumn("n", F.count("*").over(Window.partitionBy("a_key"))).select("a_key", "b_key", "dist", "n"))
        last = reach > extent
        mine = best.df if last else best.df.where(F.col("n") >= k)
        done = mine if done is None else done.unionByName(mine)
        if not last:
            left = Staged(rest.df.join(mine.select(F.col("a_key").alias("__k")).distinct(), F.col("key") == F.col("__k"), "left_anti"))
            last, rest = not left.rows, left
        if last:
            return done.select("a_key", "b_key", "dist")
        reach *= 2


def overlap_purge(train: DataFrame, held_out: DataFrame, key: str, size: float) -> DataFrame:
    """Training windows whose box overlaps no held-out window's box; both sides as a_* / b_* boxes."""
    pairs = box_pairs(train, held_out, size)
    return train.join(pairs.select(F.col(f"a_{key}").alias("__k")).distinct(), F.col(f"a_{key}") == F.col("__k"), "left_anti")


def rasterise(points: DataFrame, row: str, col: str, value: str, order: str) -> DataFrame:
    """Cell values of features: the later feature wins; ``n`` counts them."""
    g = points.groupBy(F.col(row).alias("row"), F.col(col).alias("col"))
    return g.agg(F.max_by(value, order).alias("value"), F.count("*").alias("n"))
