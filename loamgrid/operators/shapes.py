"""Spatial joins, clips and pixel covers that are exact on shapes (points, lines and polygons)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import geometry as G
from loamgrid.operators import cells
from loamgrid.operators.nearby import even_odd
from loamgrid.operators.vectors import _boxed, _shape, _text, box_pairs, overlay_pairs, spread
from loamgrid.storage import Staged

KINDS = ("point", "line", "polygon")
#: Points of a ring up to which it is tested as plain numbers.
SHORT_RING = 9


def _lines(parts: list) -> np.ndarray:
    """Rows x1, y1, x2, y2 of all segments; a lone point is a segment without length."""
    out = []
    for part in parts:
        for ring in part:
            out += [(*a[:2], *b[:2]) for a, b in zip(ring, ring[1:], strict=False)] if len(ring) > 1 else [(*ring[0][:2], *ring[0][:2])] if ring else []
    return np.array(out, float).reshape(-1, 4)


def _to_segments(p: np.ndarray, s: np.ndarray) -> float:
    """The least distance of points to segments."""
    a, d = s[None, :, :2], (s[:, 2:] - s[:, :2])[None]
    length = (d**2).sum(2)
    t = np.clip(((p[:, None] - a) * d).sum(2) / np.where(length > 0, length, 1), 0, 1)
    return float(np.sqrt(((p[:, None] - a - t[..., None] * d) ** 2).sum(2)).min())


def _cross(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether any two segments cross properly."""
    turn = lambda o, a, b: (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])
    a, b, c, d = s[:, None, :2], s[:, None, 2:], t[None, :, :2], t[None, :, 2:]
    return bool(((turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)).any())


def distance(a: list, b: list, kind_a: str, kind_b: str) -> float:
    """Distance of two shapes in the plane, 0 where they touch, cross or contain one another. In blocks, so that long outlines fit."""
    s, t = _lines(a), _lines(b)
    if not len(s) or not len(t):
        return float("inf")
    if kind_b == "polygon" and any(even_odd(t, *p) for p in s[:1, :2]) or kind_a == "polygon" and any(even_odd(s, *p) for p in t[:1, :2]):
        return 0.0
    best = float("inf")
    for i in range(0, len(s), 512):
        for j in range(0, len(t), 512):
            p, q = s[i : i + 512], t[j : j + 512]
            if _cross(p, q):
                return 0.0
            best = min(best, _to_segments(np.concatenate([p[:, :2], p[:, 2:]]), q), _to_segments(np.concatenate([q[:, :2], q[:, 2:]]), p))
    return best


def is_within(a: list, b: list, kind_a: str) -> bool:
    """Whether no part of ``a`` lies outside the polygon ``b`` (borders belong to it)."""
    if kind_a == "polygon":
        return G.area_of(G.set_operation(a, b, G.OPERATIONS["difference"])) <= 1e-9 * max(1.0, G.area_of(a))
    s, t = _lines(a), _lines(b)
    middle = (s[:, :2] + s[:, 2:]) / 2
    inside = lambda p: even_odd(t, *p) or _to_segments(p[None], t) <= 1e-9
    return not _cross(s, t) and all(inside(p) for p in np.concatenate([s[:, :2], s[:, 2:], middle]))


def _parted(df: DataFrame, side: str, shape: str) -> tuple[DataFrame, DataFrame | None]:
    """The upright rectangles of a layer as columns and corners <side>_*, and the other shapes with theirs (None without any), staged."""
    named = spread(df.dropna()).withColumn("__b", G.plain_box(F.col(shape)))
    rest = [c for c in df.columns if c != shape]
    kept = Staged(named.select(*(F.col(c).alias(f"{side}_{c}") for c in rest), *(F.col(f"__b.{k}").alias(f"{side}_{k}") for k in cells.CORNERS), F.when(F.col("__b").isNull(), F.col(shape)).alias(f"{side}_{shape}"))).df
    plain = kept.where(F.col(f"{side}_x0").isNotNull()).drop(f"{side}_{shape}")
    other = kept.where(f"{side}_{shape} is not null").select(*(F.col(f"{side}_{c}").alias(c) for c in [*rest, shape]))
    return plain, None if other.isEmpty() else _boxed(other, side, shape)


def shape_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, relation: str = "intersects", reach: float = 0.0, size: float = 64.0, kinds: tuple[str, str] = ("polygon", "polygon"), shape: str = "shape", semi: bool = False) -> DataFrame:
    """``a_<key>, b_<key>`` of pairs that intersect, where a lies ``within`` b, or that are at most ``reach`` apart (``distance``); with ``semi`` the ``a_<key>`` alone, once or more.

    Upright rectangles are compared in grid cells (``cells``), other pairs, whose candidates come from grids of boxes (``box_pairs``), one at a time in Arrow batches. Null and empty shapes meet nothing.
    """
    a, b = a.select(a_key, shape), b.select(b_key, shape)
    ka, kb = f"a_{a_key}", f"b_{b_key}"
    wider = lambda df: df.withColumns({f"__{c}": F.col(f"a_{c}") for c in cells.CORNERS} | {"a_x0": F.col("a_x0") - reach, "a_y0": F.col("a_y0") - reach, "a_x1": F.col("a_x1") + reach, "a_y1": F.col("a_y1") + reach}) if reach else df
    if kinds != ("polygon", "polygon"):
        return _tested(box_pairs(wider(_boxed(a.dropna(), "a", shape)), _boxed(b.dropna(), "b", shape), size), ka, kb, relation, reach, kinds, shape)
    (p, p2), (q, q2) = _parted(a, "a", shape), _parted(b, "b", shape)
    test = _boxes_related(relation, reach)
    out = cells.having(wider(p), q, ka, size, test) if semi else cells.related(wider(p), q, ka, kb, size, test)
    shaped = lambda df, s: df.withColumn(f"{s}_{shape}", G.box_shape(*(F.col(f"{s}_{k}") for k in cells.CORNERS)))
    for x, y in ((p2, shaped(q, "b")), (shaped(p, "a"), q2), (p2, q2)):
        if x is not None and y is not None:
            tested = _tested(box_pairs(wider(x), y, size), ka, kb, relation, reach, kinds, shape)
            out = out.unionByName(tested.select(out.columns))
    return out


def _tested(pairs: DataFrame, ka: str, kb: str, relation: str, reach: float, kinds: tuple[str, str], shape: str) -> DataFrame:
    """The candidates that are related, one at a time."""
    types = dict(pairs.dtypes)
    pairs = pairs.select(ka, kb, _text(f"a_{shape}").alias("__a"), _text(f"b_{shape}").alias("__b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for p, q in zip(pdf["__a"], pdf["__b"], strict=True):
                x, y = _shape(p), _shape(q)
                ok.append(is_within(x, y, kinds[0]) if relation == "within" else distance(x, y, *kinds) <= (reach if relation == "distance" else 1e-9))
            yield pdf.loc[np.array(ok, bool), [ka, kb]]

    return pairs.mapInPandas(run, f"{ka} {types[ka]}, {kb} {types[kb]}")


def _boxes_related(relation: str, reach: float):
    """``distance`` and ``is_within`` of upright rectangles in numpy."""

    def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if relation == "within":
            area = (x[2] - x[0]) * (x[3] - x[1])
            return area - cells.common(x, y) <= 1e-9 * np.maximum(1.0, area)
        if relation != "distance" or not reach:
            return cells.meets(x, y)
        dx = np.maximum(np.maximum(y[0] - x[2], x[0] - y[2]), 0.0)
        dy = np.maximum(np.maximum(y[1] - x[3], x[1] - y[3]), 0.0)
        return np.sqrt(dx * dx + dy * dy) <= reach

    return test


def select_by_location(a: DataFrame, b: DataFrame, a_key: str, b_key: str, relation: str = "intersects", reach: float = 0.0, disjoint: bool = False, **options) -> DataFrame:
    """Rows of ``a`` with (or without) a partner among the shapes of ``b``: a semi or anti join."""
    hit = shape_pairs(a, b, a_key, b_key, relation, reach, semi=True, **options).select(F.col(f"a_{a_key}").alias("__k")).distinct()
    return a.join(hit, F.col(a_key) == F.col("__k"), "left_anti" if disjoint else "left_semi")


def points_in_shapes(points: DataFrame, shapes: DataFrame, key: str, shape_key: str, x: str, y: str, size: float = 64.0, shape: str = "shape", keep: tuple[str, ...] = ()) -> DataFrame:
    """``a_<key>, b_<key>`` of points inside polygons (even-odd over all rings), tested in the JVM; ``keep`` names columns of the points to come along as a_*."""
    p = points.select(F.col(key).alias(f"a_{key}"), *(F.col(c).alias(f"a_{c}") for c in keep), *(F.col(c).cast("double").alias(f"a_{n}") for c, n in ((x, "x0"), (y, "y0"), (x, "x1"), (y, "y1"))))
    boxed = _boxed(shapes.select(shape_key, shape).dropna(), "b", shape)
    # Short rings as plain numbers, whose test is compiled; a ring's last edge is repeated where it has fewer.
    ring, n = F.col(f"b_{shape}")[0][0], F.size(F.col(f"b_{shape}")[0][0])
    few = (F.size(f"b_{shape}") == 1) & (F.size(F.col(f"b_{shape}")[0]) == 1) & n.between(2, SHORT_RING)
    at = lambda i, k: F.when(few, ring[F.least(F.lit(i), n - 1)][k])
    numbers = {f"__{c}{i}": at(i, k) for i in range(SHORT_RING) for k, c in enumerate("xy")}
    b = Staged(boxed.where(F.col("b_x0").isNotNull()).withColumns(numbers).withColumn(f"b_{shape}", F.when(~few, F.col(f"b_{shape}")))).df
    met = box_pairs(p, b, size)
    px, py, odd = F.col("a_x0"), F.col("a_y0"), F.lit(False)
    for i in range(1, SHORT_RING):
        ax, ay, bx, by = (F.col(f"__{c}{j}") for j in (i - 1, i) for c in "xy")
        odd = odd != (((ay > py) != (by > py)) & F.coalesce(px < (bx - ax) * (py - ay) / F.when(ay != by, by - ay) + ax, F.lit(False)))
    inside = F.when(F.col(f"b_{shape}").isNull(), odd).otherwise(G.contains_point(F.col(f"b_{shape}"), px, py))
    return met.where(inside).select(f"a_{key}", *(f"a_{c}" for c in keep), f"b_{shape_key}")


def largest_overlap(a: DataFrame, b: DataFrame, a_key: str, b_key: str, size: float = 64.0, shape: str = "shape") -> DataFrame:
    """``a_<key>, b_<key>, overlap``: of each a the b with the largest common area, ties to the smaller b."""
    a, b = a.select(a_key, shape), b.select(b_key, shape)
    (left, others_a), (right, others_b) = _parted(a, "a", shape), _parted(b, "b", shape)
    if others_a is None and others_b is None:
        return cells.best(left, right, f"a_{a_key}", f"b_{b_key}", size, touching=False)
    pieces = overlay_pairs(a, b, size, shape)
    best = pieces.groupBy(f"a_{a_key}").agg(F.max_by(F.struct(F.col(f"b_{b_key}").alias("k"), F.col("area").alias("o")), F.struct("area", -F.col(f"b_{b_key}"))).alias("m"))
    return best.select(f"a_{a_key}", F.col("m.k").alias(f"b_{b_key}"), F.col("m.o").alias("overlap"))


def shared_area(a: DataFrame, b: DataFrame, key: str, size: float = 64.0, shape: str = "shape") -> DataFrame:
    """``area``: the sum of the common areas of all pairs, without a row for each; null without any."""
    a, b = a.select(key, shape), b.select(key, shape)
    (left, others_a), (right, others_b) = _parted(a, "a", shape), _parted(b, "b", shape)
    every = cells.shared_area(left, right, size) if others_a is None and others_b is None else overlay_pairs(a, b, size, shape)
    return every.where("area > 0").agg(F.sum("area").alias("area"))


def count_points(points: DataFrame, shapes: DataFrame, shape_key: str, x: str, y: str, value: str | None = None, size: float = 64.0, shape: str = "shape") -> DataFrame:
    """``<shape_key>, points`` and ``sum_<value>`` (numbers only, 6 places) of all shapes, by the even-odd rule; counted in grid cells, without a row for each pair of point and shape."""
    named = spread(shapes.select(shape_key, shape)).withColumn("b_few", _few(F.col(shape)))
    ring = lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SHORT_RING - 1)), lambda i: F.slice(s[0][0][F.least(i, F.size(s[0][0]) - 1)], 1, 2)))
    kept = Staged(named.select(F.col(shape_key).alias(f"b_{shape_key}"), F.when(F.col("b_few"), F.transform(F.array(shape), ring)[0]).alias("b_ring"), F.when(~F.col("b_few"), F.col(shape)).alias(shape))).df
    ends = lambda k: F.filter("b_ring", lambda v, i: i % 2 == k)
    rings = kept.where("b_ring is not null").select(f"b_{shape_key}", "b_ring", *(f(ends(k)).alias(f"b_{c}") for c, k, f in (("x0", 0, F.array_min), ("y0", 1, F.array_min), ("x1", 0, F.array_max), ("y1", 1, F.array_max))))
    at = [F.col(c).cast("double").alias(f"a_{n}") for c, n in ((x, "x0"), (y, "y0"), (x, "x1"), (y, "y1"))]
    number = [F.col(value).try_cast("double").alias(f"a_{value}")] if value else []
    found = cells.ring_counts(Staged(spread(points.select(*at, *number))).df, rings, f"b_{shape_key}", size, SHORT_RING, value)
    long = kept.where(F.col(shape).isNotNull()).select(F.col(f"b_{shape_key}").alias(shape_key), shape)
    if not long.isEmpty():
        p = points.select(F.monotonically_increasing_id().alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(value).try_cast("double").alias("v")] if value else []))
        pairs = points_in_shapes(p, long, "id", shape_key, "x", "y", size, shape, keep=("v",) if value else ())
        found = found.unionByName(pairs.groupBy(f"b_{shape_key}").agg(F.count("*").alias("n"), (F.coalesce(F.sum("a_v"), F.lit(0.0)) if value else F.lit(0.0)).alias("s")))
    sums = found.groupBy(F.col(f"b_{shape_key}").alias("__k")).agg(F.sum("n").alias("__n"), F.sum("s").alias("__s"))
    out = kept.select(F.col(f"b_{shape_key}").alias(shape_key)).join(sums, F.col(shape_key) == F.col("__k"), "left").withColumn("points", F.coalesce("__n", F.lit(0)))
    if value:
        out = out.withColumn(f"sum_{value}", F.round(F.coalesce("__s", F.lit(0.0)), 6))
    return out.drop("__k", "__n", "__s")


def _few(shape: Column) -> Column:
    """Whether the shape is one ring of at most SHORT_RING points."""
    return F.coalesce(F.transform(F.array(shape), lambda s: (F.size(s) == 1) & (F.size(s[0]) == 1) & F.size(s[0][0]).between(2, SHORT_RING))[0], F.lit(False))


def pixel_runs(shapes: DataFrame, key: str, x0: float, y0: float, res: float, shape: str = "shape") -> DataFrame:
    """``key, row, col0, col1``: the runs of pixels whose centres a polygon holds, on the grid with upper left corner x0, y0. A run a row, not a row a pixel."""
    kind = dict(shapes.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, s in zip(pdf["key"], pdf["shape"], strict=True):
                e = _lines(_shape(s))
                if not len(e):
                    continue
                top, low = max(e[:, 1].max(), e[:, 3].max()), min(e[:, 1].min(), e[:, 3].min())
                for row in range(int(np.floor((y0 - top) / res)), int(np.floor((y0 - low) / res)) + 1):
                    y = y0 - (row + 0.5) * res
                    hit = e[(e[:, 1] > y) != (e[:, 3] > y)]
                    xs = np.sort(hit[:, 0] + (y - hit[:, 1]) / (hit[:, 3] - hit[:, 1]) * (hit[:, 2] - hit[:, 0]))
                    for a, b in zip(xs[::2], xs[1::2], strict=True):
                        c0, c1 = int(np.ceil((a - x0) / res - 0.5)), int(np.ceil((b - x0) / res - 0.5)) - 1
                        if c0 <= c1:
                            out.append((k, row, c0, c1))
            yield pd.DataFrame(out, columns=["key", "row", "col0", "col1"])

    rows = shapes.select(F.col(key).alias("key"), _text(shape).alias("shape")).where("shape is not null")
    return rows.mapInPandas(run, f"key {kind}, row long, col0 long, col1 long").withColumnRenamed("key", key)


def rasterise(shapes: DataFrame, key: str, x0: float, y0: float, res: float, value: str | None = None, shape: str = "shape") -> DataFrame:
    """``row, col, value, n``: the value of the shape with the greatest key that holds the pixel's centre (later shapes cover earlier ones), and how many hold it."""
    runs = pixel_runs(shapes, key, x0, y0, res, shape)
    if value and value != key:
        runs = runs.join(shapes.select(F.col(key).alias("__k"), F.col(value).alias("__v")), F.col(key) == F.col("__k")).drop("__k")
    cells = runs.select("row", F.explode(F.sequence("col0", "col1")).alias("col"), key, F.col("__v" if value and value != key else key).alias("v"))
    return cells.groupBy("row", "col").agg(F.max_by("v", key).alias("value"), F.count("*").alias("n"))


def clip_pixels(pixels: DataFrame, shapes: DataFrame, key: str, x0: float, y0: float, res: float, invert: bool = False, shape: str = "shape") -> DataFrame:
    """Pixels (row, col) whose centres lie in some shape, or with ``invert`` in none: a semi or anti join with the shapes' cover."""
    runs = pixel_runs(shapes, key, x0, y0, res, shape)
    cover = runs.select(F.col("row").alias("__r"), F.explode(F.sequence("col0", "col1")).alias("__c"))
    return pixels.join(cover, (F.col("row") == F.col("__r")) & (F.col("col") == F.col("__c")), "left_anti" if invert else "left_semi")


def region_outlines(regions: DataFrame, cls: str, x0: float = 0.0, y0: float = 0.0, res: float = 1.0) -> DataFrame:
    """``region, <cls>, pixels, area, shape``: the outline of each region of ``connected_regions`` as a polygon, rows running south from y0.

    Unit edges between a region and its surroundings are found by joins and merged into straight runs by windows; only a region's runs, the corners of the
    one polygon it becomes, are chained in one task.
    """
    r = regions.select("region", cls, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    sides = []
    # A directed edge keeps the region on its right: (line, from, to, along).
    for dr, dc, name in ((-1, 0, "top"), (1, 0, "bottom"), (0, -1, "left"), (0, 1, "right")):
        other = r.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), "region")
        edge = r.join(other, ["row", "col", "region"], "left_anti")
        line = F.col("row") + (1 if name == "bottom" else 0) if dc == 0 else F.col("col") + (1 if name == "right" else 0)
        sides.append(edge.select("region", F.lit(name).alias("side"), line.alias("line"), (F.col("col") if dc == 0 else F.col("row")).alias("at")))
    every = sides[0]
    for s in sides[1:]:
        every = every.unionByName(s)
    w = Window.partitionBy("region", "side", "line").orderBy("at")
    runs = every.withColumn("g", F.col("at") - F.row_number().over(w)).groupBy("region", "side", "line", "g").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        # Around the region clockwise on a map whose rows run down.
        steps: dict = {}
        for side, line, a, b in pdf[["side", "line", "a", "b"]].itertuples(index=False):
            p, q = {"top": ((a, line), (b, line)), "right": ((line, a), (line, b)), "bottom": ((b, line), (a, line)), "left": ((line, b), (line, a))}[side]
            steps.setdefault(p, []).append(q)
        rings = []
        while steps:
            start = min(steps)
            ring, at, came = [start], start, None
            while True:
                ways = steps[at]
                # Where two corners meet, the sharper right turn keeps regions of four neighbours apart.
                if len(ways) > 1 and came is not None:
                    ways.sort(key=lambda q: (came[0] * np.sign(q[1] - at[1]) - came[1] * np.sign(q[0] - at[0])), reverse=True)
                nxt = ways.pop(0)
                if not ways:
                    del steps[at]
                came, at = (np.sign(nxt[0] - at[0]), np.sign(nxt[1] - at[1])), nxt
                ring.append(at)
                if at == start:
                    break
            rings.append([[float(x0 + c * res), float(y0 - r_ * res)] for c, r_ in ring])
        rings.sort(key=lambda g: -abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(g, g[1:], strict=False))))
        return pd.DataFrame({"region": [pdf["region"].iloc[0]], "shape": [[rings]]})

    kind = dict(regions.dtypes)["region"]
    outlines = runs.groupBy("region").applyInPandas(chain, f"region {kind}, shape {G.SHAPE}")
    sizes = r.groupBy("region", cls).agg(F.count("*").alias("pixels"))
    return sizes.join(outlines, "region").select("region", cls, "pixels", (F.col("pixels") * res * res).alias("area"), "shape")


def contour_lines(segments: DataFrame) -> DataFrame:
    """``level, line, points, closed, length, shape`` of the segments of ``raster.contour_segments``: segments that share an end form a line.

    Lines are components of segments (minimum labels over shared ends); a line's segments, the points of the one feature it becomes, are chained in one task.
    """
    from loamgrid.operators.raster import spread_labels

    end = lambda x, y: F.xxhash64(F.round("level", 9), F.round(F.col(x), 9), F.round(F.col(y), 9))
    real = segments.where("x1 <> x2 or y1 <> y2")
    s = Staged(real.withColumns({"a": end("x1", "y1"), "b": end("x2", "y2")}))
    nodes = s.df.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = spread_labels(nodes, s.df.select("a", "b").distinct())

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        place, ways = {}, {}
        for a, b, x1, y1, x2, y2 in pdf[["a", "b", "x1", "y1", "x2", "y2"]].itertuples(index=False):
            place[a], place[b] = [x1, y1], [x2, y2]
            ways.setdefault(a, []).append(b)
            ways.setdefault(b, []).append(a)
        lines = []
        while ways:
            ends = [n for n in ways if len(ways[n]) % 2]
            at = min(ends or ways)
            line = [at]
            while ways.get(at):
                nxt = ways[at].pop()
                ways[nxt].remove(at)
                for n in (at, nxt):
                    if n in ways and not ways[n]:
                        del ways[n]
                line.append(nxt)
                at = nxt
            lines.append(line)
        shape = [[[place[n] for n in line]] for line in lines]
        length = float(np.hypot(pdf["x2"] - pdf["x1"], pdf["y2"] - pdf["y1"]).sum())
        return pd.DataFrame({"level": [pdf["level"].iloc[0]], "line": [pdf["label"].iloc[0]], "points": [sum(map(len, lines))], "closed": [all(g[0] == g[-1] for g in lines)], "length": [length], "shape": [shape]})

    rows = s.df.join(labels.select(F.col("node").alias("a"), "label"), "a")
    return rows.groupBy("label").applyInPandas(chain, f"level double, line long, points int, closed boolean, length double, shape {G.SHAPE}")
