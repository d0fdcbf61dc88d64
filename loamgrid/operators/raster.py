"""Rasters as pixel tables: one row a pixel with ``row, col`` and a column a band. Map algebra, terrain, focal windows and zones.

Pixels of other rasters join on equal cell numbers; neighbourhoods go by offsets or by tiles with a halo, so no operator
needs a whole raster in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.expressions import RasterDialect, finite
from loamgrid.operators.quantiles import exact_quantiles
from loamgrid.storage import Staged

CELL = ("row", "col")


def stack(layers: Mapping[str, DataFrame], keys: Sequence[str] = CELL, how: str = "inner") -> DataFrame:
    """Layers side by side on the cells they share; a layer's bands get its name as prefix where they'd clash."""
    out = None
    for name, df in layers.items():
        bands = [c for c in df.columns if c not in keys]
        taken = set(out.columns) if out is not None else set()
        named = df.select(*keys, *(F.col(b).alias(f"{name}_{b}" if b in taken else b) for b in bands))
        out = named if out is None else out.join(named, list(keys), how)
    return out


def raster_calc(df: DataFrame, expression: str, name: str = "value") -> DataFrame:
    """Adds a map-algebra result; null where any variable is missing."""
    return df.withColumn(name, RasterDialect(df.schema).compile(expression).col)


def align(df: DataFrame, x: str, y: str, x0: float, y0: float, res: float) -> DataFrame:
    """Adds ``row, col`` of a grid whose upper left corner is x0, y0: the join key of any other raster on it."""
    return df.withColumns({"col": F.floor((F.col(x) - x0) / res).cast("int"), "row": F.floor((y0 - F.col(y)) / res).cast("int")})


def reclassify(value: Column, rules: Sequence[tuple[float, float, int]]) -> Column:
    """The class of the first rule [lo, hi) that holds (the last rule includes its upper end), else 0; null stays null."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("int"))
    for i, (lo, hi, cls) in enumerate(rules):
        top = value <= hi if i == len(rules) - 1 else value < hi
        out = out.when((value >= lo) & top, cls)
    return out.otherwise(0)


def change(before: DataFrame, after: DataFrame, value: str, keys: Sequence[str] = CELL) -> DataFrame:
    """``before, after, difference, percent`` of cells with both."""
    a = before.select(*keys, F.col(value).alias("before"))
    both = a.join(after.select(*keys, F.col(value).alias("after")), list(keys)).where("before is not null and after is not null")
    d = F.col("after") - F.col("before")
    return both.select("*", d.alias("difference"), (100 * F.try_divide(d, F.abs("before"))).alias("percent"))


def change_matrix(before: DataFrame, after: DataFrame, cls: str, pixel_ha: float, keys: Sequence[str] = CELL, top: int = 200) -> DataFrame:
    """``from_class, to_class, pixels, hectares, changed``, the largest first."""
    a = before.select(*keys, F.col(cls).alias("from_class"))
    both = a.join(after.select(*keys, F.col(cls).alias("to_class")), list(keys))
    g = both.where("from_class is not null and to_class is not null").groupBy("from_class", "to_class").agg(F.count("*").alias("pixels"))
    return g.select("*", (F.col("pixels") * pixel_ha).alias("hectares"), (F.col("from_class") != F.col("to_class")).alias("changed")).orderBy(F.desc("pixels"), "from_class", "to_class").limit(top)


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(F.avg("difference").alias("mean_change"), (F.avg((F.col("difference") > 0).cast("double")) * 100).alias("increased_pct"), F.count("*").alias("pixels"))


def composite(df: DataFrame, bands: Sequence[str], clear: Column, keys: Sequence[str] = CELL, stat: str = "median") -> DataFrame:
    """Median or mean of each cell's clear observations, and their number."""
    pick = lambda b: F.when(clear, finite(F.col(b).cast("double")))
    f = (lambda c: F.percentile(c, F.lit(0.5))) if stat == "median" else F.avg
    return df.groupBy(*keys).agg(*(f(pick(b)).alias(b) for b in bands), F.sum(clear.cast("int")).alias("clear_obs_count"))


def mosaic(df: DataFrame, bands: Sequence[str], order: Sequence[Column], keys: Sequence[str] = CELL) -> DataFrame:
    """The first value that isn't missing of each band and cell, in the given order. A struct minimum, so it combines map-side."""
    rank = [c.alias(f"o{i}") for i, c in enumerate(order)]
    return df.groupBy(*keys).agg(*(F.min(F.when(F.col(b).isNotNull(), F.struct(*rank, F.col(b).alias("v"))))["v"].alias(b) for b in bands))


def best_scene(scenes: DataFrame, cloud: str, clear: str, n: int = 5, ties: str = "scene_id") -> DataFrame:
    """Of the n least cloudy scenes the clearest."""
    return scenes.orderBy(F.asc_nulls_last(cloud), ties).limit(n).orderBy(F.desc_nulls_last(clear), ties).limit(1)


def dedupe_scenes(scenes: DataFrame, by: Sequence[str], latest: str) -> DataFrame:
    """One scene a group: the greatest ``latest``."""
    return scenes.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(latest)))).where("__r = 1").drop("__r")


_DOWN = {"average": F.avg, "min": F.min, "max": F.max, "med": lambda c: F.percentile(c, F.lit(0.5)), "q1": lambda c: F.percentile(c, F.lit(0.25)), "q3": lambda c: F.percentile(c, F.lit(0.75)), "sum": F.sum}


def coarsen(df: DataFrame, factor: int, bands: Sequence[str], method: str = "average", keys: Sequence[str] = CELL) -> DataFrame:
    """Blocks of factor x factor pixels as one; ``mode`` takes the most frequent value, the smaller of equals."""
    put = df.withColumns({k: F.floor(F.col(k) / factor).cast("long") for k in keys})
    if method == "mode":
        out = None
        for b in bands:
            counts = put.where(F.col(b).isNotNull()).groupBy(*keys, b).agg(F.count("*").alias("n"))
            one = counts.groupBy(*keys).agg(F.max_by(b, F.struct("n", -F.col(b))).alias(b))
            out = one if out is None else out.join(one, list(keys), "full_outer")
        return out
    return put.groupBy(*keys).agg(*(_DOWN[method](F.col(b)).alias(b) for b in bands))


def _cubic(t: float, a: float = -0.5) -> float:
    t = abs(t)
    return (a + 2) * t**3 - (a + 3) * t**2 + 1 if t <= 1 else a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0


#: Kernels by distance in pixels and their reach.
KERNELS = {
    "nearest": (lambda t: 1.0 if -0.5 <= t < 0.5 else 0.0, 1),
    "bilinear": (lambda t: max(0.0, 1 - abs(t)), 1),
    "cubic": (_cubic, 2),
    "cubic_spline": (lambda t: (2 / 3 - abs(t) ** 2 + abs(t) ** 3 / 2) if abs(t) < 1 else max(0.0, 2 - abs(t)) ** 3 / 6, 2),
    "lanczos": (lambda t: 1.0 if t == 0 else 0.0 if abs(t) >= 3 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2, 3),
}


def refine(df: DataFrame, factor: int, bands: Sequence[str], method: str = "bilinear", keys: Sequence[str] = CELL) -> DataFrame:
    """``factor`` times finer pixels; missing neighbours are left out and the weights scaled up.

    Each pixel sends its weighted value to the fine pixels its kernel reaches (a fixed number of rows), which sum map-side.
    """
    kernel, reach = KERNELS[method]
    pairs = []
    for o in range(-reach * factor, (reach + 1) * factor + factor):
        t = (o + 0.5) / factor - 0.5
        if abs(w := kernel(t)) > 1e-12:
            pairs.append((o, float(w)))
    offsets = lambda axis: F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in pairs))).alias(axis)
    row, col = keys
    ends = F.broadcast(df.agg(F.min(row).alias("r0"), F.max(row).alias("r1"), F.min(col).alias("c0"), F.max(col).alias("c1")))
    sent = df.select("*", offsets("a")).select("*", offsets("b"))
    sent = sent.select((F.col(row) * factor + F.col("a.o")).alias(row), (F.col(col) * factor + F.col("b.o")).alias(col), (F.col("a.w") * F.col("b.w")).alias("w"), *bands)
    sums = sent.groupBy(row, col).agg(*(F.try_divide(F.sum(F.col(b) * F.col("w")), F.sum(F.when(F.col(b).isNotNull(), F.col("w")))).alias(b) for b in bands))
    inside = F.col(row).between(F.col("r0") * factor, F.col("r1") * factor + factor - 1) & F.col(col).between(F.col("c0") * factor, F.col("c1") * factor + factor - 1)
    return sums.join(ends).where(inside).select(row, col, *bands)


def gradients(df: DataFrame, z: str, res_x: Column, res_y: Column, group: Sequence[str] = (), keys: Sequence[str] = CELL) -> DataFrame:
    """Adds ``dz_dcol, dz_drow``: central differences, one-sided at edges. Pixels of a row or column must be gapless."""
    row, col = keys
    out = df
    for name, axis, across, res in (("dz_dcol", col, row, res_x), ("dz_drow", row, col, res_y)):
        w = Window.partitionBy(*group, across).orderBy(axis)
        a, b = F.lag(z).over(w), F.lead(z).over(w)
        steps = F.when(a.isNotNull() & b.isNotNull(), 2).when(a.isNotNull() | b.isNotNull(), 1)
        out = out.withColumn(name, (F.coalesce(b, F.col(z)) - F.coalesce(a, F.col(z))) / (steps * res))
    return out


def terrain(df: DataFrame, z: str, res: float, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0, group: Sequence[str] = (), keys: Sequence[str] = CELL) -> DataFrame:
    """Adds slope (degrees), aspect (degrees clockwise from north, -1 where flat) and hillshade (0-255)."""
    g = gradients(df, z, F.lit(res), F.lit(res), group, keys)
    dx, dy = F.col("dz_dcol") * z_factor, F.col("dz_drow") * z_factor
    steep = F.atan(F.sqrt(dx * dx + dy * dy))
    # Rows run south: the downslope direction is (-dx, dy) in east, north.
    aspect = F.when((dx == 0) & (dy == 0), -1.0).otherwise(F.pmod(F.degrees(F.atan2(-dx, dy)), F.lit(360.0)))
    zenith, az = math.radians(90 - altitude), math.radians(azimuth)
    facing = F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.atan2(-dx, dy))
    shade = math.cos(zenith) * F.cos(steep) + math.sin(zenith) * F.sin(steep) * F.cos(az - facing)
    return g.withColumns({"slope": F.degrees(steep), "aspect": aspect, "hillshade": F.greatest(F.lit(0.0), shade) * 255}).drop("dz_dcol", "dz_drow")


def focal(df: DataFrame, value: str, size: int, stat: str = "mean", keys: Sequence[str] = CELL, name: str | None = None) -> DataFrame:
    """A size x size neighbourhood's mean, std, min, max, sum, count or majority (the smallest of equals); cells outside are left out.

    Each pixel goes to the size x size cells it is a neighbour of and they aggregate map-side: one shuffle, no join.
    """
    row, col = keys
    half = size // 2
    near = F.explode(F.sequence(F.lit(-half), F.lit(size - 1 - half)))
    sent = df.where(F.col(value).isNotNull()).select((F.col(row)).alias("__r"), F.col(col).alias("__c"), F.col(value).alias("v")).withColumn("i", near).withColumn("j", near)
    sent = sent.select((F.col("__r") + F.col("i")).alias(row), (F.col("__c") + F.col("j")).alias(col), "v", ((F.col("i") == 0) & (F.col("j") == 0)).alias("own"))
    name = name or f"{value}_{stat}_{size}"
    if stat == "majority":
        counts = sent.groupBy(row, col, "v").agg(F.count("*").alias("n"), F.max("own").alias("own"))
        return counts.groupBy(row, col).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias(name), F.max("own").alias("own")).where("own").drop("own")
    f = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "median": lambda c: F.percentile(c, F.lit(0.5))}[stat]
    return sent.groupBy(row, col).agg(f("v").alias(name), F.max("own").alias("own")).where("own").drop("own")


def kernel_filter(df: DataFrame, value: str, kernel: Sequence[Sequence[float]], keys: Sequence[str] = CELL, name: str = "filtered", normalise: bool = False) -> DataFrame:
    """Correlation with a small kernel; with ``normalise`` the weights that met a pixel are scaled to 1 (Gaussian at borders)."""
    row, col = keys
    k = np.asarray(kernel, float)
    cells = [(int(i - k.shape[0] // 2), int(j - k.shape[1] // 2), float(k[i, j])) for i in range(k.shape[0]) for j in range(k.shape[1]) if k[i, j]]
    each = F.explode(F.array(*(F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(w).alias("w")) for i, j, w in cells)))
    sent = df.where(F.col(value).isNotNull()).select(row, col, F.col(value).alias("v"), each.alias("k"))
    sums = sent.groupBy((F.col(row) + F.col("k.i")).alias(row), (F.col(col) + F.col("k.j")).alias(col)).agg(F.sum(F.col("v") * F.col("k.w")).alias("s"), F.sum("k.w").alias("w"))
    out = sums.join(df.where(F.col(value).isNotNull()).select(*keys), list(keys), "left_semi")
    return out.select(row, col, (F.try_divide("s", "w") if normalise else F.col("s")).alias(name))


def gaussian_kernel(sigma: float) -> list[list[float]]:
    r = max(1, int(4 * sigma + 0.5))
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    g /= g.sum()
    return np.outer(g, g).tolist()


#: The usual 3 x 3 kernels.
SOBEL_X, SOBEL_Y = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)), ((-1, -2, -1), (0, 0, 0), (1, 2, 1))
LAPLACE = ((0, 1, 0), (1, -4, 1), (0, 1, 0))


def sobel(df: DataFrame, value: str, keys: Sequence[str] = CELL) -> DataFrame:
    x, y = kernel_filter(df, value, SOBEL_X, keys, "gx"), kernel_filter(df, value, SOBEL_Y, keys, "gy")
    return x.join(y, list(keys)).select(*keys, F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("sobel"))


def sharpen(df: DataFrame, value: str, sigma: float = 1.0, amount: float = 1.0, keys: Sequence[str] = CELL) -> DataFrame:
    """Unsharp mask: the value plus its difference from the smoothed one."""
    smooth = kernel_filter(df, value, gaussian_kernel(sigma), keys, "smooth", normalise=True)
    return df.join(smooth, list(keys)).select(*keys, (F.col(value) + amount * (F.col(value) - F.col("smooth"))).alias("sharp"))


def stretch(df: DataFrame, value: str, lo: float = 0.02, hi: float = 0.98, name: str = "stretched") -> DataFrame:
    """Between two exact quantiles (found before the result is built) to 0..1."""
    a, b = (F.lit(q).cast("double") for q in exact_quantiles(df, {"v": F.col(value)}, (lo, hi))["v"])
    x = F.try_divide(F.col(value) - a, b - a)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))))


def gamma(value: Column, g: float) -> Column:
    return F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), F.lit(1 / g))


def equalize(df: DataFrame, value: str, bins: int = 1024, by: Sequence[str] = (), name: str = "equalized") -> DataFrame:
    """Histogram equalisation: each value's share of smaller ones, straight between bin edges. ``by`` equalises groups (tiles) apart."""
    ends = df.groupBy(*by).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    put = (df.join(ends, list(by)) if by else df.join(F.broadcast(ends))).withColumn("__t", F.coalesce(F.try_divide(F.col(value) - F.col("__a"), F.col("__b") - F.col("__a")) * bins, F.lit(0.0)))
    put = put.withColumn("__bin", F.least(F.lit(bins - 1), F.floor("__t")).cast("int"))
    counts = put.where(F.col(value).isNotNull()).groupBy(*by, "__bin").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    cdf = counts.withColumn("__below", F.sum("__n").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))).withColumn("__all", F.sum("__n").over(w))
    out = put.join(F.broadcast(cdf) if not by else cdf, [*by, "__bin"], "left")  # without groups: at most `bins` rows
    y = (F.coalesce("__below", F.lit(0)) + F.col("__n") * (F.col("__t") - F.col("__bin"))) / F.col("__all")
    return out.withColumn(name, F.when(F.col(value).isNotNull(), y)).drop("__a", "__b", "__t", "__bin", "__n", "__below", "__all")


def clahe(df: DataFrame, value: str, tile: int, clip: float = 0.01, bins: int = 256, keys: Sequence[str] = CELL, name: str = "clahe") -> DataFrame:
    """Contrast-limited equalisation: clipped histograms of tiles, blended bilinearly between the four nearest tile centres.

    Tiles' curves (bins rows a tile) meet pixels in four equi-joins folded into one aggregation; no tile is gathered.
    """
    row, col = keys
    ends = F.broadcast(df.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.max(row).alias("rmax"), F.max(col).alias("cmax")))
    b = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0)) * bins)).cast("int")
    px = df.where(F.col(value).isNotNull()).join(ends).select(*keys, b.alias("bin"), "rmax", "cmax")
    counts = px.groupBy(F.floor(F.col(row) / tile).alias("tr"), F.floor(F.col(col) / tile).alias("tc"), "bin").agg(F.count("*").alias("n"))
    grid = counts.select("tr", "tc").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, ["tr", "tc", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("tr", "tc")
    total = F.sum("n").over(w)
    limit = F.greatest(F.lit(1.0), clip * total)
    cut = F.least(F.col("n").cast("double"), limit)
    clipped = grid.withColumn("c", cut).withColumn("t", total).withColumn("extra", F.sum(F.col("n") - F.col("c")).over(w) / bins)
    cdf = clipped.select("tr", "tc", "bin", (F.sum(F.col("c") + F.col("extra")).over(w.orderBy("bin")) / F.col("t")).alias("y"))
    side = lambda k, m: F.explode(F.array(*(F.struct((F.floor((F.col(k) + 0.5) / tile - 0.5) + d).alias("t"), (((F.col(k) + 0.5) / tile - 0.5 - F.floor((F.col(k) + 0.5) / tile - 0.5)) if d else (1 - ((F.col(k) + 0.5) / tile - 0.5 - F.floor((F.col(k) + 0.5) / tile - 0.5)))).alias("w")) for d in (0, 1))))
    near = px.withColumn("p", side(row, "rmax")).withColumn("q", side(col, "cmax"))
    clamp = lambda t, m: F.least(F.greatest(F.lit(0), t), F.floor(F.col(m) / tile)).cast("long")
    near = near.select(*keys, "bin", clamp(F.col("p.t"), "rmax").alias("tr"), clamp(F.col("q.t"), "cmax").alias("tc"), (F.col("p.w") * F.col("q.w")).alias("w"))
    return near.join(cdf, ["tr", "tc", "bin"]).groupBy(*keys).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias(name))


def zonal(df: DataFrame, zone: str, value: str, prefix: str = "") -> DataFrame:
    """Per zone: mean, min, max, population std, median, sum and count of a value, rounded to 6 places."""
    v = finite(F.col(value).cast("double"))
    stats = {"mean": F.avg(v), "min": F.min(v), "max": F.max(v), "std": F.stddev_pop(v), "median": F.percentile(v, F.lit(0.5)), "sum": F.sum(v)}
    return df.where(F.col(zone).isNotNull()).groupBy(zone).agg(*(F.round(c, 6).alias(prefix + n) for n, c in stats.items()), F.count(v).alias(prefix + "count"))


def zonal_classes(df: DataFrame, zone: str, cls: str) -> DataFrame:
    """``zone, class, percent`` (2 places), and the zone's ``majority`` (the smallest class of equals)."""
    counts = df.where(F.col(zone).isNotNull() & F.col(cls).isNotNull()).groupBy(zone, cls).agg(F.count("*").alias("n"))
    w = Window.partitionBy(zone)
    most = F.first(cls).over(w.orderBy(F.desc("n"), cls).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select(zone, F.col(cls).alias("class"), F.round(100 * F.col("n") / F.sum("n").over(w), 2).alias("percent"), most.alias("majority"))


def patches(df: DataFrame, size: int, stride: int, cls: str | None = None, valid: Column | None = None, keys: Sequence[str] = CELL, min_valid: float = 0.5) -> DataFrame:
    """Overlapping windows: ``prow, pcol``, pixels, valid and labelled fraction and the dominant class (the smaller of equals)."""
    row, col = keys
    span = lambda k: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(k) - size + 1) / stride)).cast("long"), F.floor(F.col(k) / stride).cast("long")))
    ok = F.lit(True) if valid is None else valid
    lab = F.lit(None).cast("string") if cls is None else F.col(cls).cast("string")
    put = df.select(span(row).alias("prow"), F.col(col), ok.alias("ok"), lab.alias("cls")).select("prow", span(col).alias("pcol"), "ok", "cls")
    by_class = put.groupBy("prow", "pcol", "cls").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("int")).alias("ok"))
    area = float(size * size)
    first = F.min(F.when(F.col("cls").isNotNull(), F.struct(-F.col("n"), F.col("cls"))))["cls"]
    g = by_class.groupBy("prow", "pcol").agg(F.sum("n").alias("pixels"), (F.sum("ok") / area).alias("valid_fraction"), (F.coalesce(F.sum(F.when(F.col("cls").isNotNull(), F.col("n"))), F.lit(0)) / area).alias("labelled_fraction"), first.alias("dominant"))
    return g.where(F.col("valid_fraction") >= min_valid)


def connected_regions(df: DataFrame, cls: str, diagonal: bool = False, keys: Sequence[str] = CELL) -> DataFrame:
    """Adds ``region`` (a number) to each pixel: connected pixels of one class. Null classes belong to none.

    Pixels first join into runs along rows (a window), runs touch in the row below (an equi-join on cells), and minimum labels
    spread over runs until stable, with pointer jumps.
    """
    row, col = keys
    w = Window.partitionBy(row).orderBy(col)
    px = df.where(F.col(cls).isNotNull()).select(F.col(row).cast("long").alias(row), F.col(col).cast("long").alias(col), cls)
    new = F.coalesce(((F.lag(cls).over(w) != F.col(cls)) | (F.lag(col).over(w) != F.col(col) - 1)).cast("int"), F.lit(1))
    start = F.max(F.when(F.col("__new") == 1, F.col(col))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = Staged(px.withColumn("__new", new).withColumn("__start", start).withColumn("run", F.col(row) * (1 << 31) + F.col("__start")).drop("__new", "__start"))
    steps = (-1, 0, 1) if diagonal else (0,)
    below = runs.df.select((F.col(row) - 1).alias(row), F.explode(F.array(*(F.col(col) + s for s in steps))).alias(col), F.col(cls).alias("__cls"), F.col("run").alias("other"))
    touch = runs.df.join(below, [row, col]).where(F.col(cls) == F.col("__cls")).select(F.col("run").alias("a"), F.col("other").alias("b")).distinct()
    labels = spread_labels(runs.df.select(F.col("run").alias("node")).distinct(), touch)
    return runs.df.join(labels.select(F.col("node").alias("run"), F.col("label").alias("region")), "run").select(row, col, cls, "region")


def spread_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of each connected component, however many rounds that takes. Rounds are written to the shared folder."""
    both = Staged(edges.select("a", "b").union(edges.select("b", "a")))
    now = Staged(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.df.join(now.df, both.df.b == now.df.node).groupBy("a").agg(F.min("label").alias("near"))
        met = now.df.join(near, now.df.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("best"))
        jump = now.df.select(F.col("node").alias("head"), F.col("label").alias("further"))
        new = Staged(met.join(jump, met.best == jump["head"], "left").select("node", F.least("best", F.coalesce("further", "best")).alias("label"), "old"))
        moved = not new.df.where("label < old").isEmpty()
        now.drop()
        now = new
        if not moved:
            both.drop()
            return now.df.select("node", "label")


def region_boxes(regions: DataFrame, cls: str, pixel_ha: float, min_pixels: int = 1, keys: Sequence[str] = CELL) -> DataFrame:
    """``region, class, pixels, hectares`` and the box of each region of at least ``min_pixels`` (the sieve)."""
    row, col = keys
    g = regions.groupBy("region", cls).agg(F.count("*").alias("pixels"), F.min(row).alias("row0"), F.max(row).alias("row1"), F.min(col).alias("col0"), F.max(col).alias("col1"))
    return g.where(F.col("pixels") >= min_pixels).withColumn("hectares", F.col("pixels") * pixel_ha)


def boundary_edges(df: DataFrame, cls: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Cell edges between different classes, each once: ``row, col, side`` (right or below), with both classes."""
    row, col = keys
    out = None
    for side, dr, dc in (("right", 0, 1), ("below", 1, 0)):
        other = df.select((F.col(row) - dr).alias(row), (F.col(col) - dc).alias(col), F.col(cls).alias("other"))
        part = df.select(row, col, cls).join(other, [row, col]).where(F.col(cls) != F.col("other")).withColumn("side", F.lit(side))
        out = part if out is None else out.unionByName(part)
    return out


def contour_segments(df: DataFrame, z: str, interval: float, base: float = 0.0, keys: Sequence[str] = CELL) -> DataFrame:
    """Marching squares: ``level, x1, y1, x2, y2`` in pixel-centre units (x = column, y = row); saddles by the square's mean.

    The four corners come from one aggregation in which each pixel serves four squares.
    """
    row, col = keys
    corner = F.explode(F.array(*(F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(2 * i + j).alias("k")) for i in (0, 1) for j in (0, 1))))
    sent = df.where(F.col(z).isNotNull()).select(row, col, F.col(z).alias("z"), corner.alias("c"))
    sq = sent.groupBy((F.col(row) + F.col("c.i")).alias("r"), (F.col(col) + F.col("c.j")).alias("c")).agg(*(F.max(F.when(F.col("c.k") == k, F.col("z"))).alias(f"z{k}") for k in range(4))).dropna()
    lo, hi = F.least("z0", "z1", "z2", "z3"), F.greatest("z0", "z1", "z2", "z3")
    n0, n1 = F.floor((lo - base) / interval) + 1, F.ceil((hi - base) / interval) - 1
    sq = sq.withColumn("n", F.explode(F.when(n0 <= n1, F.sequence(n0, n1)).otherwise(F.array().cast("array<long>")))).withColumn("level", base + F.col("n") * interval)
    up = lambda k: F.col(f"z{k}") >= F.col("level")
    part = lambda a, b: (F.col("level") - F.col(f"z{a}")) / (F.col(f"z{b}") - F.col(f"z{a}"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    top, bottom = pt(F.col("c") + part(0, 1), F.col("r") + 0.0), pt(F.col("c") + part(2, 3), F.col("r") + 1.0)
    left, right = pt(F.col("c") + 0.0, F.col("r") + part(0, 2)), pt(F.col("c") + 1.0, F.col("r") + part(1, 3))
    case = sum((up(k).cast("int") * (1 << k) for k in range(4)), F.lit(0))
    seg = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    mid = (F.col("z0") + F.col("z1") + F.col("z2") + F.col("z3")) / 4 >= F.col("level")
    one = {1: (top, left), 2: (top, right), 4: (left, bottom), 8: (right, bottom), 3: (left, right), 5: (top, bottom), 7: (right, bottom), 11: (left, bottom), 13: (top, right), 14: (top, left), 12: (left, right), 10: (top, bottom)}
    segs = F.when(case.isin(6, 9), F.when((case == 6) == mid, F.array(seg(top, left), seg(right, bottom))).otherwise(F.array(seg(top, right), seg(left, bottom))))
    for k, (a, b) in one.items():
        segs = segs.when(case == k, F.array(seg(a, b)))
    return sq.select("level", F.explode(segs).alias("s")).select("level", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def tile_filter(df: DataFrame, value: str, tile: int, halo: int, function, keys: Sequence[str] = CELL, name: str = "filtered") -> DataFrame:
    """Any neighbourhood function on tiles with a halo: ``function(array) -> array`` of the same shape, missing pixels NaN.

    A tile has (tile + 2 halo)^2 pixels at most, so a group is bounded whatever the raster. Used for thinning and large kernels.
    """
    row, col = keys
    span = lambda k: F.explode(F.sequence(F.floor((F.col(k) - halo) / tile).cast("long"), F.floor((F.col(k) + halo) / tile).cast("long")))
    put = df.select(F.col(row).cast("long").alias("r"), F.col(col).cast("long").alias("c"), F.col(value).cast("double").alias("v"), span(row).alias("tr")).select("r", "c", "v", "tr", span("c").alias("tc"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tr"].iloc[0]) * tile - halo, int(pdf["tc"].iloc[0]) * tile - halo
        a = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
        r, c = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
        a[r, c] = pdf["v"].to_numpy()
        out = function(a)
        own = (r >= halo) & (r < tile + halo) & (c >= halo) & (c < tile + halo)
        return pd.DataFrame({"r": r[own] + r0, "c": c[own] + c0, "v": np.asarray(out, float)[r[own], c[own]]})

    return put.groupBy("tr", "tc").applyInPandas(run, "r long, c long, v double").select(F.col("r").alias(row), F.col("c").alias(col), F.col("v").alias(name))


def thin(mask: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Centre lines of a boolean picture: two-pass border peeling until nothing changes, or for so many rounds."""
    a = np.pad(np.nan_to_num(mask) > 0, 1)
    moved = True
    while moved and rounds != 0:
        moved, rounds = False, None if rounds is None else rounds - 1
        for first in (True, False):
            n = [a[:-2, 1:-1], a[:-2, 2:], a[1:-1, 2:], a[2:, 2:], a[2:, 1:-1], a[2:, :-2], a[1:-1, :-2], a[:-2, :-2]]
            count = sum(x.astype(int) for x in n)
            turns = sum((~n[i] & n[(i + 1) % 8]).astype(int) for i in range(8))
            north, east, south, west = n[0], n[2], n[4], n[6]
            open_ = (~(north & east & south) & ~(east & south & west)) if first else (~(north & east & west) & ~(north & south & west))
            gone = a[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (turns == 1) & open_
            if gone.any():
                a[1:-1, 1:-1] &= ~gone
                moved = True
    return a[1:-1, 1:-1].astype(float)


def centre_lines(df: DataFrame, mask: str, tile: int = 256, rounds: int = 16, keys: Sequence[str] = CELL) -> DataFrame:
    """``row, col`` of the centre lines of the pixels where ``mask`` is above 0, as thinning the whole raster at once would give them.

    Tiles peel ``rounds`` rounds with a halo of twice as many pixels, as far as the missing surroundings can reach; then the tiles exchange what
    is left, until no pixel goes. Each exchange is written to the shared folder.
    """
    row, col = keys
    now = Staged(df.where(F.col(mask) > 0).select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.lit(1.0).alias("on")))
    while True:
        new = Staged(tile_filter(now.df, "on", tile, 2 * rounds, lambda a: thin(a, rounds), name="on").where("on > 0"))
        stable = new.rows == now.rows
        now.drop()
        now = new
        if stable:
            return now.df.select(F.col("row").alias(row), F.col("col").alias(col))


def sample_at(pixels: DataFrame, points: DataFrame, x: str, y: str, x0: float, y0: float, res: float, value: str) -> DataFrame:
    """The value of the cell that contains each point; points outside have null."""
    at = align(points, x, y, x0, y0, res)
    return at.join(pixels.select("row", "col", F.col(value).alias("sampled")), ["row", "col"], "left")


def all_finite(bands: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (finite(F.col(b).cast("double")).isNotNull() for b in bands))


def to_points(df: DataFrame, step: int = 1, keys: Sequence[str] = CELL, value: str | None = None) -> DataFrame:
    """Every ``step``-th pixel of every ``step``-th row as a point; with ``value`` only where it is known."""
    row, col = keys
    out = df.where((F.col(row) % step == 0) & (F.col(col) % step == 0)) if step > 1 else df
    return out.where(F.col(value).isNotNull()) if value else out


def pixel_table(df: DataFrame, bands: Sequence[str], label: str | None = None, labelled_only: bool = False, drop_nodata: bool = True, nodata: float = -9999.0) -> DataFrame:
    """One row a pixel and a column a band, missing codes as null; optionally only complete and only labelled pixels."""
    out = df.withColumns({b: finite(F.nullif(F.col(b).cast("double"), F.lit(nodata))) for b in bands})
    if drop_nodata:
        out = out.dropna(subset=list(bands))
    return out.where(F.col(label).isNotNull()) if label and labelled_only else out

