"""Surfaces from scattered points."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.functions.geometry import convex_hull

#: Distances that are held at once.
BLOCK = 4_000_000


def control_points(df: DataFrame, x: str, y: str, value: str) -> np.ndarray:
    """x, y, value of all control points (24 bytes each, on the driver), repeated positions (to 0.01) averaged; ``surface_join`` collects none."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull()).groupBy(F.bround(x, 2).alias("x"), F.bround(y, 2).alias("y")).agg(F.avg(value).alias("z"))
    got = rows.select(*(F.col(c).cast("double") for c in ("x", "y", "z"))).toPandas()
    return got.sort_values(["x", "y"]).to_numpy(float)


def _near(p: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and distances of the k nearest points of each query (0: of all points), in blocks of queries unless all are asked for."""
    if not k or k >= len(p):
        d = np.hypot(q[:, None, 0] - p[None, :, 0], q[:, None, 1] - p[None, :, 1])
        return np.broadcast_to(np.arange(len(p)), d.shape), d
    near, far, block = [np.zeros((0, k), int)], [np.zeros((0, k))], max(1, BLOCK // len(p))
    for a in range(0, len(q), block):
        d = np.hypot(q[a : a + block, None, 0] - p[None, :, 0], q[a : a + block, None, 1] - p[None, :, 1])
        near.append(d.argmin(1)[:, None] if k == 1 else np.argpartition(d, k - 1, 1)[:, :k])
        far.append(np.take_along_axis(d, near[-1], 1))
    return np.concatenate(near), np.concatenate(far)


def idw(p: np.ndarray, q: np.ndarray, power: float = 2.0, k: int = 12) -> np.ndarray:
    """Inverse distance weights of the k nearest points (0: all); exact at points."""
    i, d = _near(p, q, k)
    exact = d.min(1) < 1e-6
    w = 1 / np.maximum(d, 1e-12) ** power
    out = (w * p[i, 2]).sum(1) / w.sum(1)
    out[exact] = np.take_along_axis(p[i, 2], d.argmin(1)[:, None], 1)[exact, 0]
    return out


def nearest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    i, _ = _near(p, q, 1)
    return p[i[:, 0], 2]


def _powers(x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    return np.stack([x**i * y**j for i in range(order + 1) for j in range(order + 1 - i)], 1)


def trend(p: np.ndarray, q: np.ndarray, order: int = 1) -> np.ndarray:
    """Polynomial least squares on centred, scaled coordinates."""
    m, s = p[:, :2].mean(0), p[:, :2].std(0) + 1e-12
    a, b = (p[:, :2] - m) / s, (q - m) / s
    coef, *_ = np.linalg.lstsq(_powers(a[:, 0], a[:, 1], order), p[:, 2], rcond=None)
    return _powers(b[:, 0], b[:, 1], order) @ coef


def spline(p: np.ndarray, q: np.ndarray, smoothing: float = 0.0, local: int = 64, whole: int = 1000) -> np.ndarray:
    """Thin-plate spline through all points up to ``whole`` of them, beyond that through each query's ``local`` nearest ones."""
    if len(p) > whole:
        i, _ = _near(p, q, local)
        return np.array([spline(p[row], q[n : n + 1], smoothing, local, len(p))[0] for n, row in enumerate(i)])
    m, s = p[:, :2].mean(0), p[:, :2].std() + 1e-12
    a, b = (p[:, :2] - m) / s, (q - m) / s
    u = lambda d2: np.where(d2 > 0, d2 * np.log(np.maximum(d2, 1e-300)) / 2, 0.0)
    k = u(((a[:, None] - a[None]) ** 2).sum(2)) + smoothing * np.eye(len(a))
    t = np.column_stack([np.ones(len(a)), a])
    system = np.block([[k, t], [t.T, np.zeros((3, 3))]])
    w = np.linalg.lstsq(system, np.append(p[:, 2], np.zeros(3)), rcond=None)[0]
    return u(((b[:, None] - a[None]) ** 2).sum(2)) @ w[:-3] + np.column_stack([np.ones(len(b)), b]) @ w[-3:]


def variogram_model(model: str, h: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    t = h / max(reach, 1e-12)
    shape = {"spherical": lambda: np.where(t < 1, 1.5 * t - 0.5 * t**3, 1.0), "exponential": lambda: 1 - np.exp(-3 * t), "gaussian": lambda: 1 - np.exp(-3 * t**2), "linear": lambda: np.minimum(t, 1.0)}[model]()
    return np.where(h > 0, nugget + sill * shape, 0.0)


def _farthest(p: np.ndarray) -> float:
    """The largest distance of two points: of two corners of their hull."""
    corners = np.array(convex_hull(p[:, :2].tolist()))
    return max((float(np.hypot(*(corners - c).T).max()) for c in corners), default=0.0)


def _bin_sums(p: np.ndarray, first: int, last: int, top: float, bins: int) -> np.ndarray:
    """Count, sum of distances and of semivariances by bin (the last: beyond ``top``) of the points first .. last - 1 with all later ones."""
    out, block = np.zeros((3, bins + 1)), max(1, BLOCK // 4 // len(p))
    for a in range(first, last, block):
        i = np.arange(a, min(last, a + block))
        h = np.hypot(p[i, None, 0] - p[None, a:, 0], p[i, None, 1] - p[None, a:, 1])
        # Of a row only the points after its own.
        later = (np.arange(a, len(p)) > i[:, None]) & (h < top)
        h, g = h[later], ((p[i, None, 2] - p[None, a:, 2]) ** 2 / 2)[later]
        b = np.minimum((h / top * bins).astype(int), bins)
        out += [np.bincount(b, w, bins + 1) for w in (None, h, g)]
    return out


def variogram_sums(p: np.ndarray, spark: SparkSession | None = None) -> tuple[float, np.ndarray]:
    """Half the largest distance and the sums of ``_bin_sums`` over all pairs below it; with a session, in tasks."""
    pairs = len(p) * (len(p) - 1) // 2
    top, bins = _farthest(p) / 2 if pairs else 1.0, int(np.clip(pairs // 30, 4, 12))
    if spark is None or pairs < BLOCK:
        return top, _bin_sums(p, 0, len(p), top, bins)
    shared, step = spark.sparkContext.broadcast(p), max(1, BLOCK // len(p))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                yield pd.DataFrame({"sums": [_bin_sums(shared.value, int(i), min(int(i) + step, len(shared.value)), top, bins).ravel().tolist()]})

    # Points in any order: each row of the range meets the later points, so mixed tasks share the work evenly.
    starts = spark.range(0, len(p), step).repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("id"))
    return top, np.sum([r[0] for r in starts.mapInPandas(run, "sums array<double>").collect()], 0).reshape(3, bins + 1)


def fit_variogram(p: np.ndarray, model: str = "spherical", spark: SparkSession | None = None, sums: tuple[float, np.ndarray] | None = None) -> tuple[float, float, float]:
    """Nugget, partial sill and range: binned semivariances up to half the largest distance; for each range on a grid the other two by weighted least squares."""
    top, (n, hs, gs) = sums or variogram_sums(p, spark)
    bins = len(n) - 1
    n, hs, gs = n[:bins], hs[:bins], gs[:bins]
    ok = n > 0
    if not ok.any():
        return 0.0, 1e-9, 1.0
    hh, gg, n = hs[ok] / n[ok], gs[ok] / n[ok], n[ok]
    best = (math.inf, 0.0, float(gg.mean()), float(top))
    for reach in np.linspace(0.1, 2, 39) * top:
        f, w = variogram_model(model, hh, 0.0, 1.0, reach), np.sqrt(n)
        for cols in ((np.ones_like(f), f), (f,)):
            c = np.linalg.lstsq(np.stack(cols, 1) * w[:, None], gg * w, rcond=None)[0]
            nug, sill = (c[0], c[1]) if len(c) > 1 else (0.0, c[0])
            err = float((n * (nug + sill * f - gg) ** 2).sum())
            if nug >= 0 and sill > 0 and err < best[0]:
                best = (err, float(nug), float(sill), float(reach))
    floor = 0.01 * (best[1] + best[2]) if model == "gaussian" else 0.0
    return max(best[1], floor), best[2], best[3]


def kriging(p: np.ndarray, q: np.ndarray, model: str = "spherical", fitted: tuple | None = None, local: int = 48, variance: bool = False, whole: int = 500):
    """Ordinary kriging from all points up to ``whole`` of them, beyond that from each query's ``local`` nearest ones; optionally with the standard error."""
    nug, sill, reach = fitted or fit_variogram(p, model)

    def solve(c: np.ndarray, at: np.ndarray):
        n = len(c)
        a = np.ones((n + 1, n + 1))
        a[:n, :n] = variogram_model(model, np.hypot(c[:, None, 0] - c[None, :, 0], c[:, None, 1] - c[None, :, 1]), nug, sill, reach)
        a[n, n] = 0
        b = np.ones((n + 1, len(at)))
        b[:n] = variogram_model(model, np.hypot(c[:, None, 0] - at[None, :, 0], c[:, None, 1] - at[None, :, 1]), nug, sill, reach)
        w = np.linalg.lstsq(a, b, rcond=None)[0]
        return w[:n].T @ c[:, 2], np.sqrt(np.maximum((w * b).sum(0), 0))

    if len(p) <= whole:
        z, se = solve(p, q)
    else:
        near, _ = _near(p, q, local)
        each = [solve(p[row], q[n : n + 1]) for n, row in enumerate(near)]
        z, se = np.array([e[0][0] for e in each]), np.array([e[1][0] for e in each])
    return (z, se) if variance else z


def triangulate(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles by inserting points one by one and rebuilding the hole of each."""
    m, s = xy.mean(0), np.ptp(xy, axis=0).max() + 1e-12
    pts = np.vstack([(xy - m) / s, [[-50, -50], [50, -50], [0, 50]]])
    n = len(xy)
    tri = {(n, n + 1, n + 2)}
    circ: dict = {}

    def circle(t):
        if t not in circ:
            (ax, ay), (bx, by), (cx, cy) = pts[list(t)]
            d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
            if abs(d) < 1e-300:
                circ[t] = (0.0, 0.0, math.inf)
            else:
                x = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
                y = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
                circ[t] = (x, y, (ax - x) ** 2 + (ay - y) ** 2)
        return circ[t]

    for i in range(n):
        x, y = pts[i]
        bad = [t for t in tri if (c := circle(t)) and (x - c[0]) ** 2 + (y - c[1]) ** 2 < c[2] * (1 + 1e-12)]
        edges: dict = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                edges.pop((e[1], e[0])) if (e[1], e[0]) in edges else edges.__setitem__(e, True)
        tri.difference_update(bad)
        tri.update((a, b, i) for a, b in edges)
    return np.array([t for t in tri if max(t) < n], int).reshape(-1, 3)


def _triangle_at(xy: np.ndarray, at: np.ndarray, hull: np.ndarray, first: int = 24) -> np.ndarray | None:
    """The Delaunay triangle of all points that holds ``at`` (None outside the hull), from the points around.

    A triangle of some points whose circumcircle holds no other point is one of all points; points within the circle, or the corners of the hull while no
    triangle holds ``at``, join the points in use until that is so.
    """
    side = lambda a, b: (b[..., 0] - a[..., 0]) * (at[1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (at[0] - a[..., 0])
    scale = float(np.ptp(xy, axis=0).max()) + 1e-12
    if len(hull) < 3 or (side(hull, np.roll(hull, -1, 0)) < -1e-9 * scale * scale).any():
        return None
    away = np.hypot(*(xy - at).T)
    order = np.argsort(away, kind="stable")
    use = order[: min(first, len(xy))]
    while True:
        more = None
        for t in triangulate(xy[use]):
            (ax, ay), (bx, by), (cx, cy) = xy[use[t]]
            d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
            a, b, c = xy[use[t]]
            w = np.array([side(b, c), side(c, a), side(a, b)]) / d if d else np.array([-1.0])
            if (w < -1e-9).any():
                continue
            e, f = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
            m = np.array([ax + (e * (cy - ay) - f * (by - ay)) / (2 * d), ay + (f * (bx - ax) - e * (cx - ax)) / (2 * d)])
            r2 = ((m - a) ** 2).sum()
            from_m = ((xy - m) ** 2).sum(1)
            inner = np.setdiff1d(np.flatnonzero(from_m < r2 * (1 - 1e-9)), use)
            if not len(inner):
                return use[t]
            more = inner[np.argsort(from_m[inner], kind="stable")[:first]]
            break
        if more is None:
            corners = np.flatnonzero((xy[:, None] == hull[None]).all(2).any(1)) if len(hull) * len(xy) <= BLOCK else np.array([int(np.hypot(*(xy - h).T).argmin()) for h in hull])
            more = np.setdiff1d(np.concatenate([corners, order[: 2 * len(use)]]), use)
            if not len(more):
                return None
        use = np.concatenate([use, more])


def tin(p: np.ndarray, q: np.ndarray, outside_nearest: bool = False, whole: int = 1000) -> np.ndarray:
    """Linear within Delaunay triangles; NaN (or the nearest value) outside the hull. Up to ``whole`` points are triangulated at once, of more only what the queries need."""
    out = np.full(len(q), np.nan)
    if len(p) > whole:
        hull = np.array(convex_hull(p[:, :2].tolist()))
        for n, at in enumerate(q):
            if (t := _triangle_at(p[:, :2], at, hull)) is not None:
                out[n] = tin(p[t], at[None], whole=3)[0]
        return np.where(np.isnan(out), nearest(p, q), out) if outside_nearest else out
    for a, b, c in triangulate(p[:, :2]) if len(p) > 2 else ():
        (ax, ay), (bx, by), (cx, cy) = p[[a, b, c], :2]
        d = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
        if d == 0:
            continue
        u = ((by - cy) * (q[:, 0] - cx) + (cx - bx) * (q[:, 1] - cy)) / d
        v = ((cy - ay) * (q[:, 0] - cx) + (ax - cx) * (q[:, 1] - cy)) / d
        ok = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9)
        out[ok] = u[ok] * p[a, 2] + v[ok] * p[b, 2] + (1 - u[ok] - v[ok]) * p[c, 2]
    return np.where(np.isnan(out), nearest(p, q), out) if outside_nearest else out


def natural_neighbour(p: np.ndarray, q: np.ndarray, resolution: int = 40) -> np.ndarray:
    """Discrete Sibson weights: each grid node inside a query's new cell passes on its nearest point's value."""
    lo, hi = p[:, :2].min(0), p[:, :2].max(0)
    pad = 0.3 * (hi - lo + 1e-9)
    gx, gy = (np.linspace(lo[k] - pad[k], hi[k] + pad[k], resolution) for k in (0, 1))
    g = np.stack(np.meshgrid(gx, gy), -1).reshape(-1, 2)
    i, d = _near(p, g, 1)
    own, far = p[i[:, 0], 2], d[:, 0]
    dq = np.hypot(q[:, None, 0] - g[None, :, 0], q[:, None, 1] - g[None, :, 1])
    inside = dq < far[None]
    n = inside.sum(1)
    return np.where(n > 0, (inside * own).sum(1) / np.maximum(n, 1), nearest(p, q))


METHODS: dict[str, Callable] = {"idw": idw, "nearest": nearest, "trend": trend, "spline": spline, "kriging": kriging, "tin": tin, "natural": natural_neighbour}


def interpolate(points: np.ndarray, grid: DataFrame, method: str, block: int = 2000, **options) -> DataFrame:
    """Adds ``value`` to the rows of ``grid`` (x, y) in Arrow batches; the control points travel once to each executor."""
    f, shared = METHODS[method], grid.sparkSession.sparkContext.broadcast(points)
    schema = T.StructType([*grid.schema.fields, T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), block):
                part = pdf.iloc[a : a + block].copy()
                z = f(shared.value, part[["x", "y"]].to_numpy(float), **options)
                part["value"] = np.where(np.isfinite(z), z, np.nan)
                yield part

    return grid.mapInPandas(run, schema).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def grid_cells(spark, x0: float, y0: float, x1: float, y1: float, res: float) -> DataFrame:
    """Cell centres of a box: ``row, col, x, y``."""
    rows, cols = max(1, math.ceil((y1 - y0) / res)), max(1, math.ceil((x1 - x0) / res))
    g = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return g.select("row", "col", (x0 + (F.col("col") + 0.5) * res).alias("x"), (y1 - (F.col("row") + 0.5) * res).alias("y"))


def _sums_without(p: np.ndarray, i: int, top: float, sums: np.ndarray) -> tuple[float, np.ndarray] | None:
    """``variogram_sums`` of the points without one of them; None where it held the largest distance, or where the bins change."""
    rest, bins = np.delete(p, i, 0), sums.shape[1] - 1
    h = np.hypot(*(rest[:, :2] - p[i, :2]).T)
    pairs = len(rest) * (len(rest) - 1) // 2
    if not len(h) or h.max() >= 2 * top * (1 - 1e-9) or int(np.clip(pairs // 30, 4, 12)) != bins:
        return None
    ok = h < top
    b = np.minimum((h[ok] / top * bins).astype(int), bins)
    g = (rest[ok, 2] - p[i, 2]) ** 2 / 2
    return top, sums - [np.bincount(b, w, bins + 1) for w in (None, h[ok], g)]


def leave_one_out(points: np.ndarray, method: str, folds: int = 60, spark: SparkSession | None = None, **options) -> dict:
    """rmse, mae, bias and checked share over evenly chosen left-out points. For kriging the pairs are summed once, less those of the point left out."""
    each = lambda i: options
    if method == "kriging" and "fitted" not in options and len(points) > 500:
        top, sums = variogram_sums(points, spark)
        each = lambda i: options | {"fitted": fit_variogram(np.delete(points, i, 0), options.get("model", "spherical"), spark, _sums_without(points, i, top, sums))}
    pick = np.unique(np.linspace(0, len(points) - 1, min(folds, len(points))).round().astype(int)) if len(points) else []
    errors = []
    for i in pick:
        z = METHODS[method](np.delete(points, i, 0), points[i : i + 1, :2], **each(i))[0]
        if np.isfinite(z):
            errors.append(z - points[i, 2])
    e = np.array(errors)
    return {"method": method, "rmse": float(np.sqrt((e**2).mean())) if len(e) else None, "mae": float(np.abs(e).mean()) if len(e) else None, "bias": float(e.mean()) if len(e) else None, "checked": len(e) / max(1, len(pick))}


def compare_methods(points: np.ndarray, methods: Sequence[str] = tuple(METHODS), spark: SparkSession | None = None) -> list[dict]:
    """Methods that could check at least 80 % first, then by error."""
    got = [leave_one_out(points, m, 25 if m == "natural" else 60, spark) for m in methods]
    return sorted(got, key=lambda r: (r["checked"] < 0.8, math.inf if r["rmse"] is None else r["rmse"]))


def surface_join(points: DataFrame, grid: DataFrame, x: str, y: str, value: str, key: str, method: str = "idw", k: int = 12, power: float = 2.0) -> DataFrame:
    """``row, col, value`` by inverse distances or the nearest point for any number of points: a join with the k nearest ones in growing reaches.

    Points with a null position or value don't count; a cell on a point has its value (of several the one with the smallest key).
    """
    from loamgrid.operators.joins import nearest_k

    known = points.select(F.col(key).alias("__p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("__v")).dropna()
    cells = grid.select((F.col("row").cast("long") * (1 << 31) + F.col("col")).alias("__c"), "x", "y")
    near = nearest_k(cells, known, "x", "y", "__c", "__p", 1 if method == "nearest" else k).join(known.select(F.col("__p").alias("b_key"), "__v"), "b_key")
    w = 1 / F.pow(F.greatest(F.col("dist"), F.lit(1e-12)), F.lit(power))
    on = F.min(F.when(F.col("dist") < 1e-6, F.struct("dist", "b_key", "__v")))["__v"]
    out = near.groupBy("a_key").agg(F.coalesce(on, F.sum(w * F.col("__v")) / F.sum(w)).alias("value"))
    return out.select(F.shiftright("a_key", 31).cast("int").alias("row"), F.col("a_key").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("col"), "value")
