"""Geometry: measures as Column expressions over coordinate arrays, and exact planar set operations for small polygons.

A shape column is ``array<array<array<array<double>>>>``: parts, rings, points, [x, y] (GeoJSON's MultiPolygon coordinates). A line
is a part with one open ring.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.functions.curves import EARTH_M

SHAPE = "array<array<array<array<double>>>>"
SHAPE_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))

# --- Column expressions ---------------------------------------------------------------------------------------------


def _pairs(ring: Column, of) -> Column:
    """Sum of ``of(a, b)`` over a ring's consecutive points."""
    n = F.size(ring)
    return F.aggregate(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + of(ring[i - 1], ring[i]))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area, relative to the first point for precision."""
    x0, y0 = ring[0][0], ring[0][1]
    return _pairs(ring, lambda a, b: ((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0)) / 2)


def shape_area(shape: Column) -> Column:
    """Outer rings less holes."""
    part = lambda rings: F.aggregate(F.sequence(F.lit(0), F.size(rings) - 1), F.lit(0.0), lambda s, i: s + F.when(i == 0, F.abs(ring_area(rings[i]))).otherwise(-F.abs(ring_area(rings[i]))))
    box = F.transform(F.array(shape), lambda s: F.when(_is_box(s), F.abs((s[0][0][2][0] - s[0][0][0][0]) * (s[0][0][2][1] - s[0][0][0][1]))))[0]
    return F.coalesce(box, F.aggregate(shape, F.lit(0.0), lambda s, rings: s + part(rings)))


def shape_length(shape: Column) -> Column:
    """Length of all rings (perimeter, or length of lines)."""
    dist = lambda a, b: F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))
    return F.aggregate(F.flatten(shape), F.lit(0.0), lambda s, ring: s + _pairs(ring, dist))


def shape_box(shape: Column) -> Column:
    """struct x0, y0, x1, y1."""
    points = F.flatten(F.flatten(shape))
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def _is_box(shape: Column) -> Column:
    ring = F.try_element_at(F.try_element_at(shape, F.lit(1)), F.lit(1))
    at = lambda i, k: F.try_element_at(F.try_element_at(ring, F.lit(i + 1)), F.lit(k + 1))
    same = lambda i, j, k: at(i, k) == at(j, k)
    turn = lambda k: same(0, 1, k) & same(1, 2, 1 - k) & same(2, 3, k) & same(3, 0, 1 - k)
    whole = (F.size(shape) == 1) & (F.size(F.try_element_at(shape, F.lit(1))) == 1) & (F.size(ring) == 5) & same(0, 4, 0) & same(0, 4, 1)
    return F.coalesce(whole & (turn(0) | turn(1)) & (at(0, 0) != at(2, 0)) & (at(0, 1) != at(2, 1)), F.lit(False))


def is_box(shape: Column) -> Column:
    """Whether the shape is one upright rectangle: four corners and the first again. Bound as a variable, so that the shape's own expression isn't repeated."""
    return F.transform(F.array(shape), _is_box)[0]


def plain_box(shape: Column) -> Column:
    """struct x0, y0, x1, y1 of an upright rectangle, null for any other shape."""

    def corners(s: Column) -> Column:
        p, q = s[0][0][0], s[0][0][2]
        box = F.struct(F.least(p[0], q[0]).alias("x0"), F.least(p[1], q[1]).alias("y0"), F.greatest(p[0], q[0]).alias("x1"), F.greatest(p[1], q[1]).alias("y1"))
        return F.when(_is_box(s), box)

    return F.transform(F.array(shape), corners)[0]


def box_shape(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The shape of an upright rectangle, counter-clockwise."""
    return F.array(F.array(F.array(*(F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))))))


def shape_centroid(shape: Column) -> Column:
    """Area-weighted centroid (struct x, y), holes subtracted; for shapes without area the mean of the points."""

    def moments(rings: Column) -> Column:
        ox, oy = rings[0][0][0], rings[0][0][1]

        def ring(r: Column, sign: Column) -> Column:
            cross = lambda a, b: (a[0] - ox) * (b[1] - oy) - (b[0] - ox) * (a[1] - oy)
            turn = F.signum(_pairs(r, cross)) * sign
            return F.array(turn * _pairs(r, cross) / 2, turn * _pairs(r, lambda a, b: cross(a, b) * (a[0] + b[0] - 2 * ox)) / 6, turn * _pairs(r, lambda a, b: cross(a, b) * (a[1] + b[1] - 2 * oy)) / 6)

        add = lambda s, m: F.zip_with(s, m, lambda a, b: a + b)
        m = F.aggregate(F.sequence(F.lit(0), F.size(rings) - 1), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda s, i: add(s, ring(rings[i], F.when(i == 0, 1.0).otherwise(-1.0))))
        return F.array(m[0], m[1] + m[0] * ox, m[2] + m[0] * oy)

    total = F.aggregate(shape, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda s, rings: F.zip_with(s, moments(rings), lambda a, b: a + b))
    points = F.flatten(F.flatten(shape))
    mean = lambda i: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[i]) / F.size(points)
    return F.transform(F.array(total), lambda t: F.struct(F.coalesce(F.try_divide(t[1], t[0]), mean(0)).alias("x"), F.coalesce(F.try_divide(t[2], t[0]), mean(1)).alias("y")))[0]


def contains_point(shape: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings."""

    def crossing(a: Column, b: Column) -> Column:
        spans = (a[1] > y) != (b[1] > y)
        return F.when(spans & (x < (b[0] - a[0]) * (y - a[1]) / F.when(a[1] != b[1], b[1] - a[1]) + a[0]), 1.0).otherwise(0.0)

    return F.aggregate(F.flatten(shape), F.lit(0.0), lambda s, ring: s + _pairs(ring, crossing)) % 2 == 1


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone: 326xx north, 327xx south."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6) + 1)).cast("int")
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


#: WGS84 and the transverse Mercator series in its third flattening, to order 4.
_A, _FLAT = 6378137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def to_utm(lon, lat, epsg, m=F):
    """Easting and northing; ``m`` is the function module (Column functions, or numpy for arrays)."""
    zone = epsg % 100
    south = (epsg // 100 == 327) if m is np else (epsg >= 32700)
    p, l = m.radians(lat), m.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    atanh = m.arctanh if m is np else m.atanh
    t = m.sinh(atanh(m.sin(p)) - e * atanh(e * m.sin(p)))
    atan2 = m.arctan2 if m is np else m.atan2
    xi, eta = atan2(t, m.cos(l)), atanh(m.sin(l) / m.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        y = y + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    shift = np.where(south, 1e7, 0.0) if m is np else F.when(south, 1e7).otherwise(0.0)
    return 500_000 + 0.9996 * _RECT * x, shift + 0.9996 * _RECT * y


def from_utm(x, y, epsg, m=F):
    """Longitude and latitude of an easting and northing."""
    zone = epsg % 100
    shift = np.where(epsg // 100 == 327, 1e7, 0.0) if m is np else F.when(epsg >= 32700, 1e7).otherwise(0.0)
    xi, eta = (y - shift) / (0.9996 * _RECT), (x - 500_000) / (0.9996 * _RECT)
    a, b = xi, eta
    for j, c in enumerate(_BETA, 1):
        a = a - c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        b = b - c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    asin = m.arcsin if m is np else m.asin
    atan2 = m.arctan2 if m is np else m.atan2
    chi = asin(m.sin(a) / m.cosh(b))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * m.sin(2 * j * chi)
    return m.degrees(atan2(m.sinh(b), m.cos(a))) + (zone * 6 - 183), m.degrees(lat)


def sphere_area(ring: Column) -> Column:
    """Area of a lon/lat ring on the sphere: half the absolute sum of dlon * (2 + sin lat1 + sin lat2), times R squared."""
    s = _pairs(ring, lambda a, b: F.radians(b[0] - a[0]) * (2 + F.sin(F.radians(a[1])) + F.sin(F.radians(b[1]))))
    return F.abs(s) * EARTH_M**2 / 2


# --- Planar set operations in Python, for one feature (or one pair) at a time ---------------------------------------


def _segments(polygons: Sequence) -> list[tuple[float, float, float, float, int]]:
    """Edges that aren't horizontal, from lower to upper end, with the polygon's number."""
    out = []
    for k, rings in enumerate(polygons):
        for ring in rings:
            pts = [tuple(map(float, p[:2])) for p in ring]
            if pts and pts[0] != pts[-1]:
                pts.append(pts[0])
            for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
                if ay != by:
                    out.append((ax, ay, bx, by, k) if ay < by else (bx, by, ax, ay, k))
    return out


def set_operation(a: Sequence, b: Sequence, keep) -> list:
    """Polygons of the points for which ``keep(in_a, in_b)`` holds; a and b are lists of polygons (unions of even-odd shapes).

    The plane is cut into slabs at all vertices and crossings; within a slab edges don't cross, so the inside is a row of trapezoids. Their
    outlines, with shared borders cancelled, are chained into rings. Exact but for rounding of crossings.
    """
    edges = _segments([*a, *b])
    if not edges:
        return []
    arr = np.array([e[:4] for e in edges])
    owner = np.array([e[4] for e in edges])
    ys = set(arr[:, 1]) | set(arr[:, 3])
    d = arr[:, 2:] - arr[:, :2]
    for i in range(len(arr) - 1):
        # Crossings of edge i with all later ones.
        o = arr[i + 1 :]
        cross = d[i, 0] * d[i + 1 :, 1] - d[i, 1] * d[i + 1 :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((o[:, 0] - arr[i, 0]) * d[i + 1 :, 1] - (o[:, 1] - arr[i, 1]) * d[i + 1 :, 0]) / cross
            u = ((o[:, 0] - arr[i, 0]) * d[i, 1] - (o[:, 1] - arr[i, 1]) * d[i, 0]) / cross
        ok = (np.abs(cross) > 1e-18) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        ys.update((arr[i, 1] + t[ok] * d[i, 1]).tolist())
    scale = max(1e-12, float(np.abs(arr).max()))
    levels = []
    for y in sorted(ys):
        if not levels or y - levels[-1] > 1e-12 * scale:
            levels.append(y)
    at = lambda e, y: arr[e, 0] + d[e, 0] * (y - arr[e, 1]) / d[e, 1]
    n_a, key = len(a), lambda v: round(v / scale * 1e11)
    lines: dict = {}
    below: list[tuple[float, float]] = []

    def add(p, q) -> None:
        if (key(p[0]), key(p[1])) != (key(q[0]), key(q[1])):
            lines[len(lines)] = (p, q)

    def caps(y: float, low: list, high: list) -> None:
        """Horizontal borders: covered on one side only."""
        marks = defaultdict(int)
        for x0, x1 in low:
            marks[x0] += 1
            marks[x1] -= 1
        other = defaultdict(int)
        for x0, x1 in high:
            other[x0] += 1
            other[x1] -= 1
        xs, lo, hi = sorted({*marks, *other}), 0, 0
        for x, nxt in zip(xs, xs[1:], strict=False):
            lo, hi = lo + marks[x], hi + other[x]
            if bool(lo) != bool(hi):
                add((nxt, y), (x, y)) if lo else add((x, y), (nxt, y))

    for y0, y1 in zip(levels, levels[1:], strict=False):
        mid = (y0 + y1) / 2
        live = np.flatnonzero((arr[:, 1] <= mid) & (arr[:, 3] > mid))
        order = sorted(live.tolist(), key=lambda e: at(e, mid))
        inside, rows, start = defaultdict(bool), [], None
        was = False
        for e in order:
            inside[owner[e]] = not inside[owner[e]]
            now = keep(any(inside[k] for k in range(n_a)), any(v for k, v in inside.items() if k >= n_a))
            if now and not was:
                start = e
            elif was and not now:
                if at(e, mid) - at(start, mid) > 1e-13 * scale:
                    rows.append((start, e))
            was = now
        low = [(at(s, y0), at(e, y0)) for s, e in rows]
        caps(y0, below, low)
        for s, e in rows:
            add((at(s, y1), y1), (at(s, y0), y0))
            add((at(e, y0), y0), (at(e, y1), y1))
        below = [(at(s, y1), at(e, y1)) for s, e in rows]
    if levels:
        caps(levels[-1], below, [])
    return _chain(list(lines.values()), key)


#: Grid cells of a union of rectangles that are held at once.
GRID_CELLS = 4_000_000


def box_rows(boxes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """The union of rectangles (rows x0, y0, x1, y1) on the grid of all their borders: xs, ys, first row and whether cells are covered, in blocks of rows."""
    xs, ys = np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])
    i0, i1, j0, j1 = (np.searchsorted(g, boxes[:, k]) for g, k in ((xs, 0), (xs, 2), (ys, 1), (ys, 3)))
    n, block = len(xs) - 1, max(1, GRID_CELLS // len(xs))
    for a in range(0, len(ys) - 1, block):
        b = min(a + block, len(ys) - 1)
        ok = (j0 < b) & (j1 > a)
        low, high = np.maximum(j0[ok], a) - a, np.minimum(j1[ok], b) - a
        steps = np.zeros((b - a + 1) * (n + 1), np.int32)
        for j, i, sign in ((low, i0[ok], 1), (low, i1[ok], -1), (high, i0[ok], -1), (high, i1[ok], 1)):
            steps += sign * np.bincount(j * (n + 1) + i, minlength=len(steps)).astype(np.int32)
        yield xs, ys, a, steps.reshape(b - a + 1, n + 1).cumsum(0).cumsum(1)[:-1, :-1] > 0


def _runs(marks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Row, first and last plus one of the runs of true cells in the rows."""
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, first = np.nonzero(edge > 0)
    yield from zip(rows.tolist(), first.tolist(), np.nonzero(edge < 0)[1].tolist(), strict=True)


def box_union(boxes: np.ndarray, inside: Sequence[float] | None = None) -> list:
    """Polygons of the union of rectangles; with ``inside`` (a rectangle) what they leave of it."""
    if inside is not None:
        x0, y0, x1, y1 = inside
        boxes = np.column_stack([np.maximum(boxes[:, 0], x0), np.maximum(boxes[:, 1], y0), np.minimum(boxes[:, 2], x1), np.minimum(boxes[:, 3], y1)])
    boxes = boxes[(boxes[:, 0] < boxes[:, 2]) & (boxes[:, 1] < boxes[:, 3])]
    if inside is not None:
        if not len(boxes):
            return [[[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]]
        # A rim without area puts the rectangle's borders on the grid.
        boxes = np.vstack([boxes, [(x0, y0, x0, y0), (x1, y1, x1, y1)]])
    if not len(boxes):
        return []
    lines: list = []
    before, xs = None, None
    for xs, ys, a, full in box_rows(boxes):  # noqa: B007
        full = ~full if inside is not None else full
        both = np.vstack([np.zeros((1, full.shape[1]), bool) if before is None else before, full])
        px, py = xs.tolist(), ys.tolist()
        lines += [((px[i], py[a + r]), (px[j], py[a + r])) for r, i, j in _runs(~both[:-1] & both[1:])]
        lines += [((px[j], py[a + r]), (px[i], py[a + r])) for r, i, j in _runs(both[:-1] & ~both[1:])]
        wide = np.pad(full, ((0, 0), (1, 1)))
        lines += [((px[c], py[a + j]), (px[c], py[a + i])) for c, i, j in _runs((wide[:, 1:] & ~wide[:, :-1]).T)]
        lines += [((px[c], py[a + i]), (px[c], py[a + j])) for c, i, j in _runs((~wide[:, 1:] & wide[:, :-1]).T)]
        before = full[-1:]
    lines += [((px[j], py[-1]), (px[i], py[-1])) for _, i, j in _runs(before)]
    scale = max(1e-12, float(np.abs(boxes).max()))
    return _chain(lines, lambda v: round(v / scale * 1e11))


def fewer_boxes(boxes: np.ndarray) -> np.ndarray:
    """Rectangles with the same union: runs of covered cells, equal runs of following rows as one; the given ones where that isn't less."""
    done, open_ = [], {}
    for xs, ys, a, full in box_rows(boxes):
        rows: dict = {}
        for r, i, j in _runs(full):
            rows.setdefault(r, []).append((i, j))
        for r in range(full.shape[0]):
            now = {run: open_.pop(run, a + r) for run in rows.get(r, ())}
            done += [(xs[i], ys[start], xs[j], ys[a + r]) for (i, j), start in open_.items()]
            open_ = now
        if len(done) >= len(boxes):
            return boxes
    done += [(xs[i], ys[start], xs[j], ys[-1]) for (i, j), start in open_.items()]
    return np.array(done, float).reshape(-1, 4) if len(done) < len(boxes) else boxes


def _chain(lines: list, key) -> list:
    """Rings of directed border lines, holes put into the smallest ring around them."""
    node = lambda p: (key(p[0]), key(p[1]))
    out = defaultdict(list)
    for p, q in lines:
        out[node(p)].append((p, q))
    rings = []
    for first in list(out):
        while out[first]:
            p, q = out[first].pop()
            ring = [p]
            while node(q) != first:
                ring.append(q)
                if not out[node(q)]:
                    ring = []
                    break
                # At a touching corner the sharpest left turn keeps rings simple.
                opts = out[node(q)]
                ang = math.atan2(q[1] - ring[-2][1] if len(ring) > 1 else q[1] - p[1], q[0] - (ring[-2][0] if len(ring) > 1 else p[0]))
                best = max(range(len(opts)), key=lambda i: (math.atan2(opts[i][1][1] - opts[i][0][1], opts[i][1][0] - opts[i][0][0]) - ang + math.pi) % (2 * math.pi)) if len(opts) > 1 else 0
                q = opts.pop(best)[1]
            if len(ring) > 2:
                rings.append(_straight(ring))
    rings = [r for r in rings if len(r) > 2]
    area = [_area(r) for r in rings]
    outer = [[r] for r, s in zip(rings, area, strict=True) if s > 0]
    for r, s in zip(rings, area, strict=True):
        if s < 0:
            p = ((r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2)
            homes = [o for o in outer if abs(_area(o[0])) >= abs(s) and _within(o[0], p)]
            if homes:
                min(homes, key=lambda o: abs(_area(o[0]))).append(r)
    return [[[list(p) for p in [*ring, ring[0]]] for ring in o] for o in outer]


def _straight(ring: list) -> list:
    """Without points on straight lines."""
    out, n = [], len(ring)
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = (out[-1] if out else ring[i - 1]), ring[i], ring[(i + 1) % n]
        cross = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
        if abs(cross) > 1e-12 * (math.hypot(bx - ax, by - ay) * math.hypot(cx - bx, cy - by) + 1e-300):
            out.append(ring[i])
    return out


def _area(ring: Sequence) -> float:
    x0, y0 = ring[0][:2]
    return sum((p[0] - x0) * (q[1] - y0) - (q[0] - x0) * (p[1] - y0) for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def _within(ring: Sequence, p) -> bool:
    odd, (x, y) = False, p
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


OPERATIONS = {"intersection": lambda p, q: p and q, "union": lambda p, q: p or q, "difference": lambda p, q: p and not q, "symmetric": lambda p, q: p != q}


def area_of(polygons: Sequence) -> float:
    return sum(abs(_area(p[0])) - sum(abs(_area(h)) for h in p[1:]) for p in polygons if p and len(p[0]) > 2)


def circle(x: float, y: float, r: float, segments: int = 64) -> list:
    t = np.arange(segments) * (2 * math.pi / segments)
    return [[[x + r * math.cos(a), y + r * math.sin(a)] for a in t]]


def buffer_shape(kind: str, parts: Sequence, distance: float, segments: int = 64) -> list:
    """All points within ``distance`` of points, lines or polygons (planar); a negative distance shrinks polygons."""
    r, shapes = abs(distance), []
    rings = [ring for part in parts for ring in part]
    if distance > 0 and len(rings) == 1 and (kind != "polygon" or _convex(rings[0])) and (kind != "line" or len(rings[0]) < 3):
        # A convex shape grown by a disc is the hull of the discs at its corners.
        hull = convex_hull([q for p in rings[0] for q in circle(p[0], p[1], r, segments)[0]])
        return [[[*hull, hull[0]]]]
    for ring in rings:
        closed = [*ring, ring[0]] if kind == "polygon" and ring[0] != ring[-1] else ring
        if kind == "point" or len(closed) < 2:
            shapes += [circle(p[0], p[1], r, segments) for p in ring]
            continue
        for a, b in zip(closed, closed[1:], strict=False):
            shapes.append([convex_hull(circle(*a[:2], r, segments)[0] + circle(*b[:2], r, segments)[0])])
    if distance < 0:
        return set_operation(list(parts), shapes, OPERATIONS["difference"]) if kind == "polygon" else []
    return set_operation([*(parts if kind == "polygon" else ()), *shapes], [], lambda p, q: p)


def _convex(ring: Sequence) -> bool:
    pts = ring[:-1] if ring[0] == ring[-1] else ring
    turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(pts, [*pts[1:], pts[0]], [*pts[2:], *pts[:2]], strict=True)]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def convex_hull(points: Sequence) -> list:
    """Monotone chain, counter-clockwise; points that are off a straight line by rounding only are no corners."""
    pts = sorted({tuple(map(float, p[:2])) for p in points})
    if len(pts) < 3:
        return [list(p) for p in pts]

    def left(a, b, c) -> bool:
        u, v = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
        return u - v > 1e-12 * (abs(u) + abs(v))

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and not left(out[-2], out[-1], p):
                out.pop()
            out.append(p)
        return out[:-1]

    return [list(p) for p in half(pts) + half(reversed(pts))]


def grown_boxes(boxes: np.ndarray, r: float, segments: int) -> np.ndarray:
    """Closed rings (box, point, x and y) around upright rectangles (rows x0, y0, x1, y1): the hulls of discs of ``segments`` corners (a multiple of 4) around their corners, counter-clockwise from the lower left."""
    q, step = segments // 4, 2 * math.pi / segments
    corners = ((2, 0, 1), (3, 2, 1), (0, 2, 3), (1, 0, 3))  # quarter of the disc, and the corner as places of x and y
    points = [(cx, cy, r * math.cos(t), r * math.sin(t)) for k, cx, cy in corners for t in ((k * q + i) * step for i in range(q + 1))]
    cx, cy, dx, dy = (np.array(v) for v in zip(*points, points[0], strict=True))
    return np.stack([boxes[:, cx] + dx, boxes[:, cy] + dy], 2)


def simplify_line(points: Sequence, tolerance: float) -> list:
    """The points farther than the tolerance from the line between kept ones (an explicit stack, for long lines)."""
    p = np.asarray([q[:2] for q in points], float)
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        line, rel = p[b] - p[a], p[a + 1 : b] - p[a]
        n = math.hypot(*line)
        far = np.abs(line[0] * rel[:, 1] - line[1] * rel[:, 0]) / n if n else np.hypot(*rel.T)
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return p[keep].tolist()


def inside_point(polygons: Sequence) -> list[float] | None:
    """A point well inside: the middle of the widest stretch on the horizontal line through the box's middle."""
    ys = [q[1] for p in polygons for r in p for q in r]
    if not ys:
        return None
    y = (min(ys) + max(ys)) / 2 + 1e-9 * (max(ys) - min(ys))
    xs = sorted(ax + (bx - ax) * (y - ay) / (by - ay) for ax, ay, bx, by, _ in _segments(polygons) if ay <= y < by)
    widest = max(zip(xs[::2], xs[1::2], strict=False), key=lambda s: s[1] - s[0], default=None)
    return [(widest[0] + widest[1]) / 2, y] if widest else None


def repaired(polygons: Sequence) -> list:
    """Valid parts of a polygon by the even-odd rule: rings closed, repeated points and zero areas dropped, self-crossings cut."""
    out = []
    for p in polygons:
        out += set_operation([p], [], lambda q, _: q)
    return out
