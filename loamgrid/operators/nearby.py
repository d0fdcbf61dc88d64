"""Points near other points, and the regions that contain points: range joins on sorted curve codes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.curves import EARTH_M, great_circle_array, morton_array, morton_int, sphere_level, sphere_xyz_array, usable
from loamgrid.storage import BROADCAST_BYTES, Staged

#: Points of one stretch of the sorted codes (a block) that a task joins at a time, and pairs that it holds at a time.
BLOCK_ROWS, PAIRS = 20_000, 2_000_000
SPHERE_BITS, CURVE_BITS = 21, 24


# --- Blocks of sorted codes ------------------------------------------------------------------------------------------


def _cuts(coded: Staged) -> np.ndarray:
    """The codes at which blocks of about BLOCK_ROWS points end. A code that ends several blocks has points for all of them.

    One code a block comes to the driver, from a map-side combined quantile sketch.
    """
    blocks = max(1, -(-coded.rows // BLOCK_ROWS))
    if blocks == 1:
        return np.zeros(0, np.int64)
    shares = [i / blocks for i in range(1, blocks)]
    return np.array(coded.df.agg(F.percentile_approx("code", shares, max(10_000, 20 * blocks))).first()[0], np.int64)


def _home_block(cuts: np.ndarray, code: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The block of each point; points of a code that ends several blocks take turns."""
    first, many = np.searchsorted(cuts, code, "left"), np.searchsorted(cuts, code, "right")
    return first + turn % np.maximum(1, many - first)


def _range_blocks(cuts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range the blocks it meets: row numbers and blocks."""
    first = np.searchsorted(cuts, lo, "left")
    last = np.maximum(np.searchsorted(cuts, hi, "left"), np.searchsorted(cuts, hi, "right") - 1)
    many = last - first + 1
    row = np.repeat(np.arange(len(lo)), many)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _matches(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(range, point) numbers of all sorted ``codes`` within the ranges, at most about PAIRS at a time."""
    a = np.searchsorted(codes, lo, "left")
    many = np.maximum(0, np.searchsorted(codes, hi, "right") - a)
    total = np.cumsum(many)
    start = 0
    while start < len(lo):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = many[start:stop]
        r = np.repeat(np.arange(start, stop), n)
        yield r, a[r] + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def _each_block(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """(points, some ranges) of one block after the other, from rows sorted by block, kind (0 a point, 1 a range) and code."""
    block, points, whole = None, [], None
    for pdf in batches:
        for b, part in pdf.groupby("block", sort=True):
            if b != block:
                block, points, whole = b, [], None
            kind = part["kind"].to_numpy()
            if (kind == 0).any():
                points.append(part[kind == 0])
            ranges = part[kind == 1]
            if len(ranges) and points:
                if whole is None:
                    whole = pd.concat(points, ignore_index=True)
                yield whole, ranges


def _sorted_by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block", "kind", "lo")


# --- Points near points ----------------------------------------------------------------------------------------------


def _cells(xyz: np.ndarray, level: int, radius: float, shift: float = 0.0) -> np.ndarray:
    return np.floor((xyz + shift + 1.001 * radius) / (2.002 * radius / 2**level)).astype(np.int64)


def disc_ranges(lat: np.ndarray, lon: np.ndarray, metres: float, radius: float = EARTH_M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cover of each position's disc: row numbers and ranges ``lo, hi`` of the codes of SPHERE_BITS bits an axis.

    The disc's bounding cube meets at most 8 cells of a cube around the sphere, each at least two reaches wide; cells that follow each other on the curve make one range.
    """
    level = sphere_level(2 * metres, radius)
    xyz = sphere_xyz_array(lat, lon, radius)
    a, b = _cells(xyz, level, radius, -metres), _cells(xyz, level, radius, metres)
    corners = []
    for corner in range(8):
        step = np.array([corner & 1, corner >> 1 & 1, corner >> 2])[:, None]
        codes = morton_array(a + step, SPHERE_BITS)
        corners.append(np.where((a + step <= b).all(0), codes, np.iinfo(np.int64).max))
    cells = np.sort(np.stack(corners, 1), 1)
    real = cells != np.iinfo(np.int64).max
    fresh = np.ones_like(real)
    fresh[:, 1:] = cells[:, 1:] != cells[:, :-1] + 1
    fresh &= real
    row = np.nonzero(fresh)[0]
    first = cells[fresh]
    n = np.bincount(np.cumsum(fresh.ravel())[real.ravel()] - 1, minlength=len(first))
    up = 3 * (SPHERE_BITS - level)
    return row, first << up, (first + n << up) - 1


def points_near(points: DataFrame, key: str, lat: str, lon: str, metres: float, radius: float = EARTH_M) -> DataFrame:
    """All pairs ``key_a < key_b`` of usable points at most ``metres`` apart, with their distance ``metres``.

    1. Codes: each point gets the Z-order code of its cell of a fine cube around the sphere (no seam at poles or antimeridian). The coded points are written down.
    2. Blocks: quantiles of the codes cut the curve into stretches of about BLOCK_ROWS points. A position with more
       points than a block has several blocks, among which its points take turns.
    3. Covers: each disc becomes ranges of codes, from its own code on (a pair is found from its lower code), and goes to the blocks these meet.
    4. Range join: points and ranges of a block, sorted by code, meet by binary search; the great-circle distance refines exactly.

    Unusable positions (null, NaN, out of range, 0/0) and null keys pair with nothing; points at the same
    position pair; a key that repeats is compared as separate rows and the pair of equal keys left out. An empty table gives an empty one.
    """
    pts = points.select(F.col(key).alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    pts = pts.where(F.col("key").isNotNull() & usable(F.col("lat"), F.col("lon")))
    kind = dict(pts.dtypes)["key"]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xyz = sphere_xyz_array(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), radius)
            yield pdf.assign(code=morton_array(_cells(xyz, SPHERE_BITS, radius), SPHERE_BITS))

    coded = Staged(pts.mapInPandas(code, f"key {kind}, lat double, lon double, code long"))
    cuts = _cuts(coded)
    shared = points.sparkSession.sparkContext.broadcast(cuts)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = shared.value
        for pdf in batches:
            own, la, lo_ = pdf["code"].to_numpy(), pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
            turn = pd.util.hash_array(pdf["key"].to_numpy()).astype(np.uint64) >> np.uint64(1)
            yield pd.DataFrame({"block": _home_block(cuts, own, turn.astype(np.int64)), "kind": np.zeros(len(own), np.int8), "lo": own, "hi": own, "key": pdf["key"], "lat": la, "lon": lo_})
            row, lo, hi = disc_ranges(la, lo_, metres, radius)
            ahead = hi >= own[row]
            row, lo, hi = row[ahead], np.maximum(lo, own[row])[ahead], hi[ahead]
            each, block = _range_blocks(cuts, lo, hi)
            row = row[each]
            yield pd.DataFrame({"block": block, "kind": np.ones(len(row), np.int8), "lo": lo[each], "hi": hi[each], "key": pdf["key"].to_numpy()[row], "lat": la[row], "lon": lo_[row]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for homes, ranges in _each_block(batches):
            codes, home, disc = homes["lo"].to_numpy(), homes["key"].to_numpy(), ranges["key"].to_numpy()
            at, of = (df[["lat", "lon"]].to_numpy() for df in (homes, ranges))
            own = morton_array(_cells(sphere_xyz_array(*of.T, radius), SPHERE_BITS, radius), SPHERE_BITS)
            for r, p in _matches(codes, ranges["lo"].to_numpy(), ranges["hi"].to_numpy()):
                # Of two points with the same code each finds the other: the lower key counts.
                ok = np.where(own[r] == codes[p], disc[r] < home[p], disc[r] != home[p])
                r, p = r[ok], p[ok]
                far = great_circle_array(*of[r].T, *at[p].T, radius)
                near = far <= metres
                a, b = disc[r[near]], home[p[near]]
                yield pd.DataFrame({"key_a": np.where(a < b, a, b), "key_b": np.where(a < b, b, a), "metres": far[near]})

    rows = coded.df.mapInPandas(send, f"block int, kind byte, lo long, hi long, key {kind}, lat double, lon double")
    return _sorted_by_block(rows).mapInPandas(join, f"key_a {kind}, key_b {kind}, metres double")


# --- Regions that contain points -------------------------------------------------------------------------------------


def _rings(geojson: str) -> list:
    shape = json.loads(geojson)
    if shape.get("type") == "Feature":
        shape = shape.get("geometry") or {}
    return {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}.get(shape.get("type"), lambda c: [])(shape.get("coordinates"))


def polygon_edges(polygon: list) -> np.ndarray:
    """Rows x1, y1, x2, y2 of all rings' edges; open rings are closed."""
    out = []
    for ring in polygon:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        out += [(*map(float, a[:2]), *map(float, b[:2])) for a, b in zip(closed, closed[1:], strict=False)]
    return np.array(out, float).reshape(-1, 4)


def even_odd(edges: np.ndarray, x: float, y: float) -> bool:
    """Whether a position is inside by the even-odd rule."""
    x1, y1, x2, y2 = edges.T
    hit = (y1 > y) != (y2 > y)
    x1, y1, x2, y2 = x1[hit], y1[hit], x2[hit], y2[hit]
    return bool((x < (x2 - x1) * (y - y1) / (y2 - y1) + x1).sum() % 2)


def _meets(edges: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Which edges meet the box (by clipping their parameter)."""
    lo, hi = np.zeros(len(edges)), np.ones(len(edges))
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, d, least, most in ((edges[:, 0], edges[:, 2] - edges[:, 0], x0, x1), (edges[:, 1], edges[:, 3] - edges[:, 1], y0, y1)):
            t, u = (least - a) / d, (most - a) / d
            flat, within = d == 0, (a >= least) & (a <= most)
            lo = np.where(flat, np.where(within, lo, 2.0), np.maximum(lo, np.minimum(t, u)))
            hi = np.where(flat, hi, np.minimum(hi, np.maximum(t, u)))
    return lo <= hi


def polygon_cover(edges: np.ndarray, bits: int, cells: int) -> list[tuple]:
    """Ranges ``lo, hi, whole, x, y, inside, edges`` of lon/lat Z-order codes of ``bits`` bits an axis that cover a polygon.

    Cells that the boundary crosses are split, the largest first, until ``cells`` are reached. Cells wholly inside are ``whole`` and need no exact
    test; those that follow each other are merged. A boundary cell keeps the edges that meet it, and a place in it that is known to be inside or not:
    a position in the cell is inside if the way from there crosses an even (or odd) number of these edges.
    """
    done, todo = [], [(0, 0, 0, edges)]
    while todo:
        level, i, j, cut = todo.pop(0)
        w, h = 360 / 2**level, 180 / 2**level
        x0, y0 = -180 + i * w, -90 + j * h
        cut = cut[_meets(cut, x0, y0, x0 + w, y0 + h)]
        x, y = x0 + 0.41421356 * w, y0 + 0.57721566 * h
        if not len(cut):
            if even_odd(edges, x, y):
                done.append((level, i, j, True, x, y, True, cut))
        elif level == bits or len(done) + len(todo) >= cells:
            done.append((level, i, j, False, x, y, even_odd(edges, x, y), cut))
        else:
            todo += [(level + 1, 2 * i + a, 2 * j + b, cut) for a in (0, 1) for b in (0, 1)]
    ranges: list[list] = []
    for level, i, j, *rest in sorted(done, key=lambda c: morton_int((c[1], c[2]), c[0]) << 2 * (bits - c[0])):
        lo = morton_int((i, j), level) << 2 * (bits - level)
        hi = lo + (1 << 2 * (bits - level)) - 1
        if ranges and rest[0] and ranges[-1][2] and ranges[-1][1] + 1 == lo:
            ranges[-1][1] = hi
        else:
            ranges.append([lo, hi, *rest])
    return [tuple(r) for r in ranges]


def region_ranges(regions: DataFrame, key: str, geojson: str, cells: int = 256) -> DataFrame:
    """``key_b, lo, hi, whole, x, y, inside, edges`` (flat): the cover ranges of each polygon.

    Polygons of a region are covered apart, regions in as many tasks as a shuffle has, since a cover takes longer than reading its text. Null, empty or unreadable GeoJSON and other geometry types give no range.
    """

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf["key_b"], pdf["geojson"], strict=True):
                try:
                    polygons = _rings(text) if text else []
                    every = [polygon_edges([r for r in p if r]) for p in polygons or []]
                except (ValueError, TypeError, IndexError, AttributeError):
                    continue
                for edges in every:
                    rows += [(k, *r[:6], r[6].ravel()) for r in polygon_cover(edges, CURVE_BITS, cells)] if len(edges) else []
            yield pd.DataFrame(rows, columns=["key_b", "lo", "hi", "whole", "x", "y", "inside", "edges"])

    named = regions.select(F.col(key).cast("long").alias("key_b"), F.col(geojson).alias("geojson")).where("key_b is not null")
    tasks = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named.repartition(tasks, "key_b").mapInPandas(cover, "key_b long, lo long, hi long, whole boolean, x double, y double, inside boolean, edges array<double>")


class _Ranges:
    """Cover ranges as arrays, and the exact test."""

    def __init__(self, df: pd.DataFrame):
        self.key, self.lo, self.hi = (df[c].to_numpy(np.int64) for c in ("key_b", "lo", "hi"))
        self.whole, self.inside = df["whole"].to_numpy(bool), df["inside"].to_numpy(bool)
        self.x, self.y = df["x"].to_numpy(float), df["y"].to_numpy(float)
        each = [np.asarray(e, float).reshape(-1, 4) for e in df["edges"]]
        self.many = np.array([len(e) for e in each], np.int64)
        self.start = np.cumsum(self.many) - self.many
        self.edges = np.concatenate(each) if each else np.zeros((0, 4))

    def holds(self, r: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether positions in the cells of ranges ``r`` are inside."""
        out = self.inside[r] | self.whole[r]
        test = np.flatnonzero(~self.whole[r])
        n = self.many[r[test]]
        pair = np.repeat(test, n)
        e = self.edges[np.repeat(self.start[r[test]], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
        (ax, ay, bx, by), px, py, qx, qy = e.T, self.x[r[pair]], self.y[r[pair]], x[pair], y[pair]
        turn = lambda ux, uy, vx, vy: ux * vy - uy * vx > 0
        apart = turn(qx - px, qy - py, ax - px, ay - py) != turn(qx - px, qy - py, bx - px, by - py)
        apart &= turn(bx - ax, by - ay, px - ax, py - ay) != turn(bx - ax, by - ay, qx - ax, qy - ay)
        return out ^ (np.bincount(pair[apart], minlength=len(r)) % 2 == 1)


def lonlat_code(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    top = 2**CURVE_BITS
    clamp = lambda c: np.minimum(top - 1, np.floor(c * top).astype(np.int64))
    return morton_array([clamp((lon + 180) / 360), clamp((lat + 90) / 180)], CURVE_BITS)


def _contained(ranges: _Ranges, codes: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Distinct (point number, region key) rows of points, given sorted by code."""
    out = [np.zeros((0, 2), np.int64)]
    for r, p in _matches(codes, ranges.lo, ranges.hi):
        ok = ranges.holds(r, lon[p], lat[p])
        out.append(np.stack([p[ok], ranges.key[r[ok]]], 1))
    return np.unique(np.concatenate(out), axis=0)


def points_inside(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region_key: str, geojson: str, broadcast_rows: int = 500_000) -> DataFrame:
    """Pairs ``key_a`` (point), ``key_b`` (region) of usable points and the regions that contain them; a pair comes out once a row of ``points``.

    Points get a Z-order code, regions are covered with code ranges, and the ranges meet the sorted codes by binary search. Codes in a boundary cell are refined by the even-odd
    rule over the edges that meet the cell (straight in lon/lat; holes are rings of the polygon). The ranges are written down and counted: up to ``broadcast_rows``
    rows and BROADCAST_BYTES they travel to the executors and the points don't move; beyond that points and ranges meet in blocks of the curve (as in ``points_near``).
    Unusable positions and null keys are in no region; empty tables give an empty one.
    """
    ranges = Staged(region_ranges(regions, region_key, geojson))
    pts = points.select(F.col(key).alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    pts = pts.where(F.col("key").isNotNull() & usable(F.col("lat"), F.col("lon")))
    kind = dict(pts.dtypes)["key"]
    spark = points.sparkSession
    if ranges.rows <= broadcast_rows and ranges.bytes <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast(_Ranges(ranges.df.toPandas()))

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                la, lo = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
                codes = lonlat_code(la, lo)
                order = np.argsort(codes, kind="stable")
                got = _contained(shared.value, codes[order], la[order], lo[order])
                yield pd.DataFrame({"key_a": pdf["key"].to_numpy()[order][got[:, 0]], "key_b": got[:, 1]})

        return pts.mapInPandas(look_up, f"key_a {kind}, key_b long")

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(code=lonlat_code(pdf["lat"].to_numpy(), pdf["lon"].to_numpy()))

    coded = Staged(pts.withColumn("nth", F.monotonically_increasing_id()).mapInPandas(code, f"key {kind}, lat double, lon double, nth long, code long"))
    cuts = spark.sparkContext.broadcast(_cuts(coded))
    columns = f"block int, kind byte, lo long, hi long, key {kind}, nth long, lat double, lon double, key_b long, whole boolean, x double, y double, inside boolean, edges array<double>"
    names, blank = [c.split()[0] for c in columns.split(", ")], 0 if kind in ("tinyint", "smallint", "int", "bigint") else None

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = pdf["code"].to_numpy()
            # No nulls: whole numbers would become floats.
            rest = {"key_b": 0, "whole": False, "x": 0.0, "y": 0.0, "inside": False, "edges": [[]] * len(c)}
            yield pd.DataFrame({"block": _home_block(cuts.value, c, pdf["nth"].to_numpy()), "kind": 0, "lo": c, "hi": c, "key": pdf["key"], "nth": pdf["nth"], "lat": pdf["lat"], "lon": pdf["lon"], **rest})[names]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, block = _range_blocks(cuts.value, pdf["lo"].to_numpy(), pdf["hi"].to_numpy())
            yield pdf.iloc[row].assign(block=block, kind=1, key=blank, nth=0, lat=0.0, lon=0.0)[names]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for mine, some in _each_block(batches):
            got = _contained(_Ranges(some), mine["lo"].to_numpy(), mine["lat"].to_numpy(), mine["lon"].to_numpy())
            yield pd.DataFrame({"key_a": mine["key"].to_numpy()[got[:, 0]], "nth": mine["nth"].to_numpy()[got[:, 0]], "key_b": got[:, 1]})

    rows = coded.df.mapInPandas(homes, columns).unionByName(ranges.df.mapInPandas(send, columns))
    met = _sorted_by_block(rows).mapInPandas(join, f"key_a {kind}, nth long, key_b long")
    # A region's parts can meet a point in two portions of its ranges.
    return met.distinct().select("key_a", "key_b")
