"""Space-filling (Z-order) curve codes as Column expressions, and the earth as a sphere."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius in metres.
EARTH_M = 6_371_008.8


def _spread(x: Column, steps) -> Column:
    x = x.cast("long")
    for shift, mask in steps:
        x = (x if not shift else x.bitwiseOR(F.shiftleft(x, shift))).bitwiseAND(F.lit(mask))
    return x


def _masks(bits: int, dims: int):
    """Shifts and masks that put dims - 1 zero bits between the low ``bits`` bits of a number."""
    out, block = [(0, (1 << bits) - 1)], 1 << (bits - 1).bit_length()
    while block > 1:
        block //= 2
        mask = 0
        for i in range(bits):
            mask |= 1 << (i % block + i // block * block * dims)
        out.append((block * (dims - 1), mask))
    return out


def morton(*cells: Column, bits: int) -> Column:
    """The Z-order code of non-negative cell numbers below 2**bits; bits * dims must stay below 64."""
    masks = _masks(bits, len(cells))
    code = None
    for i, c in enumerate(cells):
        part = F.shiftleft(_spread(c, masks), i)
        code = part if code is None else code.bitwiseOR(part)
    return code


def morton_int(cells, bits: int) -> int:
    """The same code in Python."""
    return sum(((c >> b) & 1) << (b * len(cells) + i) for i, c in enumerate(cells) for b in range(bits))


def usable(lat: Column, lon: Column) -> Column:
    """Whether a position is neither null, NaN, out of range nor exactly 0/0."""
    ok = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def sphere_xyz(lat: Column, lon: Column, radius: float = EARTH_M) -> tuple[Column, Column, Column]:
    """Geocentric coordinates: no seam at the antimeridian, no crowding at the poles."""
    p, l = F.radians(lat), F.radians(lon)
    return radius * F.cos(p) * F.cos(l), radius * F.cos(p) * F.sin(l), radius * F.sin(p)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Haversine distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def sphere_level(reach: float, radius: float = EARTH_M) -> int:
    """The finest level (2**level cells along each axis of the cube around the sphere) whose cells are at least ``reach`` wide."""
    return max(0, min(20, math.floor(math.log2(2.002 * radius / reach))))


def morton_array(cells, bits: int) -> np.ndarray:
    """The Z-order codes of integer arrays, one array an axis."""
    masks, code = _masks(bits, len(cells)), None
    for i, c in enumerate(cells):
        x = np.asarray(c, np.int64)
        for shift, mask in masks:
            x = (x | x << shift if shift else x) & mask
        code = x << i if code is None else code | x << i
    return code


def sphere_xyz_array(lat: np.ndarray, lon: np.ndarray, radius: float = EARTH_M) -> np.ndarray:
    """Geocentric coordinates of arrays of positions, one row an axis."""
    p, l = np.radians(lat), np.radians(lon)
    return radius * np.stack([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)])


def great_circle_array(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> np.ndarray:
    """Haversine distances of arrays of positions."""
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(a)))
