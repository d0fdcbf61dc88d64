"""Spectral and radar indices as formulas for the index dialect, reflectance scaling and quality masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.expressions import IndexDialect, finite

#: Published index formulas.
INDICES = {
    "NDVI": "(B08 - B04) / (B08 + B04)",
    "SAVI": "1.5 * (B08 - B04) / (B08 + B04 + 0.5)",
    "MSAVI": "(2 * B08 + 1 - sqrt((2 * B08 + 1) ** 2 - 8 * (B08 - B04))) / 2",
    "OSAVI": "(B08 - B04) / (B08 + B04 + 0.16)",
    "EVI": "2.5 * (B08 - B04) / (B08 + 6 * B04 - 7.5 * B02 + 1)",
    "EVI2": "2.5 * (B08 - B04) / (B08 + 2.4 * B04 + 1)",
    "GNDVI": "(B08 - B03) / (B08 + B03)",
    "NDRE": "(B08 - B05) / (B08 + B05)",
    "CIre": "B08 / B05 - 1",
    "ARVI": "(B08 - (2 * B04 - B02)) / (B08 + (2 * B04 - B02))",
    "NDCI": "(B05 - B04) / (B05 + B04)",
    "VARI": "(B03 - B04) / (B03 + B04 - B02)",
    "GLI": "(2 * B03 - B04 - B02) / (2 * B03 + B04 + B02)",
    "ExG": "2 * B03 - B04 - B02",
    "NDWI": "(B03 - B08) / (B03 + B08)",
    "MNDWI": "(B03 - B11) / (B03 + B11)",
    "AWEI": "4 * (B03 - B11) - (0.25 * B08 + 2.75 * B12)",
    "NDMI": "(B08 - B11) / (B08 + B11)",
    "NDBI": "(B11 - B08) / (B11 + B08)",
    "UI": "(B12 - B08) / (B12 + B08)",
    "BSI": "((B11 + B04) - (B08 + B02)) / ((B11 + B04) + (B08 + B02))",
    "NDTI": "(B11 - B12) / (B11 + B12)",
    "NBR": "(B08 - B12) / (B08 + B12)",
    "NBR2": "(B11 - B12) / (B11 + B12)",
    "NDSI": "(B03 - B11) / (B03 + B11)",
    "RVI": "4 * 10 ** (VH / 10) / (10 ** (VV / 10) + 10 ** (VH / 10))",
    "CPR": "VH - VV",
    "NDPI": "(10 ** (VV / 10) - 10 ** (VH / 10)) / (10 ** (VV / 10) + 10 ** (VH / 10))",
    "VVdB": "VV",
    "VHdB": "VH",
}


def index_column(formula: str, bands: Mapping[str, Column]) -> Column:
    """An index by name, or any formula over the bands; null where a band is missing or the result isn't finite."""
    return IndexDialect(bands).compile(INDICES.get(formula, formula)).col


def available_indices(bands: Sequence[str]) -> list[str]:
    """The indices whose bands are all there."""
    dialect = IndexDialect({b: F.lit(0.0) for b in bands})
    out = []
    for name, formula in INDICES.items():
        try:
            dialect.compile(formula)
            out.append(name)
        except ValueError:
            continue
    return out


def with_indices(df: DataFrame, bands: Mapping[str, str], names: Sequence[str] | None = None) -> DataFrame:
    """Adds index columns; ``bands`` maps band names to columns. One projection, no shuffle."""
    cols = {b: F.col(c) for b, c in bands.items()}
    return df.select("*", *(index_column(n, cols).alias(n) for n in (names or available_indices(list(bands)))))


def index_stack(df: DataFrame, keys: Sequence[str], bands: Mapping[str, str], items: Mapping[str, str]) -> DataFrame:
    """``keys`` and one column an item, each a formula or the name of an index: what an export writes as one table."""
    cols = {b: F.col(c) for b, c in bands.items()}
    return df.select(*keys, *(index_column(f, cols).alias(n) for n, f in items.items()))


#: Scale and offset of common integer encodings.
REFLECTANCE = {"s2": (1e-4, 0.0), "s2_offset": (1e-4, -0.1), "landsat": (2.75e-5, -0.2), "byte": (1 / 255, 0.0)}


def reflectance(df: DataFrame, bands: Sequence[str], preset: str = "s2", nodata_zero: bool = True) -> DataFrame:
    """Bands scaled to reflectance, at least 0; a pixel that is 0 in all bands becomes null."""
    scale, offset = REFLECTANCE[preset]
    empty = reduce(lambda p, q: p & q, (F.coalesce(F.col(b) == 0, F.lit(False)) for b in bands)) if nodata_zero else F.lit(False)
    known = {b: finite(F.col(b).cast("double")) for b in bands}
    return df.withColumns({b: F.when(~empty & c.isNotNull(), F.greatest(c * scale + offset, F.lit(0.0))) for b, c in known.items()})


def bit_set(quality: Column, bit: int) -> Column:
    """Whether a bit of a quality word is set."""
    return F.shiftright(quality, bit).bitwiseAND(F.lit(1)) == 1


def landsat_clear(quality: Column) -> Column:
    """Neither fill (bit 0) nor dilated cloud, cirrus or cloud (1-3) nor shadow (4)."""
    return ~reduce(lambda p, q: p | q, (bit_set(quality, b) for b in range(5)))


def scene_class_clear(scl: Column) -> Column:
    """Neither no data (0, 1), shadow (3) nor cloud (8, 9, 10)."""
    return ~scl.isin(0, 1, 3, 8, 9, 10)
