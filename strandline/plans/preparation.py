"""Preparing SAR images: one band, contrast, slant range, grid, land mask. Each step is a plan of its own; nothing is cached in files by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import mapalgebra, neighborhood


def byte_raster(raster: DataFrame) -> DataFrame:
    """One byte a cell, 0 is nodata."""
    return mapalgebra.set_nodata(mapalgebra.set_type(raster, "Byte"), 0.0)


def single_band_bytes(raster: DataFrame, band: int = 0) -> DataFrame:
    """One band of the raster (from 4 on the mean of bands), scaled to bytes."""
    return byte_raster(mapalgebra.scale_image(mapalgebra.uniband(raster, band), 8))


def to_single_band(raster: DataFrame, bands: int, band: int = 0) -> DataFrame:
    """Rasters of several bands as one of bytes; rasters of one band stay as they are."""
    return single_band_bytes(raster, band) if bands > 1 else raster


def stretched(raster: DataFrame, rows: int, cols: int, band: int = 1, **options) -> DataFrame:
    """Adaptive equalisation of one band, scaled to bytes."""
    return mapalgebra.scale_image(neighborhood.clahe(mapalgebra.split_band(raster, band), rows, cols, **options), 8)


def slant_bytes(raster: DataFrame, rows: int, cols: int, **options) -> DataFrame:
    """Adaptive equalisation, then slant-range correction, scaled to bytes."""
    return byte_raster(mapalgebra.scale_image(mapalgebra.slant_correct(neighborhood.clahe(raster, rows, cols, **options)), 8))


@dataclass(frozen=True)
class Sar:
    """Steps of ``scan_sar`` that are wanted. ``kind`` is that of the file; only some kinds are in slant range."""

    kind: str = "GeoTIFF"
    slant: bool = False
    scale: int = 1
    contrast: bool = False
    x: Column | None = None
    y: Column | None = None
    dx: float = 1.0
    dy: float = 1.0


def scan_sar(raster: DataFrame, rows: int, cols: int, steps: Sar, land: DataFrame | None = None) -> DataFrame:
    """Slant-range correction, blocks of ``scale`` cells, reprojection to the target coordinates (x, y) with cells dx * dy, contrast, land mask; 0 is nodata on the way."""
    out = raster
    if steps.slant and steps.kind in ("ENVISAT", "ERS1/2", "GeoTIFF"):
        out = mapalgebra.fill_nodata(slant_bytes(out, rows, cols), 0.0)
    if steps.scale > 1:
        out = mapalgebra.fill_nodata(mapalgebra.rescale(mapalgebra.set_nodata(out, 0.0), steps.scale), 0.0)
        rows, cols = -(-rows // steps.scale), -(-cols // steps.scale)
    if steps.x is not None and steps.y is not None:
        out = mapalgebra.reproject_average(out, steps.x, steps.y, steps.dx, steps.dy)
    if steps.contrast:
        out = stretched(out, rows, cols)
    return mapalgebra.apply_land_mask(out, land) if land is not None else out.select("raster_id", "band", "row", "col", F.col("value").cast("double").alias("value"))
