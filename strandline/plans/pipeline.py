"""The SAR bathymetry chain: tiling, spectra, discrimination, inversion, table. One lazy plan, with one shuffle for boxes and one for means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bathymetry, roi, spectrum


def tiles(raster: DataFrame, points: DataFrame, size: int, boxes: int = 9, shift: float = 0.5) -> DataFrame:
    """FFT boxes of points (point_id, row, col)."""
    return spectrum.boxes(roi.fft_boxes(raster, roi.centres(points, int(-(-shift * size // 2)), boxes), size // 2))


def run(raster: DataFrame, points: DataFrame, size: int = 16, boxes: int = 9, shift: float = 0.5, period: float = 16.6, method: str = "Radial", resolution: float = 10.0, coast: float = 270.0) -> DataFrame:
    """Points (point_id, row, col, easting, northing, apriori_bathymetry) with direction, wavelength, flag, group, tp and bathymetry."""
    spectra = spectrum.mean_spectrum(spectrum.compute(tiles(raster, points, size, boxes, shift), method, resolution, coast))
    waves = spectra.select("point_id", "direction", spectrum.wavelength(F.col("k"), F.col("s")).alias("wavelength"))
    known = points.join(waves, "point_id").withColumn("tp", F.lit(float(period)))
    return bathymetry.direct_inversion(bathymetry.discriminate(known))
