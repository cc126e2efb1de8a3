"""Where a raster lies: size, resolution, coordinate axes, reference system, orientation. One row a raster, or one a row and column of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import GeoTransform


def meta(raster: DataFrame, gt: GeoTransform, srs: str = "") -> DataFrame:
    """(raster_id, rows, cols, bands, x0, dx, y0, dy, srs) of each raster: its size from its cells, its place from the transform."""
    size = raster.groupBy("raster_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.max("band").alias("bands"))
    return size.select("*", *[F.lit(float(v)).alias(n) for n, v in (("x0", gt.x0), ("dx", gt.dx), ("y0", gt.y0), ("dy", gt.dy))], F.lit(srs).alias("srs"))


def resolution(rasters: DataFrame) -> DataFrame:
    """(raster_id, yres, xres): sizes of a cell without sign, to two decimals."""
    return rasters.select("raster_id", F.round(F.abs("dy"), 2).alias("yres"), F.round(F.abs("dx"), 2).alias("xres"))


def corners(rasters: DataFrame) -> DataFrame:
    """(raster_id, west, east, north, south): the outer edges."""
    return rasters.select("raster_id", F.col("x0").alias("west"), (F.col("x0") + F.col("cols") * F.col("dx")).alias("east"), F.col("y0").alias("north"), (F.col("y0") + F.col("rows") * F.col("dy")).alias("south"))


def axes(rasters: DataFrame) -> DataFrame:
    """(raster_id, axis, i, value): n even steps from edge to edge of the raster's extent, eastings ascending by column, northings descending by row. Of a single cell the lower edge."""

    def axis(name: str, first: str, step: str, n: str, down: bool) -> DataFrame:
        end = F.col(first) + F.col(step) * F.col(n)
        low, high = F.least(F.col(first), end), F.greatest(F.col(first), end)
        i = F.when(F.lit(down), F.col(n) - 1 - F.col("i")).otherwise(F.col("i"))
        value = low + i * F.coalesce(F.try_divide(high - low, F.col(n) - 1), F.lit(0.0))
        return rasters.withColumn("i", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).select("raster_id", F.lit(name).alias("axis"), "i", value.alias("value"))

    return axis("easting", "x0", "dx", "cols", False).unionAll(axis("northing", "y0", "dy", "rows", True))


def projection(rasters: DataFrame) -> DataFrame:
    """The axes with the raster's resolution beside each value."""
    return axes(rasters).join(resolution(rasters), "raster_id")


def epsg(text: Column) -> Column:
    """Code of a reference system as text: the first number in the last line that names EPSG, but not at its start."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.instr(line, "EPSG") > 1)
    return F.regexp_extract(F.try_element_at(lines, F.lit(-1)), r"(\d+)", 1).try_cast("int")


def flipped(axes_: DataFrame) -> DataFrame:
    """(raster_id, flipped): whether just one of both axes descends, which mirrors directions."""
    ends = axes_.groupBy("raster_id", "axis").agg((F.min_by("value", "i") > F.max_by("value", "i")).alias("descends"))
    return ends.groupBy("raster_id").agg((F.count_if("descends") == 1).alias("flipped"))


def centre(rasters: DataFrame) -> DataFrame:
    """(raster_id, x, y) in cells; both from the raster's width, as spectra of square boxes expect."""
    half = (F.col("cols") - 1) / 2
    return rasters.select("raster_id", half.alias("x"), half.alias("y"))


def in_pixels(metres: Column, cell: Column) -> tuple[Column, Column]:
    """(whole pixels, and these in metres again) of a distance; ties go to the even number."""
    pixels = F.rint(metres / cell).cast("int")
    return pixels, pixels * cell


def refitted(rasters: DataFrame, axes_: DataFrame) -> DataFrame:
    """(raster_id, x0, dx, y0, dy): the transform that spreads a raster's rows and columns over the extremes of its coordinates."""
    span = axes_.groupBy("raster_id").agg(*[f(F.when(F.col("axis") == a, F.col("value"))).alias(n) for n, f, a in (("west", F.min, "easting"), ("east", F.max, "easting"), ("south", F.min, "northing"), ("north", F.max, "northing"))])
    return rasters.select("raster_id", "rows", "cols").join(span, "raster_id").select("raster_id", F.col("west").alias("x0"), ((F.col("east") - F.col("west")) / F.col("cols")).alias("dx"), F.col("north").alias("y0"), (-(F.col("north") - F.col("south")) / F.col("rows")).alias("dy"))
