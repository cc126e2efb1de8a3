"""Regions of interest and computation grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import in_polygon


def subsample(axis: DataFrame, step: int, n: int) -> DataFrame:
    """Every ``step``-th index i of 0..n-1, moved so that what is left over is shared by both ends."""
    last = (n - 1) // step * step
    return axis.where(F.col("i") % step == (n - 1 - last) // 2)


def global_grid(raster: DataFrame, step: int, rows: int, cols: int) -> DataFrame:
    """(row, col) grid points, northing-major: every ``step``-th of both axes. Two one-dimensional axes are crossed, no data rows."""
    spark = raster.sparkSession
    y = subsample(spark.range(rows).select(F.col("id").cast("int").alias("i")), step, rows).select(F.col("i").alias("row"))
    x = subsample(spark.range(cols).select(F.col("id").cast("int").alias("i")), step, cols).select(F.col("i").alias("col"))
    return y.crossJoin(F.broadcast(x))  # an axis of the raster


def rectangle(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    west, east, south, north = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    return [(west, south), (east, south), (east, north), (west, north)]


def polygon(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Three or more corners as they are; two are those of a rectangle; fewer raise ValueError."""
    if len(points) < 2:
        raise ValueError("a region needs two corners at least")
    return points if len(points) > 2 else rectangle(*points[0], *points[1])


def within(points: DataFrame, corners: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Points inside the polygon or on its edge; its box goes to the scan as a range."""
    xs, ys = zip(*corners, strict=True)
    return points.where(F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))).where(in_polygon(F.col(x), F.col(y), corners))


def nearest_index(value: Column, first: float, step: float, n: int) -> Column:
    """Index of the nearest of n evenly spaced values, the lower of two as near, clamped to the ends."""
    at = (value - F.lit(first)) / F.lit(step)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil(at - 0.5).cast("int")))


def nearest_of(value: Column, values: list[float]) -> Column:
    return F.array_min(F.transform(F.array(*[F.lit(float(v)) for v in values]), lambda v: F.struct(F.abs(v - value).alias("d"), v.alias("v"))))["v"]


def drop_land(points: DataFrame, raster: DataFrame) -> DataFrame:
    """Points (row, col) whose pixel is above 0."""
    return points.join(raster.where(F.col("value") > 0).select("row", "col"), ["row", "col"], "left_semi")


def window_around(bathymetry: DataFrame, points: DataFrame, margin: float) -> DataFrame:
    """Cells of the bathymetry in the points' box with a margin. The box is one row."""
    box = points.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    inside = F.col("x").between(F.col("a") - margin, F.col("b") + margin) & F.col("y").between(F.col("c") - margin, F.col("d") + margin)
    return bathymetry.join(F.broadcast(box), inside).drop("a", "b", "c", "d")


def box_dimension(metres: float, resolution: float, power_of_two: bool = True) -> int:
    """Side of an FFT box in pixels: the nearest power of two, or the next product of 2, 3 and 5."""
    from math import log2

    n = round(metres / resolution)
    if power_of_two:
        return 2 ** round(log2(n))
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def centres(points: DataFrame, shift: int, boxes: int) -> DataFrame:
    """(point_id, box_id, row, col): 5 or 9 box centres around each point; other numbers raise ValueError."""
    if boxes not in (5, 9):
        raise ValueError("5 or 9 boxes")
    places = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if boxes == 9 or abs(r) == abs(c)]
    offsets = F.array(*[F.struct(F.lit(i).alias("box_id"), F.lit(r * shift).alias("dr"), F.lit(c * shift).alias("dc")) for i, (r, c) in enumerate(places)])
    return points.withColumn("o", F.explode(offsets)).select("point_id", "o.box_id", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))


def fft_boxes(raster: DataFrame, box_centres: DataFrame, half: int) -> DataFrame:
    """(point_id, box_id, r, c, value): the pixels [centre - half, centre + half) of each box. Pixels and boxes meet by tiles of the box size, of which a box touches at most four, then by the exact range."""
    t = 2 * half
    tile = lambda c: F.floor(F.col(c) / t).cast("int")
    touched = F.sequence(F.floor((F.col("row") - half) / t).cast("int"), F.floor((F.col("row") + half - 1) / t).cast("int")), F.sequence(F.floor((F.col("col") - half) / t).cast("int"), F.floor((F.col("col") + half - 1) / t).cast("int"))
    wanted = box_centres.withColumn("tr", F.explode(touched[0])).withColumn("tc", F.explode(touched[1])).withColumnsRenamed({"row": "r0", "col": "c0"})
    joined = raster.select("row", "col", "value", tile("row").alias("tr"), tile("col").alias("tc")).join(wanted, ["tr", "tc"])
    r, c = F.col("row") - F.col("r0") + half, F.col("col") - F.col("c0") + half
    return joined.where(r.between(0, t - 1) & c.between(0, t - 1)).select("point_id", "box_id", r.alias("r"), c.alias("c"), "value")


def index_grid(raster: DataFrame, step: int, rows: int, cols: int, eastings: Column, northings: Column) -> DataFrame:
    """The global grid with the easting and northing of each point, given as expressions of col and row."""
    return global_grid(raster, step, rows, cols).select("row", "col", eastings.alias("easting"), northings.alias("northing"))


def computation_grid(raster: DataFrame, metres: float, resolution: float, rows: int, cols: int, eastings: Column, northings: Column, corners: list[tuple[float, float]]) -> DataFrame:
    """Grid points ``metres`` apart, in whole cells, that lie in a region of three corners or more, or in the rectangle of two."""
    points = index_grid(raster, max(1, round(metres / resolution)), rows, cols, eastings, northings)
    return within(points, polygon(corners), "easting", "northing")


def apriori_bathymetry(bathymetry: DataFrame, points: DataFrame, margin: float, x0: float, dx: float, y0: float, dy: float, method: str = "linear") -> DataFrame:
    """(fid, value): depths of a raster of cells (x0, dx, y0, dy), negative down, at points (fid, x, y), from the cells around the points with a margin: linear, cubic, nearest or multiquadric. Heights count as missing."""
    from . import gridding

    known = bathymetry.where(F.col("value") <= 0).select("row", "col", "value", (x0 + (F.col("col") + 0.5) * dx).alias("x"), (y0 + (F.col("row") + 0.5) * dy).alias("y"))
    near = window_around(known, points, margin)
    if method == "linear":
        return gridding.bilinear(points, near, x0, dx, y0, dy)
    if method == "cubic":
        return gridding.bicubic(points, near, x0, dx, y0, dy)
    if method == "nearest":
        cell = points.select("fid", F.floor((F.col("y") - y0) / dy).cast("int").alias("row"), F.floor((F.col("x") - x0) / dx).cast("int").alias("col"))
        return cell.join(near.select("row", "col", "value"), ["row", "col"], "left").select("fid", "value")
    if method == "multiquadric":
        return gridding.rbf(points, near.select("x", "y", F.col("value").alias("z")))
    raise ValueError(f"unknown method {method!r}")
