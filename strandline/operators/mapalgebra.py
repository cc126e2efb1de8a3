"""Map algebra on pixels: masks, crops, bands, scaling, stretching, mosaics. Null is nodata throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import GeoTransform
from ..plans.lineage import few

CELL = ["row", "col"]
#: Output types with their lowest and highest value.
TYPES = {"Byte": ("smallint", 0, 255), "UInt16": ("int", 0, 65535), "Int16": ("smallint", -32768, 32767), "UInt32": ("bigint", 0, 4294967295), "Int32": ("int", -2147483648, 2147483647), "Float32": ("float", None, None), "Float64": ("double", None, None)}


def range_condition(value: Column, ranges: str) -> Column:
    """``min:max,min:,:max``: strict integer bounds, parts or-ed. A part without bounds raises ValueError."""
    parts = []
    for part in ranges.split(","):
        low, colon, high = part.partition(":")
        if not colon or not (low or high):
            raise ValueError(f"not a range: {part!r}")
        bounds = [value > int(low)] if low else []
        bounds += [value < int(high)] if high else []
        parts.append(reduce(lambda a, b: a & b, bounds))
    return reduce(lambda a, b: a | b, parts)


def mask(raster: DataFrame, mask_raster: DataFrame | None = None, ranges: str | None = None, band: int = 1, mask_band: int = 1, all_bands: bool = False, nodata_outside: bool = False) -> DataFrame:
    """Raster times mask, or times the truth of ``ranges`` on the mask: outside is 0, or null with ``nodata_outside``. Without a mask the raster masks itself, which needs no join.

    With ``all_bands`` each band meets the mask's band of the same number if both have as many, else ``mask_band``.
    """
    def combined(value: Column, m: Column) -> Column:
        if ranges is None:
            return value * m
        inside = range_condition(m, ranges)
        return F.when(inside, value) if nodata_outside else value * inside.cast("int")

    chosen = raster if all_bands else raster.where(F.col("band") == band)
    if mask_raster is None:
        return chosen.withColumn("value", combined(F.col("value"), F.col("value")))
    keys = CELL
    if all_bands and (n := band_count(raster)) > 1 and n == band_count(mask_raster):
        keys = [*CELL, "band"]
        other = mask_raster.select(*keys, F.col("value").alias("m"))
    else:
        other = mask_raster.where(F.col("band") == mask_band).select(*CELL, F.col("value").alias("m"))
    return chosen.join(other, keys).select("raster_id", "band", "row", "col", combined(F.col("value"), F.col("m")).alias("value"))


def band_count(raster: DataFrame) -> int:
    return raster.select("band").distinct().count()


def set_type(raster: DataFrame, kind: str) -> DataFrame:
    """Rounds half to even, clamps to the type's range and casts. Unknown types raise ValueError."""
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind!r}")
    spark_type, low, high = TYPES[kind]
    value = F.col("value")
    return raster.withColumn("value", (value if low is None else F.greatest(F.lit(low), F.least(F.lit(high), F.rint(value)))).cast(spark_type))


def set_nodata(raster: DataFrame, nodata: float) -> DataFrame:
    return raster.withColumn("value", F.nullif("value", F.lit(nodata)))


def fill_nodata(raster: DataFrame, nodata: float) -> DataFrame:
    return raster.withColumn("value", F.coalesce("value", F.lit(nodata)))


def split_band(raster: DataFrame, band: int = 1) -> DataFrame:
    return raster.where(F.col("band") == band).withColumn("band", F.lit(1))


def split_all(raster: DataFrame) -> DataFrame:
    """One raster a band, named band_id."""
    return raster.withColumn("raster_id", F.concat_ws("_", F.col("band").cast("string"), "raster_id")).withColumn("band", F.lit(1))


def stack(rasters: list[tuple[DataFrame, int]], name: str = "stack") -> DataFrame:
    """Bands of the rasters one after the other; each raster comes with its number of bands."""
    parts, first = [], 0
    for raster, bands in rasters:
        parts.append(raster.withColumn("band", (F.col("band") + first).cast("int")))
        first += bands
    return reduce(DataFrame.unionByName, parts).withColumn("raster_id", F.lit(name))


def check_limits(west: float, south: float, east: float, north: float) -> None:
    if not (-180 <= west <= east <= 180 and -90 <= south <= north <= 90):
        raise ValueError("limits must be longitudes in -180..180 and latitudes in -90..90 in ascending order")


def crop(raster: DataFrame, gt: GeoTransform, west: float, south: float, east: float, north: float, geographic: bool = True) -> DataFrame:
    """Pixels whose centres lie within the limits, with rows and columns counted from the new corner. The limits become row and column bounds, which reach the scan."""
    if geographic:
        check_limits(west, south, east, north)
    from math import ceil, floor

    c0, c1 = ceil((west - gt.x0) / gt.dx - 0.5), floor((east - gt.x0) / gt.dx - 0.5)
    r = sorted(((north - gt.y0) / gt.dy - 0.5, (south - gt.y0) / gt.dy - 0.5))
    r0, r1 = ceil(r[0]), floor(r[1])
    c0, r0 = max(c0, 0), max(r0, 0)
    return raster.where(F.col("col").between(c0, c1) & F.col("row").between(r0, r1)).withColumns({"row": (F.col("row") - r0).cast("int"), "col": (F.col("col") - c0).cast("int")})


def crop_polygon(raster: DataFrame, gt: GeoTransform, polygon: list[tuple[float, float]]) -> DataFrame:
    """Crop to the polygon's box, then null outside of it."""
    from .vector import in_polygon

    xs, ys = zip(*polygon, strict=True)
    inside = in_polygon(gt.easting(F.col("col")), gt.northing(F.col("row")), polygon)
    boxed = raster.where(gt.easting(F.col("col")).between(min(xs), max(xs)) & gt.northing(F.col("row")).between(min(ys), max(ys)))
    return boxed.withColumn("value", F.when(inside, F.col("value")))


def uniband(raster: DataFrame, band: int) -> DataFrame:
    """Band ``band`` (from 0) below 4; from 4 on the mean of all bands but the last."""
    if band < 4:
        return split_band(raster, band + 1)
    last = raster.agg(F.max("band").alias("last"))
    kept = raster.join(F.broadcast(last), F.col("band") < F.col("last"))  # one row
    return kept.groupBy("raster_id", *CELL).agg(F.avg("value").alias("value")).select("raster_id", F.lit(1).alias("band"), *CELL, "value")


def invert_mask(raster: DataFrame) -> DataFrame:
    return raster.withColumn("value", F.when(F.col("value") > 0, 0.0).otherwise(255.0))


def _with_stats(raster: DataFrame, **aggregates: Column) -> DataFrame:
    """Adds statistics of the whole raster: a small aggregate, whose rows are counted and broadcast if they are few, no window over a raster."""
    stats = raster.groupBy("raster_id", "band").agg(*[c.alias(n) for n, c in aggregates.items()])
    return raster.join(few(stats, "raster-stats"), ["raster_id", "band"])


def scale_image(raster: DataFrame, bits: int) -> DataFrame:
    """value * N / max, truncated: N is 255, 65536 (whose top wraps to 0) or 1 for 8, 16 or 32 bits; 0 bits leave the raster as it is; an all-zero raster gives null."""
    if bits == 0:
        return raster
    n = {8: 255.0, 16: 65536.0, 32: 1.0}[bits]
    scaled = F.try_divide(F.col("value") * n, F.nullif(F.col("top"), F.lit(0.0)))
    value = scaled if bits == 32 else F.pmod(F.floor(scaled), F.lit(256 if bits == 8 else 65536)).cast("double")
    return _with_stats(raster, top=F.max("value")).withColumn("value", value).drop("top")


def minmax_stretch(raster: DataFrame, factor: float = 255.0) -> DataFrame:
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return _with_stats(raster, low=F.min("value"), high=F.max("value")).withColumn("value", F.try_divide((F.col("value") - F.col("low")) * factor, span)).drop("low", "high")


def percentiles(raster: DataFrame, low: float, high: float) -> DataFrame:
    """(raster_id, band, low, high): two percentiles, interpolated, from running counts of the distinct values: those values stay whose ranks a percentile falls between."""
    counts = raster.where(F.col("value").isNotNull()).groupBy("raster_id", "band", "value").agg(F.count("*").alias("n"))
    # values are dealt by 1024 even steps of their range, so that no task sorts a whole raster
    span = counts.groupBy("raster_id", "band").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.sum("n").alias("all"))
    dealt = counts.join(few(span, "raster-spans"), ["raster_id", "band"])
    dealt = dealt.withColumn("step", F.coalesce(F.floor(F.try_divide((F.col("value") - F.col("least")) * 1023, F.nullif(F.col("most") - F.col("least"), F.lit(0.0)))), F.lit(0)))
    steps = dealt.groupBy("raster_id", "band", "step").agg(F.sum("n").alias("held"))
    by = Window.partitionBy("raster_id", "band").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = steps.withColumn("before", F.coalesce(F.sum("held").over(by), F.lit(0))).drop("held")
    inside = Window.partitionBy("raster_id", "band", "step").orderBy("value")
    ranked = dealt.join(few(before, "raster-steps", 1_000_000), ["raster_id", "band", "step"]).withColumn("last", F.col("before") + F.sum("n").over(inside) - 1)

    def at(share: float) -> Column:
        place = F.lit(share) * (F.col("all") - 1)
        of = lambda rank: F.min(F.when(F.col("last") >= rank, F.col("value")))
        below, above = of(F.floor(place)), of(F.ceil(place))
        part = F.first(place - F.floor(place))
        return below + (above - below) * part

    return ranked.groupBy("raster_id", "band").agg(at(low).alias("low"), at(high).alias("high"))


def percentile_stretch(raster: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Rescales between two percentiles to 0..1, clamped."""
    both = raster.join(few(percentiles(raster, low, high), "raster-stats"), ["raster_id", "band"])
    return both.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("value") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))))).drop("low", "high")


def hist_equalize(raster: DataFrame, bins: int = 256) -> DataFrame:
    """Global histogram equalisation: the share of pixels in bins up to the pixel's. The histogram has ``bins`` rows a raster."""
    binned = _with_stats(raster, low=F.min("value"), high=F.max("value"))
    width = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    binned = binned.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col("value") - F.col("low")) * bins, width)).cast("int"))).drop("low", "high")
    counts = binned.groupBy("raster_id", "band", "bin").agg(F.count("value").alias("n"))
    by = Window.partitionBy("raster_id", "band")
    cumulated = counts.select("raster_id", "band", "bin", (F.sum("n").over(by.orderBy("bin")) / F.sum("n").over(by)).alias("share"))
    return binned.join(few(cumulated, "raster-shares"), ["raster_id", "band", "bin"]).withColumn("value", F.col("share")).drop("bin", "share")


def slant_correct(raster: DataFrame, edge: float = 0.15) -> DataFrame:
    """Multiplies by a linear ramp over the columns, from the mean of the last ``edge`` of the columns' means to that of the first."""
    means = raster.groupBy("raster_id", "band", "col").agg(F.avg("value").alias("m"))
    width = raster.groupBy("raster_id", "band").agg((F.max("col") + 1).alias("w"))
    cut = F.floor(F.col("w") * edge)
    ends = means.join(width, ["raster_id", "band"]).groupBy("raster_id", "band").agg(F.avg(F.when(F.col("col") < cut, F.col("m"))).alias("s0"), F.avg(F.when(F.col("col") >= F.col("w") - cut, F.col("m"))).alias("s1"), F.first("w").alias("w"))
    ramp = F.col("s1") + (F.col("s0") - F.col("s1")) * F.try_divide(F.col("col").cast("double"), F.nullif(F.col("w") - 1, F.lit(0)).cast("double"))
    return raster.join(few(ends, "raster-ends"), ["raster_id", "band"]).withColumn("value", F.col("value") * ramp).drop("s0", "s1", "w")


def apply_land_mask(raster: DataFrame, land: DataFrame) -> DataFrame:
    """0 where the mask is above 0; cells without mask stay."""
    joined = raster.join(land.select(*CELL, F.col("value").alias("m")), CELL, "left")
    return joined.withColumn("value", F.when(F.col("m") > 0, 0.0).otherwise(F.col("value"))).drop("m")


def topo_mask(raster: DataFrame) -> DataFrame:
    return raster.withColumn("value", F.when(F.col("value") == 0, 0.0).otherwise(255.0))


def sigma0_db(raster: DataFrame) -> DataFrame:
    """10 log10 of the value; null for values that aren't positive."""
    return raster.withColumn("value", F.when(F.col("value") > 0, 10 * F.log10("value")))


def calibrate(raster: DataFrame, lut: DataFrame, outputs: tuple[str, ...] = ("sigma",), decibel: bool = False) -> DataFrame:
    """dn^2 / A^2 for each wanted output, A from a table (col, sigma, beta, gamma) of bounded width; null where A is 0. Unknown outputs raise ValueError."""
    if set(outputs) - {"sigma", "beta", "gamma"}:
        raise ValueError("outputs are sigma, beta and gamma")
    joined = raster.join(few(lut, "calibration"), "col")
    cols = []
    for name in outputs:
        c = F.try_divide(F.col("value") * F.col("value"), F.nullif(F.col(name) * F.col(name), F.lit(0.0)))
        cols.append((F.when(c > 0, 10 * F.log10(c)) if decibel else c).alias(f"{name}0"))
    return joined.select("raster_id", "band", "row", "col", *cols)


def rescale(raster: DataFrame, factor: int) -> DataFrame:
    """Mean of blocks of factor x factor cells."""
    return raster.groupBy("raster_id", "band", F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg("value").alias("value"))


def resize_nearest(raster: DataFrame, rows: int, cols: int, new_rows: int = 1200, new_cols: int = 1200) -> DataFrame:
    """Nearest-neighbour resampling: each target cell takes the source cell floor(i * n / m). Sources are exploded to their targets, so there is no join."""
    def targets(c: str, n: int, m: int) -> Column:
        first = F.ceil(F.col(c) * m / n).cast("int")
        last = (F.ceil((F.col(c) + 1) * m / n) - 1).cast("int")
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    one = raster.withColumn("r2", F.explode(targets("row", rows, new_rows)))
    return one.withColumn("c2", F.explode(targets("col", cols, new_cols))).select("raster_id", "band", F.col("r2").alias("row"), F.col("c2").alias("col"), "value")


def mosaic(bottom: DataFrame, top: DataFrame, empty: float = 0.0) -> DataFrame:
    """The top raster over the bottom one; its ``empty`` cells let the bottom through."""
    a, b = bottom.select(*CELL, F.col("value").alias("low")), top.select(*CELL, F.col("value").alias("up"))
    return a.join(b, CELL, "full").select(F.lit("mosaic").alias("raster_id"), F.lit(1).alias("band"), *CELL, F.coalesce(F.nullif(F.col("up"), F.lit(empty)), F.col("low")).alias("value"))


def pad(raster: DataFrame, size: int, rows: int, cols: int) -> DataFrame:
    """The raster in the middle of a size x size canvas that is filled with its mean."""
    spark, up, left = raster.sparkSession, (size - rows) // 2, (size - cols) // 2
    mean = raster.agg(F.avg("value").alias("mean"))
    grid = spark.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("row"), (F.col("id") % size).cast("int").alias("col"))
    moved = raster.select((F.col("row") + up).alias("row"), (F.col("col") + left).alias("col"), "value")
    return grid.join(moved, CELL, "left").crossJoin(F.broadcast(mean)).select(F.lit("pad").alias("raster_id"), F.lit(1).alias("band"), *CELL, F.coalesce("value", "mean").alias("value"))


def reproject_average(raster: DataFrame, x: Column, y: Column, dx: float, dy: float, nodata: float = 0.0) -> DataFrame:
    """Forward reprojection: target coordinates of each pixel's centre are snapped to target cells; a cell's value is the mean of its pixels other than ``nodata``."""
    return raster.where(F.col("value") != nodata).groupBy("raster_id", "band", F.floor(y / dy).cast("int").alias("row"), F.floor(x / dx).cast("int").alias("col")).agg(F.avg("value").alias("value"))


def utm(longitude: Column, latitude: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) on WGS84 by the Krueger series to the third order in n."""
    from math import sqrt

    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    scale = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(latitude), F.radians(longitude - F.lit(6.0 * zone - 183))
    e = 2 * sqrt(n) / (1 + n)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(alpha, 1)), F.lit(0.0))
    north = xi + sum((F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)), F.lit(0.0))
    return F.lit(500000.0) + F.lit(scale) * east, F.lit(scale) * north
