"""Statistics, profiles, peaks and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def image_stats(raster: DataFrame) -> DataFrame:
    return raster.groupBy("raster_id", "band").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def column_mean(raster: DataFrame) -> DataFrame:
    """(col, mean) over all rows."""
    return raster.groupBy("col").agg(F.avg("value").alias("mean"))


def band_mean(raster: DataFrame) -> DataFrame:
    """(row, col, mean) over all bands."""
    return raster.groupBy("row", "col").agg(F.avg("value").alias("mean"))


def histogram(raster: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("value") - low) * bins / (high - low))).cast("int")
    return raster.where(F.col("value").between(low, high)).groupBy("raster_id", "band", bin_.alias("bin")).agg(F.count("*").alias("n"))


def radial_profile(raster: DataFrame, row: float, col: float) -> DataFrame:
    x, y = F.col("col") - F.lit(float(col)), F.col("row") - F.lit(float(row))  # squares of whole cells would overflow
    return raster.groupBy(F.rint(F.sqrt(x * x + y * y)).cast("int").alias("r")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def directional_histogram(raster: DataFrame, row: float, col: float) -> DataFrame:
    """Mean of the non-zero values by whole degrees 0 to 360 around a centre."""
    from ..functions.waves import phase

    theta = F.rint(phase(F.col("col") - col, F.col("row") - row)).cast("int")
    return raster.groupBy(theta.alias("theta")).agg(F.try_divide(F.sum("value"), F.nullif(F.count_if(F.col("value") != 0), F.lit(0))).alias("mean"))


def influence_radius(profile: DataFrame, dk: float) -> DataFrame:
    """From (r, mean): wavelengths at the first and last bin above a fifth of the peak and the last above a twentieth; one row."""
    from math import pi

    top = profile.where("r > 0").agg(F.max("mean").alias("top"))
    joined = profile.where("r > 0").crossJoin(F.broadcast(top))  # one row
    wave = lambda r: F.lit(2 * pi / dk) / r
    fifth, twentieth = F.col("mean") > 0.2 * F.col("top"), F.col("mean") > 0.05 * F.col("top")
    return joined.agg(F.max_by("r", F.struct("mean", -F.col("r"))).alias("peak"), (F.round(wave(F.min(F.when(fifth, F.col("r")))) / 10) * 10).alias("longest"), (F.floor(wave(F.max(F.when(fifth, F.col("r")))) / 10) * 10).alias("shortest"), (F.floor(wave(F.max(F.when(twentieth, F.col("r")))) / 10) * 10).alias("limit"))


def block_mean(series: DataFrame, n: int = 6) -> DataFrame:
    """Means of consecutive blocks of (key, i, v): nulls and NaN count as 0, an incomplete tail is left out."""
    v = F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0))
    return series.groupBy("key", F.floor(F.col("i") / n).cast("int").alias("block")).agg((F.sum(v) / n).alias("mean"), F.count("*").alias("c")).where(F.col("c") == n).drop("c")


def error_metrics(pairs: DataFrame) -> DataFrame:
    """From (signal, reference): rmse, bias, mae and correlation."""
    d = F.col("signal") - F.col("reference")
    return pairs.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.corr("signal", "reference").alias("corr"))


def crossings(series: DataFrame, threshold: float) -> DataFrame:
    """(key, i) where the sign of v - threshold differs from the one before."""
    sign = F.signum(F.col("v") - threshold)
    return series.withColumn("d", sign - F.lag(sign).over(Window.partitionBy("key").orderBy("i"))).where("d <> 0").select("key", "i")


def above(values: Column, threshold: float) -> Column:
    return F.filter(values, lambda v: v > threshold)


def detect_peaks(series: DataFrame, mph: float | None = None, threshold: float = 0.0, edge: str | None = "rising", valley: bool = False, mpd: int = 1) -> DataFrame:
    """(key, i, v) of local maxima (minima with ``valley``) of series of bounded length. Ends are no peaks; of a plateau the rising or falling edge counts, both, or with None no edge.

    With ``mpd`` above 1 higher peaks suppress lower ones nearer than it: a peak stays if no kept one is that near, decided from the highest down.
    """
    if edge not in ("rising", "falling", "both", None):
        raise ValueError(f"unknown edge {edge!r}")
    v = -F.col("v") if valley else F.col("v")
    w = Window.partitionBy("key").orderBy("i")
    s = series.withColumn("y", v).withColumns({"a": F.lag("y").over(w), "b": F.lead("y").over(w)})
    da, db = F.col("y") - F.col("a"), F.col("b") - F.col("y")
    rising, falling = (db <= 0) & (da > 0), (db < 0) & (da >= 0)
    kept = {"rising": rising, "falling": falling, "both": rising | falling, None: (da > 0) & (db < 0)}[edge]
    p = s.where(kept & F.col("a").isNotNull() & F.col("b").isNotNull())
    if mph is not None:
        p = p.where(F.col("y") >= mph)
    if threshold > 0:
        p = p.where(F.least(da, -db) >= threshold)
    p = p.select("key", "i", "v", "y")
    if mpd > 1:
        ranked = p.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("h"), "i", "v"))).alias("ps"))
        none = F.array().cast("array<struct<h:double,i:int,v:double>>")
        greedy = F.aggregate("ps", none, lambda s, x: F.when(F.exists(s, lambda q: F.abs(q["i"] - x["i"]) < mpd), s).otherwise(F.concat(s, F.array(F.struct(x["h"].alias("h"), x["i"].cast("int").alias("i"), x["v"].alias("v"))))))
        p = ranked.select("key", F.explode(greedy).alias("x")).select("key", "x.i", "x.v")
    return p.select("key", "i", "v")


def weighted_profile(profiles: DataFrame) -> DataFrame:
    """From (key, w, i, s): distance-weighted mean and deviation by bin."""
    return profiles.groupBy("key", "i").agg((F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("mean"), F.stddev_pop("s").alias("std"))


def box_mean(boxes: DataFrame) -> DataFrame:
    """From (key, box, i, k, s): mean and population deviation over boxes."""
    return boxes.groupBy("key", "i").agg(F.avg("k").alias("k"), F.avg("s").alias("s"), F.stddev_pop("s").alias("std"))
