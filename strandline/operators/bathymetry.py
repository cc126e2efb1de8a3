"""Depth discrimination, inversion and the final table of the SAR bathymetry chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.waves import depth_estimate, depth_flag, wave_period
from ..plans.lineage import materialise

METHODS = ("direct", "spectrum", "wavelength")


def classify(points: DataFrame) -> DataFrame:
    return points.withColumn("flag", depth_flag(F.col("wavelength"), F.col("apriori_bathymetry")))


def check_inputs(has_bathymetry: bool, period: float) -> None:
    if not has_bathymetry and not period:
        raise ValueError("neither a-priori bathymetry nor a wave period is given")


def discriminate(points: DataFrame, method: str = "direct") -> DataFrame:
    """Adds group: deep points get their period and a-priori depth, shallow ones period 0 and no depth, quasi-deep ones form a group only without any deep ones and with another method than direct."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    flagged = classify(points)
    counts = flagged.agg(F.count_if(F.col("flag") == 0).alias("deep"), F.count_if(F.col("flag") == 0.5).alias("quasi"))
    joined = flagged.crossJoin(F.broadcast(counts))  # one row
    quasi = (F.col("flag") == 0.5) & (F.col("deep") == 0) & F.lit(method != "direct")
    group = F.when(F.col("flag") == 0, "deep").when(F.col("flag") == -1, "shallow").when(quasi, "quasideep").otherwise("compute")
    used = F.when((F.col("deep") == 0) & (F.col("quasi") == 0), "direct").otherwise(method)
    h = -F.col("apriori_bathymetry")
    tp = F.when(F.col("flag") == 0, wave_period(F.col("wavelength"), h)).when(F.col("flag") == -1, 0.0).otherwise(F.col("tp"))
    return joined.withColumns({"group": group, "method": used, "tp": tp, "bathymetry": F.when(F.col("flag") == 0, F.col("apriori_bathymetry")).otherwise(F.lit(None).cast("double"))}).drop("deep", "quasi")


def direct_inversion(points: DataFrame) -> DataFrame:
    """Depth by the linear dispersion relation for the group compute (and quasideep); others stay. Minimisation methods leave points as they are."""
    wanted = F.col("group").isin("compute", "quasideep")
    return points.withColumn("bathymetry", F.when(wanted, -depth_estimate(F.col("wavelength"), F.col("tp"))).otherwise(F.col("bathymetry")))


def merge_points(points: DataFrame) -> DataFrame:
    """Deep, then computed, then shallow points, told by ``part``."""
    return points.withColumn("part", F.when(F.col("group") == "deep", 0).when(F.col("group") == "shallow", 2).otherwise(1))


def sort_points(points: DataFrame) -> DataFrame:
    """One point for each easting and northing (the first id), ordered by both."""
    whole = F.struct(*points.columns)
    return points.groupBy("easting", "northing").agg(F.min_by(whole, "point_id").alias("p")).select("p.*").orderBy("easting", "northing")


def table_lines(points: DataFrame) -> DataFrame:
    """(idx, line) of the text table: index from 1, easting, northing, direction, period, wavelength, depth, one line a place, ordered by place.

    Indices follow a range sort, which is written first, so that a row's place is the same wherever it is read: counts of the ranges before a row's range and its place there.
    """
    wanted = sort_points(points).select("easting", "northing", "direction", "tp", "wavelength", "bathymetry")
    ordered = wanted.repartitionByRange("easting", "northing").sortWithinPartitions("easting", "northing")
    placed = ordered.select(F.spark_partition_id().alias("p"), (F.monotonically_increasing_id() - F.spark_partition_id().cast("long") * 2**33).alias("m"), "*")
    placed = materialise(placed, "table-lines")
    before = placed.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.join(F.broadcast(before.select("p", "before")), "p").withColumn("idx", F.col("m") + F.col("before") + 1)  # a row a partition
    return numbered.select("idx", F.format_string("%4d %16.3f %16.3f %10.3f %10.3f %10.3f %10.3f", "idx", "easting", "northing", "direction", "tp", "wavelength", "bathymetry").alias("line"))


def known_depth(points: DataFrame) -> DataFrame:
    """Points with an a-priori depth."""
    return points.where(F.col("apriori_bathymetry").isNotNull() & ~F.isnan("apriori_bathymetry"))


def unknown_depth(points: DataFrame) -> DataFrame:
    """Points without an a-priori depth."""
    return points.where(F.col("apriori_bathymetry").isNull() | F.isnan("apriori_bathymetry"))


def depth_anomalies(points: DataFrame) -> DataFrame:
    """A-priori depths as they are: no anomaly is known that would be removed."""
    return points


def residuals(points: DataFrame) -> DataFrame:
    """Residual of a-priori and estimated depth, also in percent, and the arrow angle of the direction for maps."""
    from ..functions.waves import nautical

    r = F.col("apriori_bathymetry") - F.col("bathymetry")
    return points.withColumns({"residual": r, "percent": F.try_divide(100 * r, F.nullif("apriori_bathymetry", F.lit(0.0))), "arrow": F.radians(180 + nautical(F.col("direction")))})


def period_stats(points: DataFrame) -> DataFrame:
    deep = points.where("flag = 0")
    return deep.agg(F.avg("tp").alias("mean"), F.stddev_pop("tp").alias("std"), F.count("*").alias("n"))


def group_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("group").agg(F.count("*").alias("n"))


def sample_deep(points: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """At most ``n`` deep points, drawn by a hash of the seed and their ids."""
    return points.where("flag = 0").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("point_id").cast("string"))), "point_id").limit(n)
