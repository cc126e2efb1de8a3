"""Data model: rasters, points, signals as DataFrames, and the deterministic views of the driver tables that the registered queries read.

pixels: raster_id, band, row, col, value (null = nodata). A raster's geotransform is (x0, dx, y0, dy): easting = x0 + (col + 0.5) dx, northing = y0 + (row + 0.5) dy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

G = 9.80665
PIXELS = "raster_id string, band int, row int, col int, value double"


@dataclass(frozen=True)
class GeoTransform:
    """North-up affine transform."""

    x0: float = 0.0
    dx: float = 1.0
    y0: float = 0.0
    dy: float = -1.0

    def easting(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + F.lit(0.5)) * F.lit(self.dx)

    def northing(self, row: Column) -> Column:
        return F.lit(self.y0) + (row + F.lit(0.5)) * F.lit(self.dy)

    def column(self, easting: Column) -> Column:
        return F.floor((easting - F.lit(self.x0)) / F.lit(self.dx)).cast("int")

    def line(self, northing: Column) -> Column:
        return F.floor((northing - F.lit(self.y0)) / F.lit(self.dy)).cast("int")


#: DuckDB text and Spark expressions of each view.
VIEWS = {
    "ras_events": ("events", "'events' AS raster_id, 1 AS band, CAST(floor(event_id/100) AS INT) AS row, CAST(event_id % 100 AS INT) AS col, CAST(value AS DOUBLE) AS value"),
    "ras_class": ("events", "'class' AS raster_id, 1 AS band, CAST(floor(event_id/100) AS INT) AS row, CAST(event_id % 100 AS INT) AS col, CAST(1 + length(event_type) % 5 AS DOUBLE) AS value"),
    "ras_part1": ("part", "'part' AS raster_id, 1 AS band, CAST(floor(p_partkey/100) AS INT) AS row, CAST(p_partkey % 100 AS INT) AS col, CAST(p_retailprice AS DOUBLE) AS value"),
    "ras_part2": ("part", "'part' AS raster_id, 2 AS band, CAST(floor(p_partkey/100) AS INT) AS row, CAST(p_partkey % 100 AS INT) AS col, CAST(p_size AS DOUBLE) AS value"),
    "ras_orders": ("orders", "'orders' AS raster_id, 1 AS band, CAST(floor(o_orderkey/100) AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col, CAST(o_totalprice AS DOUBLE) AS value"),
    "pts": ("customer", "c_custkey AS fid, CAST(c_custkey*37 % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey*53 % 180 - 90 AS DOUBLE) AS y, CAST(c_acctbal AS DOUBLE) AS z"),
    "wave": ("part", "p_partkey AS point_id, CAST(50 + p_size*8 AS DOUBLE) AS wavelength, CAST(-(1 + p_partkey % 200) AS DOUBLE) AS apriori_bathymetry, CAST(16.6 AS DOUBLE) AS tp, CAST(p_partkey % 50 AS DOUBLE) AS easting, CAST(floor(p_partkey/50) AS DOUBLE) AS northing, CAST(p_partkey*7 % 360 AS DOUBLE) AS direction"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "ras_part":
        return view(spark, sf_dir, "ras_part1").unionAll(view(spark, sf_dir, "ras_part2"))
    if name == "sig":
        one = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "v"))
        return one.select("vec_id", "i", F.col("v").cast("double").alias("v"))
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[c.strip() for c in columns.split(", ") if c]) if "(" not in columns else spark.sql(f"SELECT {columns} FROM parquet.`{sf_dir}/{table}.parquet`")


def views_sql() -> str:
    """The common table expressions of all views, for DuckDB."""
    parts = [f"{n} AS (SELECT {c} FROM {t})" for n, (t, c) in VIEWS.items()]
    parts.append("ras_part AS (SELECT * FROM ras_part1 UNION ALL SELECT * FROM ras_part2)")
    parts.append("sig AS (SELECT vec_id, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))")
    return "WITH " + ", ".join(parts)
