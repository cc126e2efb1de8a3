"""Vector operators: geometries as arrays and WKT, polygons from rasters, rasters from lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import few, materialise
from .graph import components, contracted


def _number(c: Column) -> Column:
    """Decimal text without needless zeros."""
    return F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"\.?0+$", "")


def _coordinates(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]), _number(F.coalesce(p["z"], F.lit(0.0))))), ",")


def wkt_point(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.concat(F.lit("POINT ("), F.concat_ws(" ", _number(x), _number(y), _number(F.lit(0.0) if z is None else z)), F.lit(")"))


def wkt_point6(x: Column, y: Column) -> Column:
    return F.format_string("POINT(%f %f)", x, y)


def wkt_line(points: Column, kind: str = "LINESTRING") -> Column:
    """LINESTRING, LINEARRING or MULTIPOINT of an array of struct(x, y, z)."""
    return F.concat(F.lit(f"{kind} ("), _coordinates(points), F.lit(")"))


def wkt_rings(rings: Column, kind: str = "POLYGON") -> Column:
    """POLYGON or MULTILINESTRING of an array of arrays."""
    return F.concat(F.lit(f"{kind} ("), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), _coordinates(r), F.lit(")"))), ","), F.lit(")"))


def wkt_polygons(polygons: Column) -> Column:
    one = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, lambda r: F.concat(F.lit("("), _coordinates(r), F.lit(")"))), ","), F.lit(")"))
    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(polygons, one), ","), F.lit(")"))


def parse_wkt_points(wkt: Column) -> Column:
    """Array of struct(x, y) of all coordinates of a WKT text; null if it is none."""
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    pairs = F.regexp_extract_all(wkt, F.lit(rf"({number}\s+{number}(?:\s+{number})?)"), F.lit(1))
    valid = wkt.rlike(r"^\s*(?i:POINT|LINESTRING|LINEARRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON)\s*(?i:Z\s*)?\([-+0-9eE.,()\s]+\)\s*$")
    return F.when(valid, F.transform(pairs, lambda p: F.struct(F.get(F.split(p, r"\s+"), 0).cast("double").alias("x"), F.get(F.split(p, r"\s+"), 1).cast("double").alias("y"))))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Point in polygon by ray casting; the boundary is inside. Vertices are literals of the plan."""
    crossings, edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        edge = edge | ((side == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            up = (F.lit(ay) > y) != (F.lit(by) > y)
            crossings = crossings + (up & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).cast("int")
    return edge | (crossings % 2 == 1)


def create_vector(rows: DataFrame, x: str = "Longitude", y: str = "Latitude", layer: str = "layer") -> DataFrame:
    """Point features from a table: every field a double, geometry from two of them, EPSG:4326; feature ids follow ``rows.fid``."""
    fields = [c for c in rows.columns if c != "fid"]
    return rows.select(F.lit(layer).alias("layer"), "fid", *[F.col(c).cast("double").alias(c) for c in fields], wkt_point6(F.col(x).cast("double"), F.col(y).cast("double")).alias("wkt"), F.lit(4326).alias("epsg"))


def edit_vector(features: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the rows' fields to the features by position (fid); features beyond the rows get nulls, rows beyond the features are left out."""
    fields = [c for c in rows.columns if c != "fid"]
    return features.join(rows.select("fid", *[F.col(c).cast("double").alias(c) for c in fields]), "fid", "left")


def polygon_to_polyline(features: DataFrame) -> DataFrame:
    """Each ring of ``geom`` (array of rings) becomes a line; attributes stay."""
    return features.select("*", F.posexplode("geom").alias("ring", "line")).drop("geom")


#: Side of the tiles that are labelled each by itself.
TILE = 256


def _labelled(values: np.ndarray) -> np.ndarray:
    """Smallest flat index of the 4-connected equal cells, for each cell; cells that are NaN stay alone. Labels spread along rows and columns until nothing changes, each time as far as a run of equal cells goes."""
    rows, cols = values.shape
    label = np.arange(rows * cols).reshape(rows, cols)
    across = np.zeros((rows, cols), bool)
    across[:, 1:] = values[:, 1:] == values[:, :-1]
    down = np.zeros((cols, rows), bool)
    down[:, 1:] = (values[1:] == values[:-1]).T
    runs = [np.flatnonzero(~same.ravel()) for same in (across, down)]
    number = [np.cumsum(~same.ravel()) - 1 for same in (across, down)]
    while True:
        before = label
        label = np.minimum.reduceat(label.ravel(), runs[0])[number[0]].reshape(rows, cols)
        label = np.minimum.reduceat(label.T.ravel(), runs[1])[number[1]].reshape(cols, rows).T
        label = np.minimum(label, label.ravel()[label])  # to the label of the label
        if (label == before).all():
            return label


def _tile_labels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (raster_id, band, row, col, value, cell) of one tile each: cell becomes the smallest cell number of the region within the tile."""
    for f in frames:
        r, c = f["row"].to_numpy(), f["col"].to_numpy()
        grid = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
        cells = np.zeros(grid.shape, np.int64)
        at = r - r.min(), c - c.min()
        grid[at], cells[at] = f["value"].to_numpy(), f["cell"].to_numpy()
        yield f.assign(cell=cells.ravel()[_labelled(grid).ravel()].reshape(grid.shape)[at])


def regions(raster: DataFrame) -> DataFrame:
    """Adds region: the smallest cell number (row * 2^31 + col) of the 4-connected cells of equal value. Null cells have no region.

    Tiles are labelled each in one task; regions of different tiles are joined by the pairs of equal cells on both sides of the tiles' borders alone.
    """
    kept = raster.where(F.col("value").isNotNull()).select("raster_id", "band", "row", "col", "value")
    cell = F.col("row").cast("long") * 2**31 + F.col("col")
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    placed = kept.select("*", cell.alias("cell"), tile("row").alias("tr"), tile("col").alias("tc"))
    schema = "raster_id string, band int, row int, col int, value double, cell long"
    one = lambda f: next(_tile_labels(iter([f])))
    inner = placed.groupBy("raster_id", "band", "tr", "tc").applyInPandas(lambda f: one(f[["raster_id", "band", "row", "col", "value", "cell"]]), schema)
    inner = materialise(inner, "tiles")
    edges = []
    for by, order in (("row", "col"), ("col", "row")):
        here = F.col(order) % TILE
        last = inner.where(here == TILE - 1).select("raster_id", "band", by, (F.col(order) + 1).alias(order), F.col("value").alias("v"), F.col("cell").alias("b"))
        first = inner.where(here == 0).select("raster_id", "band", by, order, "value", F.col("cell").alias("a"))
        edges.append(first.join(last, ["raster_id", "band", by, order]).where("value = v").select("raster_id", "band", "a", "b"))
    key = lambda c: F.concat_ws("/", "raster_id", F.col("band").cast("string"), F.col(c).cast("string"))
    met = materialise(edges[0].unionAll(edges[1]), "borders")
    roots = components(contracted(met.select(key("a").alias("a"), key("b").alias("b"))))
    ends = met.select("raster_id", "band", F.explode(F.array("a", "b")).alias("cell")).distinct().withColumn("node", key("cell"))
    known = materialise(ends.join(roots, "node").select("raster_id", "band", "cell", "root"), "border-roots")
    told = known.join(known.groupBy("root").agg(F.min("cell").alias("least")), "root").select("raster_id", "band", "cell", F.col("least").alias("root"))
    joined = inner.join(few(told, "tile-roots", 1_000_000), ["raster_id", "band", "cell"], "left")
    return joined.select("raster_id", "band", "row", "col", "value", F.coalesce("root", "cell").alias("region"))


def polygonize(raster: DataFrame, field: str = "DN") -> DataFrame:
    """(raster_id, band, region, field, area, min_row, min_col, max_row, max_col, perimeter) of each region of equal value."""
    r = regions(raster)
    keyed = []
    for by, order in (("row", "col"), ("col", "row")):
        w = Window.partitionBy("raster_id", "band", by).orderBy(order)
        here = [F.coalesce((f("region").over(w) == F.col("region")) & (f(order).over(w) == F.col(order) + d), F.lit(False)).cast("int") for f, d in ((F.lag, -1), (F.lead, 1))]
        keyed.append(here[0] + here[1])
    sides = r.withColumns({"h": keyed[0], "v": keyed[1]})
    return sides.groupBy("raster_id", "band", "region").agg(F.first("value").alias(field), F.count("*").alias("area"), F.min("row").alias("min_row"), F.min("col").alias("min_col"), F.max("row").alias("max_row"), F.max("col").alias("max_col"), F.sum(4 - F.col("h") - F.col("v")).alias("perimeter"))


def rasterize_lines(segments: DataFrame, width: int, height: int, x0: float, y0: float, x1: float, y1: float, background: float = 0.0) -> DataFrame:
    """Burns segments (fid, ax, ay, bx, by, value) into a grid: cells at as many even steps as the longer side has cells; the last feature wins. Other cells are the background."""
    if not width or not height:
        raise ValueError("width and height are needed")
    dx, dy = (x1 - x0) / width, (y1 - y0) / height
    col = lambda c: (F.col(c) - x0) / dx
    row = lambda c: (y1 - F.col(c)) / dy
    cells = segments.select("fid", "value", col("ax").alias("ca"), col("bx").alias("cb"), row("ay").alias("ra"), row("by").alias("rb"))
    steps = F.greatest(F.lit(1.0), F.ceil(F.greatest(F.abs(F.col("ca") - F.col("cb")), F.abs(F.col("ra") - F.col("rb"))))).cast("int")
    burnt = cells.withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n")).cast("int")
    hit = burnt.select("fid", "value", at("ra", "rb").alias("row"), at("ca", "cb").alias("col")).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    top = hit.groupBy("row", "col").agg(F.max_by("value", F.struct("fid", "value")).alias("v"))
    grid = segments.sparkSession.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return grid.join(top, ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(background)).alias("value"))
