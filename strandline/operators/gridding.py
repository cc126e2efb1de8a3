"""Scattered points to grids: inverse distance, nearest neighbours, moving average, nearest, linear.

Points and grid nodes meet in buckets of equal size, never all with all: a node looks at the points of buckets within its search radius. Methods
that by definition weigh every point of the layer (radius None) send blocks of the grid's nodes to the points, and add up partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import materialise

#: Nodes that are broadcast at one time where every point counts at each.
BLOCK = 250_000


def grid(spark: SparkSession, nx: int, ny: int, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Nodes (row, col, gx, gy) at the centres of an nx * ny grid over the extent."""
    dx, dy = (x1 - x0) / nx, (y1 - y0) / ny
    cell = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))
    return cell.select("row", "col", (F.lit(x0) + (F.col("col") + 0.5) * F.lit(dx)).alias("gx"), (F.lit(y0) + (F.col("row") + 0.5) * F.lit(dy)).alias("gy"))


def _pairs(nodes: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    d2 = (F.col("gx") - F.col("x")) * (F.col("gx") - F.col("x")) + (F.col("gy") - F.col("y")) * (F.col("gy") - F.col("y"))
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.array(*[F.struct((cell("gx") + i).alias("bx"), (cell("gy") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = nodes.withColumn("b", F.explode(around)).select("row", "col", "gx", "gy", "b.bx", "b.by")
    right = points.select("fid", "x", "y", "z", cell("x").alias("bx"), cell("y").alias("by"))
    return left.join(right, ["bx", "by"]).drop("bx", "by").withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def _foremost(points: DataFrame, k: int = 1) -> DataFrame:
    """The points of the ``k`` smallest fids at each position: no others there are among the ``k`` nearest of a node, however many points share positions."""
    if k == 1:
        return points.groupBy("x", "y").agg(F.min("fid").alias("fid"), F.min_by("z", "fid").alias("z"))
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("fid"))
    return points.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _weighed(nodes: DataFrame, points: DataFrame, power: float) -> DataFrame:
    """(row, col, hit_fid, hit, a, b): sums of weighted values and of weights of all points at each node, and the point at the node itself, if any.

    Each task holds the nodes' coordinates and sums, BLOCK nodes at a time, and streams through its points, so neither their number nor that of the nodes is bounded.
    """
    schema = "row int, col int, hit_fid long, hit double, a double, b double"
    parts = -(-nodes.count() // BLOCK) or 1
    found = []
    for part in range(parts):
        some = nodes.where(F.pmod(F.hash("row", "col"), F.lit(parts)) == part).select("row", "col", "gx", "gy").toPandas()
        shared = nodes.sparkSession.sparkContext.broadcast(some)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            some = shared.value
            gx, gy = some["gx"].to_numpy(), some["gy"].to_numpy()
            a, b, fid, hit = np.zeros(len(some)), np.zeros(len(some)), np.full(len(some), np.iinfo(np.int64).max), np.full(len(some), np.nan)
            step, any_ = max(1, 1_000_000 // max(len(some), 1)), False
            for f in frames:
                f = f.dropna()
                for i in range(0, len(f), step):
                    p = f[i : i + step]
                    any_ = True
                    d2 = (gx[:, None] - p["x"].to_numpy()) ** 2 + (gy[:, None] - p["y"].to_numpy()) ** 2
                    at = d2 == 0
                    w = np.where(at, 0.0, np.where(at, 1.0, d2) ** (-power / 2))
                    a += w @ p["z"].to_numpy()
                    b += w.sum(1)
                    ids = np.where(at, p["fid"].to_numpy(), np.iinfo(np.int64).max)
                    k = ids.argmin(1)
                    first = ids[np.arange(len(some)), k]
                    new = first < fid
                    fid, hit = np.where(new, first, fid), np.where(new, p["z"].to_numpy()[k], hit)
            if any_:
                yield some[["row", "col"]].assign(hit_fid=np.where(np.isnan(hit), 0, fid), hit=hit, a=a, b=b)

        partial = points.select("fid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z")).mapInPandas(run, schema).withColumn("hit", F.nullif(F.col("hit"), F.lit(float("nan"))))
        found.append(partial.groupBy("row", "col").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("hit_fid"))).alias("hit"), F.sum("a").alias("a"), F.sum("b").alias("b")))
    return reduce(DataFrame.unionAll, found)


def invdist(nodes: DataFrame, points: DataFrame, power: float = 2.0, radius: float | None = None) -> DataFrame:
    """Shepard's weighting; a point at the node itself gives its value (the smallest fid of several). Without radius every point counts at every node; points without x, y or z don't."""
    if radius is None:
        return _weighed(nodes, points, power).select("row", "col", F.coalesce("hit", F.try_divide("a", "b")).alias("value"))
    w = F.when(F.col("d2") > 0, F.pow("d2", F.lit(-power / 2)))
    g = _pairs(nodes, points, radius).groupBy("row", "col").agg(F.min_by("z", F.when(F.col("d2") == 0, F.col("fid"))).alias("hit"), F.sum(w * F.col("z")).alias("a"), F.sum(w).alias("b"))
    return g.select("row", "col", F.coalesce("hit", F.try_divide("a", "b")).alias("value"))


def invdist_nearest(nodes: DataFrame, points: DataFrame, k: int = 4, power: float = 2.0, radius: float = 20.0) -> DataFrame:
    """``invdist`` over the ``k`` nearest points within the radius, ties by fid."""
    rank = F.row_number().over(Window.partitionBy("row", "col").orderBy("d2", "fid"))
    near = _pairs(nodes, _foremost(points, k), radius).withColumn("r", rank).where(F.col("r") <= k)
    w = F.when(F.col("d2") > 0, F.pow("d2", F.lit(-power / 2)))
    g = near.groupBy("row", "col").agg(F.min_by("z", F.when(F.col("d2") == 0, F.col("fid"))).alias("hit"), F.sum(w * F.col("z")).alias("a"), F.sum(w).alias("b"))
    return g.select("row", "col", F.coalesce("hit", F.try_divide("a", "b")).alias("value"))


def average(nodes: DataFrame, points: DataFrame, radius: float | None = None) -> DataFrame:
    """Mean of the points within the radius, without one of all points."""
    if radius is None:
        return nodes.select("row", "col").crossJoin(F.broadcast(points.agg(F.avg("z").alias("value"))))  # one row
    return _pairs(nodes, points, radius).groupBy("row", "col").agg(F.avg("z").alias("value"))


def nearest(nodes: DataFrame, points: DataFrame, radius: float | None = None) -> DataFrame:
    """Value of the nearest point, the smallest fid of several. Without radius the search begins near, by the positions' density, and goes on four times as far for nodes without a point yet."""
    wanted = lambda left, points, r: _pairs(left, points, r).groupBy("row", "col").agg(F.min_by("z", F.struct("d2", "fid")).alias("value"))
    if radius is not None:
        return wanted(nodes, _foremost(points), radius)
    points = materialise(_foremost(points), "positions")
    n, *box = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    found, left = [], nodes
    if not n:
        return nodes.limit(0).select("row", "col", F.lit(None).cast("double").alias("value"))
    radius = 2 * max(box[1] - box[0], box[3] - box[2], 1e-9) / n**0.5
    while True:
        found.append(materialise(wanted(left, points, radius), "nearest"))
        left = materialise(left.join(found[-1], ["row", "col"], "left_anti"), "far-nodes")
        if left.isEmpty():
            return reduce(DataFrame.unionAll, found)
        radius *= 4


def triangulate(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles (Bowyer-Watson) of distinct points, as index triples."""
    low, span = xy.min(axis=0), float(np.ptp(xy, axis=0).max()) or 1.0
    p = np.vstack([xy, low + np.array([[-20, -20], [40, -20], [-20, 40]]) * span])
    n = len(xy)

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = p[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if d == 0:
            return 0.0, 0.0, np.inf
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        return ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2

    triangles, circles = [(n, n + 1, n + 2)], [circle((n, n + 1, n + 2))]
    for i in range(n):
        c = np.array(circles)
        bad = np.flatnonzero((c[:, 0] - p[i, 0]) ** 2 + (c[:, 1] - p[i, 1]) ** 2 < c[:, 2] * (1 - 1e-12))
        edges: dict[tuple[int, int], int] = {}
        for b in bad:
            t = triangles[b]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                key = (min(e), max(e))
                edges[key] = edges.get(key, 0) + 1
        gone = set(bad.tolist())
        triangles = [t for k, t in enumerate(triangles) if k not in gone]
        circles = [x for k, x in enumerate(circles) if k not in gone]
        for (a, b), times in edges.items():
            if times == 1:
                triangles.append((a, b, i))
                circles.append(circle((a, b, i)))
    return np.array([t for t in triangles if max(t) < n], int).reshape(-1, 3)


#: Distinct points that are triangulated at most, on the driver.
MOST_TRIANGULATED = 20_000


def linear(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Barycentric interpolation in a Delaunay triangulation of the distinct points; null outside of the hull. The number of points is checked first."""
    distinct = points.groupBy("x", "y").agg(F.min_by("z", "fid").alias("z"))
    if distinct.count() > MOST_TRIANGULATED:
        raise ValueError("too many points for one triangulation; crop or thin them first")
    frame = distinct.toPandas().sort_values(["x", "y"])
    xy, z = frame[["x", "y"]].to_numpy(), frame["z"].to_numpy()
    tri = triangulate(xy)
    shared = nodes.sparkSession.sparkContext.broadcast((xy, z, tri))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xy, z, tri = shared.value
        a, b, c = xy[tri[:, 0]], xy[tri[:, 1]], xy[tri[:, 2]]
        det = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
        for f in frames:
            out = []
            for x, y in zip(f["gx"], f["gy"], strict=True):
                u = ((b[:, 1] - c[:, 1]) * (x - c[:, 0]) + (c[:, 0] - b[:, 0]) * (y - c[:, 1])) / det
                v = ((c[:, 1] - a[:, 1]) * (x - c[:, 0]) + (a[:, 0] - c[:, 0]) * (y - c[:, 1])) / det
                inside = np.flatnonzero((u >= -1e-12) & (v >= -1e-12) & (u + v <= 1 + 1e-12))
                out.append(float(u[inside[0]] * z[tri[inside[0], 0]] + v[inside[0]] * z[tri[inside[0], 1]] + (1 - u[inside[0]] - v[inside[0]]) * z[tri[inside[0], 2]]) if len(inside) else None)
            yield f[["row", "col"]].assign(value=pd.Series(out, index=f.index, dtype=float))

    return nodes.mapInPandas(run, "row int, col int, value double")


def bilinear(points: DataFrame, raster: DataFrame, x0: float, dx: float, y0: float, dy: float) -> DataFrame:
    """Value of the raster at points (fid, x, y) from its four surrounding cell centres; null where one is missing."""
    fc, fr = (F.col("x") - x0) / dx - 0.5, (F.col("y") - y0) / dy - 0.5
    u, v = fc - F.floor(fc), fr - F.floor(fr)
    corners = F.array(*[F.struct((F.floor(fr) + i).cast("int").alias("row"), (F.floor(fc) + j).cast("int").alias("col"), ((v if i else 1 - v) * (u if j else 1 - u)).alias("w")) for i in (0, 1) for j in (0, 1)])
    spread = points.select("fid", F.explode(corners).alias("c")).select("fid", "c.row", "c.col", "c.w").where("w > 0")
    joined = spread.join(raster.select("row", "col", "value"), ["row", "col"], "left")
    return joined.groupBy("fid").agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))


def bicubic(points: DataFrame, raster: DataFrame, x0: float, dx: float, y0: float, dy: float) -> DataFrame:
    """Value of the raster at points (fid, x, y) by cubic convolution (Keys, 1981) of the sixteen cell centres around; null where one is missing."""
    fc, fr = (F.col("x") - x0) / dx - 0.5, (F.col("y") - y0) / dy - 0.5

    def weights(t: Column) -> Column:
        """Of the cells one before, at, one and two after a place ``t`` of the way from one to the next."""
        near, far = lambda x: 1.5 * x * x * x - 2.5 * x * x + 1, lambda x: -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2
        return F.array(far(1 + t), near(t), near(1 - t), far(2 - t))

    placed = points.select("fid", F.floor(fr).alias("r"), F.floor(fc).alias("c"), (fr - F.floor(fr)).alias("v"), (fc - F.floor(fc)).alias("u"))
    rows = placed.select("fid", "c", "u", "r", F.posexplode(weights(F.col("v"))).alias("i", "wr"))
    cells = rows.select("fid", (F.col("r") + F.col("i") - 1).cast("int").alias("row"), "c", "wr", F.posexplode(weights(F.col("u"))).alias("j", "wc"))
    spread = cells.select("fid", "row", (F.col("c") + F.col("j") - 1).cast("int").alias("col"), (F.col("wr") * F.col("wc")).alias("w")).where("w <> 0")
    joined = spread.join(raster.select("row", "col", "value"), ["row", "col"], "left")
    return joined.groupBy("fid").agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))


def rbf(targets: DataFrame, points: DataFrame, most: int = 2000) -> DataFrame:
    """Multiquadric radial basis interpolation of bounded control points at (fid, x, y); epsilon is the mean spacing of the points. Points of one position are merged to their mean before their number is checked."""
    distinct = points.groupBy("x", "y").agg(F.avg("z").alias("z"))
    if distinct.count() > most:
        raise ValueError(f"more than {most} control points")
    frame = distinct.toPandas().sort_values(["x", "y"])
    xy, z = frame[["x", "y"]].to_numpy(), frame["z"].to_numpy()
    epsilon = float(np.sqrt(np.prod(np.ptp(xy, axis=0)) / len(xy))) or 1.0
    distance = lambda a: np.sqrt((((a[:, None] - xy[None]) ** 2).sum(-1)) / epsilon**2 + 1)
    weights = np.linalg.lstsq(distance(xy), z, rcond=None)[0]
    shared = targets.sparkSession.sparkContext.broadcast((xy, weights, epsilon))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xy, weights, epsilon = shared.value
        for f in frames:
            a = f[["x", "y"]].to_numpy()
            yield f[["fid"]].assign(value=np.sqrt(((a[:, None] - xy[None]) ** 2).sum(-1) / epsilon**2 + 1) @ weights)

    return targets.select("fid", "x", "y").mapInPandas(run, "fid long, value double")
