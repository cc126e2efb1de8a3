"""Speckle filters and dilation. Windows shrink at the borders; filters run in NumPy over tiles with their surroundings, after one shuffle that sends a cell about once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = ("None", "Boxcar", "Median", "Frost", "Gamma Map", "Lee", "Refined Lee", "Lee Sigma", "IDAN")


def _lines(by: str, order: str, half: int):
    return Window.partitionBy("raster_id", "band", by).orderBy(order).rangeBetween(-half, half)


def boxcar(raster: DataFrame, kx: int = 3, ky: int = 3) -> DataFrame:
    """Mean of the kernel by two passes of running sums, along rows and along columns."""
    across = raster.withColumns({"s": F.sum("value").over(_lines("row", "col", kx // 2)), "n": F.count("value").over(_lines("row", "col", kx // 2))})
    down = _lines("col", "row", ky // 2)
    return across.withColumn("value", F.sum("s").over(down) / F.sum("n").over(down)).drop("s", "n")


def dilate(raster: DataFrame, size: int = 5, iterations: int = 2) -> DataFrame:
    """Greatest value of a square, ``iterations`` times, by separable passes."""
    for _ in range(iterations):
        raster = raster.withColumn("value", F.max("value").over(_lines("row", "col", size // 2)))
        raster = raster.withColumn("value", F.max("value").over(_lines("col", "row", size // 2)))
    return raster


#: Side of the tiles that a task filters at one time.
TILE = 256


def by_tiles(raster: DataFrame, reach_rows: int, reach_cols: int, kernel) -> DataFrame:
    """Values of ``kernel`` for each cell: it takes the cells of a tile with its surroundings as an array (NaN where there is no value), and returns the tile's inner values.

    A cell goes to its own tile and to those that it is within reach of, so the shuffle sends each cell about once. Null results are null cells.
    """
    def near(c: str, reach: int) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE).cast("int"), F.floor((F.col(c) + reach) / TILE).cast("int")))

    spread = raster.select("raster_id", "band", "row", "col", "value").withColumn("tr", near("row", reach_rows)).withColumn("tc", near("col", reach_cols))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        top, left = frame["tr"].iloc[0] * TILE, frame["tc"].iloc[0] * TILE
        r, c = frame["row"].to_numpy() - top + reach_rows, frame["col"].to_numpy() - left + reach_cols
        inner = (r >= reach_rows) & (r < TILE + reach_rows) & (c >= reach_cols) & (c < TILE + reach_cols)
        if not inner.any():
            return frame[:0][["raster_id", "band", "row", "col", "value"]]
        grid = np.full((int(r[inner].max()) + 1 + reach_rows, int(c[inner].max()) + 1 + reach_cols), np.nan)
        inside = (r < grid.shape[0]) & (c < grid.shape[1])
        grid[r[inside], c[inside]] = frame["value"].to_numpy(float)[inside]
        out = kernel(grid)[r[inner] - reach_rows, c[inner] - reach_cols]
        return frame.loc[inner, ["raster_id", "band", "row", "col"]].assign(value=np.where(np.isfinite(out), out, np.nan))

    found = spread.groupBy("raster_id", "band", "tr", "tc").applyInPandas(run, "raster_id string, band int, row int, col int, value double")
    return found.withColumn("value", F.nullif(F.col("value"), F.lit(float("nan"))))


def _window(grid: np.ndarray, ky: int, kx: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of the kernel's cells relative to each inner cell: offsets, and one layer of the array for each."""
    hy, hx = ky // 2, kx // 2
    rows, cols = grid.shape[0] - 2 * hy, grid.shape[1] - 2 * hx
    offsets = [(r, c) for r in range(-hy, hy + 1) for c in range(-hx, hx + 1)]
    layers = np.stack([grid[hy + r : hy + r + rows, hx + c : hx + c + cols] for r, c in offsets])
    return np.array([o[0] for o in offsets]), np.array([o[1] for o in offsets]), layers


def _moments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the layers' values."""
    n = np.maximum(np.isfinite(v).sum(0), 1)
    m = np.nansum(v, 0) / n
    return m, np.nansum((v - m) ** 2, 0) / n


def _ratio(a: np.ndarray, b: np.ndarray, none: float) -> np.ndarray:
    return np.where(b != 0, a / np.where(b != 0, b, 1), none)


def _median(r, c, v, p):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # of cells without values around
        return np.nanmedian(v, 0)


def _lee(r, c, v, p):
    x, (m, var) = v[len(v) // 2], _moments(v)
    cv2 = _ratio(var, m * m, np.nan)
    k = np.clip((1 - _ratio(np.full_like(m, 1 / p["enl"]), np.nan_to_num(cv2), np.nan)) / (1 + 1 / p["enl"]), 0, 1)
    return m + np.nan_to_num(k) * (x - m)


def _frost(r, c, v, p):
    m, var = _moments(v)
    spread = np.nan_to_num(_ratio(var, m * m, 0.0))
    w = np.exp(-p["damping"] * spread[None] * np.sqrt(r * r + c * c)[:, None, None])
    w = np.where(np.isfinite(v), w, 0)
    return _ratio(np.nansum(w * np.nan_to_num(v), 0), w.sum(0), np.nan)


def _lee_sigma(r, c, v, p):
    x, (m, _), sigma = v[len(v) // 2], _moments(v), p["enl"] ** -0.5
    near = (v >= x * (1 - 2 * sigma)) & (v <= x * (1 + 2 * sigma))
    return np.where(near.any(0), np.where(near, v, 0).sum(0) / np.maximum(near.sum(0), 1), m)


def _gamma_map(r, c, v, p):
    x, (m, var), cu2, enl = v[len(v) // 2], _moments(v), 1 / p["enl"], p["enl"]
    cv2 = _ratio(var, m * m, np.nan)
    alpha = (1 + cu2) / np.where(cv2 != cu2, cv2 - cu2, np.nan)
    b = alpha - enl - 1
    with np.errstate(invalid="ignore"):
        solved = (b * m + np.sqrt(b * b * m * m + 4 * alpha * enl * m * x)) / (2 * alpha)
        return np.where(~(cv2 > cu2), m, np.where(cv2 >= 2 * cu2, x, solved))


def _linear_estimate(x: np.ndarray, m: np.ndarray, var: np.ndarray, enl: float) -> np.ndarray:
    signal = np.maximum(0, (var - m * m / enl) / (1 + 1 / enl))
    return m + _ratio(signal, var, 0.0) * (x - m)


def _refined_lee(r, c, v, p):
    """Above the variance threshold only the half window along the strongest edge counts."""
    x, (m, var) = v[len(v) // 2], _moments(v)
    best = np.full_like(m, -1.0)
    half_m, half_var = m, var
    for a, b in ((0, 1), (1, 1), (1, 0), (1, -1)):
        up, down = (_moments(np.where((side * (r * a + c * b) >= 0)[:, None, None], v, np.nan)) for side in (1, -1))
        edge = np.round(np.abs(up[0] - down[0]), 9)  # rounded, so that equal edges are told from unequal ones
        upper = np.abs(up[0] - x) <= np.abs(down[0] - x)
        better = edge > best
        best = np.where(better, edge, best)
        half_m = np.where(better, np.where(upper, up[0], down[0]), half_m)
        half_var = np.where(better, np.where(upper, up[1], down[1]), half_var)
    strong = var > p["edge_threshold"]
    return _linear_estimate(x, np.where(strong, half_m, m), np.where(strong, half_var, var), p["enl"])


def _idan(r, c, v, p):
    """Cells that connect to the centre and stay near the median of its surroundings grow a region, whose linear estimate counts."""
    x = v[len(v) // 2]
    seed = _median(r, c, v[(np.abs(r) <= 1) & (np.abs(c) <= 1)], p)
    near = np.abs(v - seed) <= 2 / 3 * np.abs(seed) * p["enl"] ** -0.5
    place = {o: i for i, o in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
    beside = [[place[n] for n in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)) if n in place] for a, b in place]
    grown = np.zeros(v.shape, bool)
    grown[len(v) // 2] = True
    while True:
        wider = grown | (near & np.stack([np.logical_or.reduce(grown[b]) for b in beside]))
        if (wider == grown).all():
            break
        grown = wider
    m, var = _moments(np.where(grown, v, np.nan))
    return _linear_estimate(x, m, var, p["enl"])


KERNELS = {"Median": _median, "Frost": _frost, "Gamma Map": _gamma_map, "Lee": _lee, "Refined Lee": _refined_lee, "Lee Sigma": _lee_sigma, "IDAN": _idan}


def speckle(raster: DataFrame, name: str = "None", kx: int = 3, ky: int = 3, damping: float = 2.0, edge_threshold: float = 5000.0, enl: float = 1.0) -> DataFrame:
    """One of FILTERS by the published formulas (Lee 1980, 1981, 1983; Frost 1982; Lopes 1990; Vasile 2006). Unknown names raise ValueError.

    Refined Lee and IDAN look at 7 x 7 cells at least.
    """
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name!r}")
    if name == "None":
        return raster
    if name == "Boxcar":
        return boxcar(raster, kx, ky)
    if name in ("Refined Lee", "IDAN"):
        kx = ky = max(kx, ky, 7)
    one, p = KERNELS[name], {"damping": damping, "edge_threshold": edge_threshold, "enl": enl}
    return by_tiles(raster, ky // 2, kx // 2, lambda grid: one(*_window(grid, ky, kx), p))


def clahe(raster: DataFrame, rows: int, cols: int, tile: int = 8, clip: float = 0.03, bins: int = 256) -> DataFrame:
    """Contrast-limited adaptive histogram equalisation (Zuiderveld, 1994) to 0..1: clipped histograms of tile x tile cells, blended bilinearly between tile centres.

    Histograms are aggregates of the tiles; each pixel meets those of its four nearest tiles by joins on the tile.
    """
    stats = raster.groupBy("raster_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    n_r, n_c = -(-rows // tile), -(-cols // tile)
    binned = raster.join(stats, "raster_id").withColumn("bin", F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col("value") - F.col("low")) * bins, F.nullif(F.col("high") - F.col("low"), F.lit(0.0))))), F.lit(0)).cast("int"))
    counts = binned.groupBy("raster_id", F.floor(F.col("row") / tile).cast("int").alias("tr"), F.floor(F.col("col") / tile).cast("int").alias("tc"), "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("raster_id", "tr", "tc")
    limited = counts.withColumn("all", F.sum("n").over(by)).withColumn("kept", F.least(F.col("n").cast("double"), F.greatest(F.lit(1.0), F.col("all") * clip)))
    curve = limited.withColumn("excess", F.col("all") - F.sum("kept").over(by)).withColumn("cdf", (F.sum("kept").over(by.orderBy("bin")) + F.col("excess") * (F.col("bin") + 1) / bins) / F.col("all"))
    curves = curve.groupBy("raster_id", "tr", "tc").agg(F.map_from_entries(F.collect_list(F.struct("bin", "cdf"))).alias("curve"))
    fr, fc = (F.col("row") + 0.5) / tile - 0.5, (F.col("col") + 0.5) / tile - 0.5
    corner = lambda f, n: F.array(F.struct(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(f).cast("int"))).alias("t"), (1 - (f - F.floor(f))).alias("w")), F.struct(F.greatest(F.lit(0), F.least(F.lit(n - 1), (F.floor(f) + 1).cast("int"))).alias("t"), (f - F.floor(f)).alias("w")))
    spread = binned.withColumn("a", F.explode(corner(fr, n_r))).withColumn("b", F.explode(corner(fc, n_c))).select("raster_id", "band", "row", "col", "bin", F.col("a.t").alias("tr"), F.col("b.t").alias("tc"), (F.col("a.w") * F.col("b.w")).alias("w"))
    level = F.aggregate(F.map_entries("curve"), F.lit(0.0), lambda s, e: F.when(e["key"] <= F.col("bin"), F.greatest(s, e["value"])).otherwise(s))
    return spread.join(curves, ["raster_id", "tr", "tc"]).groupBy("raster_id", "band", "row", "col").agg((F.sum(F.col("w") * level) / F.sum("w")).alias("value"))
