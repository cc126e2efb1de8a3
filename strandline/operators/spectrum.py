"""Spectra of image boxes and profiles: NumPy kernels per box inside Arrow batches; one box is one bounded row."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boxes(pixels: DataFrame) -> DataFrame:
    """(point_id, box_id, n, image): each box's pixels as one row-major array; incomplete boxes are left out."""
    g = pixels.groupBy("point_id", "box_id").agg(F.sort_array(F.collect_list(F.struct("r", "c", "value"))).alias("p"), (F.max("r") + 1).alias("n"))
    return g.where(F.size("p") == F.col("n") * F.col("n")).select("point_id", "box_id", "n", F.transform("p", lambda x: x["value"]).alias("image"))


def power(image: np.ndarray, squared: bool = True) -> np.ndarray:
    """Centred spectrum of the image without its mean."""
    f = np.abs(np.fft.fftshift(np.fft.fft2(image - image.mean())))
    return f * f if squared else f


def radial(image: np.ndarray) -> np.ndarray:
    """Mean by rounded distance from the centre."""
    n = image.shape[0]
    y, x = np.indices(image.shape) - n // 2
    r = np.rint(np.hypot(x, y)).astype(int)
    return np.bincount(r.ravel(), image.ravel()) / np.bincount(r.ravel())


def directions(image: np.ndarray) -> np.ndarray:
    """Mean of the non-zero values by whole degrees, 0 to 360."""
    n = image.shape[0]
    y, x = np.indices(image.shape) - n // 2
    theta = np.rint(np.degrees(np.arctan2(-y, x)) % 360).astype(int).ravel()
    v = image.ravel()
    return np.bincount(theta, v, 361) / np.maximum(np.bincount(theta, v != 0, 361), 1)


def band_mask(spectrum: np.ndarray, resolution: float, wavelength: float) -> np.ndarray:
    """True outside of the circle of the wavelength's wave number."""
    n = spectrum.shape[0]
    y, x = np.indices(spectrum.shape) - n // 2
    return np.hypot(x, y) > round((2 * pi / wavelength) / (2 * pi / (n * resolution)))


def centroid(x: np.ndarray, y: np.ndarray, exponent: float, ratio: float) -> float:
    """Centroid of the part above ``ratio`` of the peak, weighted by a power."""
    kept = y > ratio * y.max()
    w = y[kept] ** exponent
    return float((x[kept] * w).sum() / w.sum()) if w.sum() else float("nan")


def peak(x: np.ndarray, y: np.ndarray, method: str = "max", exponent: float = 1.0, ratio: float = 0.2) -> float:
    """Position of the peak: max, centroid, cluster (two seeded Lloyd clusters, the heavier one) or fit (Rayleigh density by a simplex)."""
    if method == "max":
        return float(x[int(np.argmax(y))])
    if method == "centroid":
        return centroid(x, y, exponent, ratio)
    if method == "cluster":
        kept = y > ratio * y.max()
        px, w = x[kept], y[kept]
        c = np.array([px.min(), px.max()], float)
        for _ in range(50):
            label = np.abs(px[:, None] - c).argmin(1)
            c = np.array([np.average(px[label == i], weights=w[label == i]) if (label == i).any() else c[i] for i in (0, 1)])
        return float(c[int(np.argmax([w[label == i].sum() for i in (0, 1)]))])
    if method == "fit":
        model = lambda c: 0.5 * (((c[0] / c[1] ** 2) * x * np.exp(-(x**2) / (2 * c[1] ** 2)) - y / y.max()) ** 2).sum()
        return float(abs(_simplex(model, np.array([1.0, max(float(x.mean()), 1e-6)]))[1]))
    raise ValueError(f"unknown method {method!r}")


def _simplex(f, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """Downhill simplex of Nelder and Mead."""
    points = [start, *[start + np.eye(len(start))[i] * (0.05 * start[i] or 0.00025) for i in range(len(start))]]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-12:
            break
        middle = np.mean(points[:-1], axis=0)
        tried = middle + (middle - points[-1])
        value = f(tried)
        if value < values[0]:
            far = middle + 2 * (middle - points[-1])
            tried, value = min(((far, f(far)), (tried, value)), key=lambda t: t[1])
        elif value >= values[-2]:
            near = middle + 0.5 * (points[-1] - middle)
            tried, value = near, f(near)
            if value >= values[-1]:
                points = [points[0] + 0.5 * (p - points[0]) for p in points]
                values = [f(p) for p in points]
                continue
        points[-1], values[-1] = tried, value
    return points[int(np.argmin(values))]


def halves(theta: np.ndarray, values: np.ndarray, normal: float) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the half planes within 90 degrees of the coast's normal and of its opposite."""
    gap = np.abs((theta - normal + 180) % 360 - 180)
    return gap <= 90, gap >= 90


def wave_direction(spectrum: np.ndarray, coast: float = 270.0, exponent: float = 1.0, ratio: float = 0.2) -> float:
    """Nautical direction of the waves: a peak in each half plane, averaged over the half turn, and the one of both senses that is nearer to the coast's normal."""
    values = directions(spectrum)
    nautical = (450 - np.arange(361)) % 360
    found = []
    for half in halves(nautical, values, coast):
        gap = (nautical[half] - coast + 180) % 360 - 180 if not found else (nautical[half] - coast) % 360 - 180
        found.append(centroid(gap, values[half], exponent, ratio))
    d = np.nanmean(found) + coast
    return float(d % 360)


def butterworth(n: int, angle: float, a: float = 0.125, b: float = 0.05, order: int = 2) -> np.ndarray:
    y, x = (np.indices((n, n)) - n // 2) / n
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    return 1 / (1 + (((x * c + y * s) / a) ** 2 + ((-x * s + y * c) / b) ** 2) ** order)


def filtered(image: np.ndarray, angle: float) -> np.ndarray:
    f = np.fft.fftshift(np.fft.fft2(image)) * butterworth(image.shape[0], angle)
    return np.abs(np.fft.ifft2(np.fft.ifftshift(f)))


def profiles(image: np.ndarray, direction: float, count: int, offset: float) -> list[np.ndarray]:
    """The central profile and ``count`` (made even) parallel ones, by bilinear samples a pixel apart."""
    n = image.shape[0]
    c, angle = (n - 1) / 2, np.radians(450 - direction)
    ux, uy = np.cos(angle), -np.sin(angle)
    t = np.arange(-(n // 2) + 1, n // 2)
    found = []
    for k in range(-(count + count % 2) // 2, (count + count % 2) // 2 + 1):
        x, y = c + t * ux - k * offset * uy, c + t * uy + k * offset * ux
        ok = (x >= 0) & (y >= 0) & (x <= n - 1) & (y <= n - 1)
        x, y = x[ok], y[ok]
        i, j = np.minimum(y.astype(int), n - 2), np.minimum(x.astype(int), n - 2)
        u, v = x - j, y - i
        found.append(image[i, j] * (1 - u) * (1 - v) + image[i, j + 1] * u * (1 - v) + image[i + 1, j] * (1 - u) * v + image[i + 1, j + 1] * u * v)
    return found


def spectrum1d(profile: np.ndarray, length: int, resolution: float = 1.0, squared: bool = True) -> tuple[np.ndarray, np.ndarray]:
    f = np.abs(np.fft.rfft(profile - profile.mean(), length))
    return 2 * pi * np.fft.rfftfreq(length, resolution), f * f if squared else f


def image_spectra(boxes_: DataFrame, squared: bool = True) -> DataFrame:
    """(point_id, box_id, r, c, p): centred power (or magnitude) of each box of ``boxes``, cell by cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for pid, bid, n, image in zip(f["point_id"], f["box_id"], f["n"], f["image"], strict=True):
                p = power(np.asarray(image, float).reshape(n, n), squared)
                r, c = np.indices(p.shape)
                yield pd.DataFrame({"point_id": pid, "box_id": bid, "r": r.ravel(), "c": c.ravel(), "p": p.ravel()})

    return boxes_.mapInPandas(run, "point_id long, box_id int, r int, c int, p double")


def filtered_images(boxes_: DataFrame, angle: float) -> DataFrame:
    """(point_id, box_id, r, c, value): each box filtered along a direction, cell by cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for pid, bid, n, image in zip(f["point_id"], f["box_id"], f["n"], f["image"], strict=True):
                v = filtered(np.asarray(image, float).reshape(n, n), angle)
                r, c = np.indices(v.shape)
                yield pd.DataFrame({"point_id": pid, "box_id": bid, "r": r.ravel(), "c": c.ravel(), "value": v.ravel()})

    return boxes_.mapInPandas(run, "point_id long, box_id int, r int, c int, value double")


def compute(boxes_: DataFrame, method: str = "Radial", resolution: float = 1.0, coast: float = 270.0, count: int = 5, offset: float = 1.0, longest: float = 500.0, filter_: bool = True) -> DataFrame:
    """(point_id, box_id, direction, k, s): spectrum of each box. Radial: filter along the waves, mask, radial mean. Waves: mean of the spectra of parallel profiles, weighted by nearness."""
    if method not in ("Radial", "Waves"):
        raise ValueError(f"unknown method {method!r}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for pid, bid, n, image in zip(f["point_id"], f["box_id"], f["n"], f["image"], strict=True):
                image = np.asarray(image, float).reshape(n, n)
                s = power(image)
                d = wave_direction(np.where(band_mask(s, resolution, longest), s, 0), coast)
                if filter_:
                    image = filtered(image, 450 - d)
                if method == "Radial":
                    line = radial(power(image))[: n // 2]
                    k = np.arange(len(line)) * 2 * pi / (n * resolution)
                else:
                    lines = profiles(image, d, count, offset)
                    length = 2 ** (int(round(np.log2(n))) + 1)
                    weights = 1 / (1 + np.abs(np.arange(len(lines)) - len(lines) // 2))
                    spectra = [spectrum1d(p, length, resolution) for p in lines if len(p) > 1]
                    k, line = spectra[0][0], np.average([x[1] for x in spectra], axis=0, weights=weights[: len(spectra)])
                out.append((pid, bid, d, k.tolist(), line.tolist()))
            yield pd.DataFrame(out, columns=["point_id", "box_id", "direction", "k", "s"])

    return boxes_.mapInPandas(run, "point_id long, box_id int, direction double, k array<double>, s array<double>")


def mean_spectrum(spectra: DataFrame) -> DataFrame:
    """(point_id, direction, k, s, s_std): over a point's boxes, of which there are at most nine."""
    one = spectra.select("point_id", "direction", F.posexplode(F.arrays_zip("k", "s")).alias("i", "x"))
    bins = one.groupBy("point_id", "i").agg(F.avg("x.k").alias("k"), F.avg("x.s").alias("s"), F.stddev_pop("x.s").alias("std"), F.avg("direction").alias("direction"))
    g = bins.groupBy("point_id").agg(F.first("direction").alias("direction"), F.sort_array(F.collect_list(F.struct("i", "k", "s", "std"))).alias("x"))
    return g.select("point_id", "direction", *[F.transform("x", _field(c)).alias(n) for c, n in (("k", "k"), ("s", "s"), ("std", "s_std"))])


def _field(name: str):
    return lambda x: x[name]


def wavelength(k: Column, s: Column, exponent: int = 5, least_k: float = 0.01) -> Column:
    """2 pi over the centroid wave number of an array spectrum, values weighted by a power."""
    pairs = F.filter(F.arrays_zip(k.alias("k"), s.alias("s")), lambda p: p["k"] > least_k)
    top = F.aggregate(pairs, F.lit(0.0), lambda a, p: F.greatest(a, p["s"]))
    w = lambda p: F.pow(F.try_divide(p["s"], F.nullif(top, F.lit(0.0))), F.lit(exponent))
    return F.try_divide(F.lit(2 * pi) * F.aggregate(pairs, F.lit(0.0), lambda a, p: a + w(p)), F.nullif(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["k"] * w(p)), F.lit(0.0)))


def centroid_of(x: Column, y: Column, exponent: float, ratio: float) -> Column:
    """Centroid of the part of an array above ``ratio`` of its peak, weighted by a power."""
    pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["y"] > ratio * F.array_max(y))
    w = lambda p: F.pow(p["y"], F.lit(exponent))
    return F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["x"] * w(p)), F.nullif(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + w(p)), F.lit(0.0)))


def outside(row: Column, col: Column, n: int, resolution: float, wavelength: float) -> Column:
    """Whether a cell of a centred n x n spectrum lies outside of the circle of the wavelength's wave number."""
    y, x = row.cast("double") - n // 2, col.cast("double") - n // 2  # squares of whole cells would overflow
    return F.sqrt(x * x + y * y) > F.rint(F.lit((2 * pi / wavelength) / (2 * pi / (n * resolution))))


def dft(series: DataFrame, n: int) -> DataFrame:
    """(key, f, p): power of the first n/2 + 1 frequencies of (key, i, v) without its mean, as a sum over samples: each sample is exploded to the frequencies, whose number is fixed."""
    from pyspark.sql.window import Window

    centred = series.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("key")))
    angle = F.lit(-2 * pi / n) * F.col("f") * F.col("i")
    spread = centred.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n // 2))))
    g = spread.groupBy("key", "f").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    return g.select("key", "f", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
