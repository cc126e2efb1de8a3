"""Scalar functions of waves, angles and signals, as Spark columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import G

TWO_PI = 2 * pi


def degrees(x: Column) -> Column:
    return F.degrees(x)


def nautical(angle: Column) -> Column:
    """Cartesian to nautical degrees, 0 to 360."""
    return F.pmod(F.lit(450.0) - angle, F.lit(360.0))


def deep_water_period(wavelength: Column) -> Column:
    return F.sqrt(TWO_PI * wavelength / G)


def wave_period(wavelength: Column, depth: Column) -> Column:
    """Period from wavelength and depth; from kh = 3 on the deep-water one."""
    kh = TWO_PI * depth / wavelength
    return F.when(kh < 3, F.sqrt(TWO_PI * wavelength / G / F.tanh(kh))).otherwise(deep_water_period(wavelength))


def depth_estimate(wavelength: Column, period: Column) -> Column:
    """Depth from wavelength and period; null where the linear relation has no solution or an infinite one."""
    ratio = F.try_divide(TWO_PI * wavelength, F.nullif(G * period * period, F.lit(0.0)))
    return F.when(F.abs(ratio) < 1, F.atanh(ratio) * wavelength / TWO_PI)


def depth_flag(wavelength: Column, bathymetry: Column) -> Column:
    """0 deep (kh > 3), -1 shallow (kh < 0.3), 0.5 quasi-deep (1.5 < kh < 3), else 1, as for nulls and NaN. Bathymetry is negative down."""
    kh = F.try_divide(-bathymetry * TWO_PI, F.nullif(wavelength, F.lit(0.0)))
    return F.when(kh.isNull() | F.isnan(kh), 1.0).when(kh > 3, 0.0).when(kh < 0.3, -1.0).when((kh > 1.5) & (kh < 3), 0.5).otherwise(1.0)


def rayleigh(x: Column, c0: float, c1: float) -> Column:
    return F.lit(c0 / c1**2) * x * F.exp(-x * x / (2 * c1**2))


def chi(x: Column, k: float) -> Column:
    """Chi density of k degrees of freedom; gamma is a constant of the plan."""
    from math import gamma

    return F.pow(x, F.lit(k - 1)) * F.exp(-x * x / 2) / F.lit(2 ** (k / 2 - 1) * gamma(k / 2))


def sine(theta: Column, a: float, b: float, c: float) -> Column:
    return a * F.sin(TWO_PI * (theta + b) / 180) + c


def positive_sine(theta: Column, a: float, b: float, c: float) -> Column:
    return F.greatest(sine(theta, a, b, c), F.lit(float(c)))


def half_squares(observed: Column, expected: Column) -> Column:
    """Half of the sum of squared differences of two arrays."""
    return F.aggregate(F.zip_with(observed, expected, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / 2


def along(distance: Column, slope: Column) -> tuple[Column, Column]:
    dx = distance * F.sqrt(slope * slope + 1)
    return dx, slope * dx


def power_of_two(n: Column) -> Column:
    return F.rint(F.log2(n)).cast("int")


def padded_length(rows: Column, cols: Column, extra: int) -> Column:
    return F.pow(F.lit(2.0), F.greatest(power_of_two(rows), power_of_two(cols)) + extra).cast("long")


def phase(x: Column, y: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def ambiguity(first: Column, second: Column, coast: float) -> Column:
    """Mean direction of two opposite peaks, taken as the one of d and d + 180 that is nearer to the coast's normal."""
    low, high = F.least(first, second), F.greatest(first, second)
    d = 0.5 * (low + F.pmod(high + 180, F.lit(360.0)))
    turned = F.pmod(d + 180, F.lit(360.0))
    gap = lambda a: F.least(F.abs(a - coast), 360 - F.abs(a - coast))
    return F.when(gap(d) <= gap(turned), d).otherwise(turned)


def butterworth(x: Column, y: Column, angle: float, a: float = 0.125, b: float = 0.05, order: int = 2) -> Column:
    """Elliptic Butterworth response at frequencies x, y, its long axis turned by ``angle`` degrees."""
    from math import cos, radians, sin

    c, s = cos(radians(angle)), sin(radians(angle))
    u, v = x * c + y * s, -x * s + y * c
    return 1 / (1 + F.pow(u * u / a**2 + v * v / b**2, F.lit(order)))


def anomaly_parameters(orientation: Column) -> Column:
    """Struct (flip, transpose) of a coast orientation in degrees."""
    pair = lambda a, b: F.struct(F.lit(a).alias("flip"), F.lit(b).alias("transpose"))
    return F.when(orientation.between(225, 315), pair(False, True)).when(orientation.between(45, 135), pair(False, False)).when((orientation > 135) & (orientation < 225), pair(True, True)).otherwise(pair(True, False))


def index_of_name(name: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"(\d+)", 1).try_cast("int")


def epsg_code(text: Column) -> Column:
    return text.try_cast("double").cast("int")
