"""Straight lines through image boxes, and the profiles along them; angles in degrees, places in cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line(direction: Column, x: Column, y: Column, orthogonal: bool = False) -> Column:
    """Struct (slope, offset) of the line through (x, y) in a direction, or at a right angle to it."""
    slope = F.tan(F.radians(direction))
    slope = -1 / slope if orthogonal else slope
    return F.struct(slope.alias("slope"), (y - slope * x).alias("offset"))


def heights(drawn: Column, n: Column) -> Column:
    """The line's y at x = 0 to n - 1."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda x: drawn["slope"] * x + drawn["offset"])


def offsets(x: Column, y: Column, direction: Column, distance: float, count: int, xres: float, yres: float) -> Column:
    """Array of structs (x, y): the centre, then pairs of points on either side of it, ever ``distance`` metres further across the direction. An odd ``count`` loses its last."""
    angle = F.radians(direction + 90)
    dx, dy = distance * F.cos(angle) / xres, distance * F.sin(angle) / yres
    steps = [0, *[s * k for k in range(1, count // 2 + 1) for s in (1, -1)]]
    return F.array(*[F.struct((x + k * dx).alias("x"), (y + k * dy).alias("y")) for k in steps])


def edges(drawn: Column, rows: int, cols: int) -> Column:
    """Struct (x1, y1, x2, y2): where the line enters and leaves a box, in whole cells; rows bound x and columns y."""
    first, last = drawn["offset"], drawn["slope"] * (rows - 1) + drawn["offset"]
    low, high = F.least(first, last), F.greatest(first, last)
    top = F.lit(cols - 1)
    cell = lambda c: F.rint(c).cast("int")
    return F.struct(
        F.when(low < 0, cell(-drawn["offset"] / drawn["slope"])).otherwise(0).alias("x1"),
        F.when(low < 0, 0).otherwise(cell(drawn["offset"])).alias("y1"),
        F.when(high > top, cell((top - drawn["offset"]) / drawn["slope"])).otherwise(rows - 1).alias("x2"),
        F.when(high > top, top).otherwise(cell(last)).alias("y2"),
    )


def zero_padded(y: Column, n: int) -> Column:
    """The values followed by zeros, ``n`` in all."""
    return F.concat(y, F.array_repeat(F.lit(0.0), n - F.size(y)))


def extended(x: Column, n: int) -> Column:
    """``n`` even steps from 0 by the mean step of an ascending axis."""
    step = (F.element_at(x, -1) - F.element_at(x, 1)) / (F.size(x) - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * step)


def distances(ends: Column, n: Column, cell: float) -> Column:
    """``n`` even steps along the line between two ends, in metres."""
    dx, dy = (ends[b].cast("double") - ends[a].cast("double") for a, b in (("x1", "x2"), ("y1", "y2")))  # squares of whole cells would overflow
    length = F.sqrt(dx * dx + dy * dy)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_divide(i * length * cell, (n - 1).cast("double")), F.lit(0.0)))


def spectrum_range(kx: Column, ky: Column, centre: Column, radius: Column, margin: int = 10) -> Column:
    """Greatest wave number within ``radius`` and a margin around the centre of two axes; the window ends at the axes' ends."""

    def top(k: Column) -> Column:
        low = F.greatest(F.floor(centre - radius - margin).cast("int"), F.lit(0))
        high = F.least(F.floor(centre + radius + margin).cast("int"), F.size(k))
        return F.array_max(F.slice(k, low + 1, F.greatest(high - low, F.lit(0))))

    return F.greatest(F.abs(top(kx)), F.abs(top(ky)))


def half_domains(values: DataFrame, angle: float) -> DataFrame:
    """(key, part, theta, v) of (key, theta, v): the half plane between both directions at right angles to ``angle`` and the other one, whose angles go on beyond 360. Equal angles of a part count once, the first of them as given."""
    low, high = sorted(((angle - 90) % 360, (angle + 90) % 360))
    first = values.where(F.col("theta").between(low, high)).select("key", F.lit(1).alias("part"), "theta", "v")
    upper = values.where(F.col("theta") >= high).select("key", F.lit(0).alias("turn"), "theta", "v")
    lower = values.where(F.col("theta") <= low).select("key", F.lit(1).alias("turn"), (F.col("theta") + 360).alias("theta"), "v")
    second = upper.unionAll(lower).groupBy("key", "theta").agg(F.min_by("v", "turn").alias("v"))
    return first.unionAll(second.select("key", F.lit(2).alias("part"), "theta", "v"))
