"""Unsupervised ISODATA classification. Each round is one small aggregate over the value histogram; only centres reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialise


@dataclass(frozen=True)
class Isodata:
    """Parameters. ``swapped`` keeps the historic call in which the split's thresholds for deviation and count change places."""

    k: int = 15
    iterations: int = 100
    pairs: int = 2
    theta_m: float = 10
    theta_s: float = 0.1
    theta_c: float = 2
    theta_o: float = 0.01
    nodata: float = 0
    swapped: bool = True


def linspace(low: float, high: float, k: int) -> list[float]:
    return [low + i * (high - low) / (k - 1) for i in range(k)] if k > 1 else [low]


def assign(value: Column, centres: list[float]) -> Column:
    """Index of the nearest centre, the lowest of equals; centres ascend, so comparing with the midpoints would do, but distances keep ties exact."""
    distances = F.array(*[F.abs(value - F.lit(float(c))) for c in centres])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def histogram(raster: DataFrame, nodata: float | None = 0) -> DataFrame:
    kept = raster.where(F.col("value").isNotNull() if nodata is None else (F.col("value") != nodata))
    return kept.groupBy("value").agg(F.count("*").alias("n"))


def _sums(h: DataFrame, label: list[float], around: list[float] | None = None) -> dict[int, tuple]:
    cls = assign(F.col("value"), label)
    aggs = [F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("s")]
    rows = h.withColumn("cls", cls)
    if around is not None:
        centre = F.get(F.array(*[F.lit(float(c)) for c in around]), F.col("cls"))
        aggs += [F.sum(F.abs(F.col("value") - centre) * F.col("n")).alias("d"), F.sum((F.col("value") - centre) * (F.col("value") - centre) * F.col("n")).alias("q")]
    return {r["cls"]: tuple(r)[1:] for r in rows.groupBy("cls").agg(*aggs).collect()}


def initial_centres(raster: DataFrame, k: int) -> DataFrame:
    """(i, centre): ``k`` even steps from the least to the greatest value."""
    ends = raster.agg(F.min("value").alias("l"), F.max("value").alias("h"))
    return ends.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.col("l") + i * (F.col("h") - F.col("l")) / max(k - 1, 1))).alias("i", "centre"))


def cluster_stats(h: DataFrame, centres: list[float]) -> DataFrame:
    """(cls, n, centre, distance, std) of each cluster that values of a histogram (value, n) are nearest to: the new centre is sum / (n + 1), the mean distance from the old one has the same
    divisor, the deviation around it n."""
    old = F.get(F.array(*[F.lit(float(c)) for c in centres]), F.col("cls"))
    rows = h.withColumn("cls", assign(F.col("value"), centres)).withColumn("gap", F.col("value") - old)
    n = F.sum("n")
    return rows.groupBy("cls").agg(n.alias("n"), (F.sum(F.col("value") * F.col("n")) / (n + 1)).alias("centre"), (F.sum(F.abs("gap") * F.col("n")) / (n + 1)).alias("distance"), F.sqrt(F.sum(F.col("gap") * F.col("gap") * F.col("n")) / n).alias("std"))


def kept_clusters(clusters: DataFrame, least: float) -> DataFrame:
    """Clusters of more than ``least`` pixels."""
    return clusters.where(F.col("n") > least)


def overall_distance(clusters: DataFrame) -> DataFrame:
    """(distance): the clusters' mean distances, weighted by their pixels; one row."""
    return clusters.agg((F.sum(F.col("n") * F.col("distance")) / F.sum("n")).alias("distance"))


def centre_pairs(clusters: DataFrame) -> DataFrame:
    """(i, j, d): pairs of cluster centres, i > j, with their distance. Clusters are as few as the parameter k allows."""
    a, b = clusters.select(F.col("cls").alias("i"), F.col("centre").alias("x")), clusters.select(F.col("cls").alias("j"), F.col("centre").alias("y"))
    return a.join(F.broadcast(b), F.col("i") > F.col("j")).select("i", "j", F.abs(F.col("x") - F.col("y")).alias("d"))


def closest(pairs: DataFrame, most: int, below: float) -> DataFrame:
    """The ``most`` closest pairs, of equal ones the lowest, that are nearer than ``below``."""
    return pairs.orderBy("d", "i", "j").limit(most).where(F.col("d") < below)


def ranked(clusters: DataFrame) -> DataFrame:
    """Clusters by ascending centre: (rank, cls, centre). They are as few as the parameter k allows."""
    from pyspark.sql.window import Window

    return clusters.select((F.row_number().over(Window.orderBy("centre", "cls")) - 1).alias("rank"), "cls", "centre")


def isodata(raster: DataFrame, p: Isodata = Isodata()) -> tuple[DataFrame, list[float]]:
    """(raster with cls, centres of the last assignment). Nodata and null pixels are class -1.

    A cluster's centre is sum / (n + 1); clusters with at most theta_m pixels go; few clusters split, many merge.
    """
    h = materialise(histogram(raster, p.nodata), "histogram")
    low, high = h.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return raster.withColumn("cls", F.lit(-1)), []
    centres = label = linspace(low, high, p.k)
    for _ in range(p.iterations):
        last, label = centres, centres
        sums = _sums(h, centres)
        kept = [i for i in range(len(centres)) if sums.get(i, (0, 0))[0] > p.theta_m] or [max(sums, key=lambda i: sums[i][0])]
        centres = sorted(sums[i][1] / (sums[i][0] + 1) for i in kept)
        if len(centres) <= p.k / 2:
            centres = _split(h, centres, p)
        elif len(centres) > 2 * p.k:
            centres = _merge(h, centres, p)
        if len(last) == len(centres) and all(abs(a - b) / (abs(b) + 1) <= p.theta_o for a, b in zip(centres, last, strict=True)):
            break
    valid = F.col("value").isNotNull() & (F.col("value") != p.nodata)
    return raster.withColumn("cls", F.when(valid, assign(F.col("value"), label)).otherwise(-1)), label


def _split(h: DataFrame, centres: list[float], p: Isodata) -> list[float]:
    """Parts the cluster of the greatest deviation into centre -10 and +10 if it is wide, loose and populous."""
    deviation, count = (p.theta_m, p.theta_s) if p.swapped else (p.theta_s, p.theta_m)
    stats = _sums(h, centres, centres)
    total = sum(s[0] for s in stats.values())
    mean = {i: s[2] / (s[0] + 1) for i, s in stats.items()}
    overall = sum(stats[i][0] / total * mean[i] for i in stats)
    widest = max(stats, key=lambda i: stats[i][3] / stats[i][0])
    n, _, _, q = stats[widest]
    if (q / n) ** 0.5 > deviation and mean[widest] >= overall and n > 2 * count:
        return sorted([c for i, c in enumerate(centres) if i != widest] + [centres[widest] - 10, centres[widest] + 10])
    return centres


def closest_pairs(centres: list[float], most: int, below: float) -> list[tuple[int, int]]:
    """The ``most`` closest pairs (i > j) that are nearer than ``below``."""
    found = sorted((abs(centres[i] - centres[j]), i, j) for i in range(len(centres)) for j in range(i))[:most]
    return [(i, j) for d, i, j in found if d < below]


def _merge(h: DataFrame, centres: list[float], p: Isodata) -> list[float]:
    stats, gone, new = _sums(h, centres), set(), []
    for i, j in closest_pairs(centres, p.pairs, p.theta_c):
        if i not in gone and j not in gone:
            n1, n2 = (stats.get(x, (0, 0))[0] + 1 for x in (i, j))
            new.append(float(round((n1 * centres[i] + n2 * centres[j]) / (n1 + n2))))
            gone |= {i, j}
    return sorted([c for i, c in enumerate(centres) if i not in gone] + new)
