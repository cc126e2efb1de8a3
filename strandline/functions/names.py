"""File names, parameters and labels as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameter(prefix: Column, value: Column, text: bool = True) -> Column:
    """A command-line parameter; text values are quoted."""
    return F.format_string('-%s="%s"' if text else "-%s=%s", prefix, value.cast("string"))


def number_of(name: Column) -> Column:
    """The first number in a name, as text; "" without one."""
    return F.regexp_extract(name, r"(\d+)", 1)


def stage_file(name: Column, stem: str) -> Column:
    """Name of a stage's output: the stem and the number of its input."""
    return F.concat(F.lit(stem), number_of(name), F.lit(".out"))


def by_digits(files: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(rows whose name holds a digit, the others)."""
    has = F.col(name).rlike(r"[0-9]")
    return files.where(has), files.where(~has)


def labels(first: Column, last: Column, count: int, decimals: int) -> Column:
    """``count`` even steps between two coordinates as labels, rounded, or without decimals cut to whole numbers."""
    ticks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: first + i * (last - first) / (count - 1))
    return F.transform(ticks, lambda v: F.round(v, decimals).cast("string") if decimals > 0 else v.cast("long").cast("string"))


def ticks(n: Column, count: int) -> Column:
    """``count`` even steps from 0 to ``n``."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: i * n / F.lit(count - 1))


#: Kinds of raster files by the ends of their names.
KINDS = {"GeoTIFF": r"\.tiff?$", "NetCDF": r"\.nc$", "ENVISAT": r"\.n1$", "ERS1/2": r"\.e[12]$", "SENTINEL-1": r"(?:\.safe|manifest\.safe)$", "TSX": r"\.xml$", "zip": r"\.zip$"}


def kind_of(path: Column) -> Column:
    """Kind of a raster file by the end of its name; "unknown" for others."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    found = F.when(F.lit(False), "")
    for kind, pattern in KINDS.items():
        found = found.when(name.rlike(pattern), kind)
    return found.otherwise("unknown")
