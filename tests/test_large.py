"""What must hold far from the origin and on rasters and layers that grow."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import lines
from strandline.operators import gridding, spectrum, stats
from strandline.sources import files
from test_goldens import cells


def test_distances_of_far_ends(spark):
    ends = spark.range(1).select(F.struct(*[F.lit(v).alias(n) for n, v in (("x1", -2_000_000_000), ("y1", 0), ("x2", 1_000_000_000), ("y2", 47))]).alias("e"))
    got = ends.select(lines.distances(F.col("e"), F.lit(5), 10.0)).first()[0]
    assert got == [i * (3e9**2 + 47**2) ** 0.5 * 10 / 4 for i in range(5)]


def test_radial_profile_of_far_rows(spark):
    far = spark.createDataFrame([("r", 1, 60_000, 40, 3.0), ("r", 1, 60_000, 60, 5.0), ("r", 1, 50, 51, 8.0)], "raster_id string, band int, row int, col int, value double")
    profile = stats.radial_profile(far, 50, 50)
    assert sorted(map(tuple, profile.collect())) == [(1, 8.0, 1), (59_950, 4.0, 2)]
    assert stats.influence_radius(profile, 0.01).first()["peak"] == 1


def test_band_of_far_rows(spark):
    cells = spark.createDataFrame([(60_000, 50), (50, 57), (50, 58)], "row int, col int")
    assert [r[0] for r in cells.select(spectrum.outside(F.col("row"), F.col("col"), 100, 10.0, 150.0)).collect()] == [True, False, True]


def test_points_of_one_position_meet_nodes_once(spark, monkeypatch):
    points = spark.range(5000).select(F.col("id").alias("fid"), *[(F.col("id") * k % n).cast("double").alias(c) for c, k, n in (("x", 7, 10), ("y", 3, 5))], (F.col("id") * 31 % 1009).cast("double").alias("z"))
    nodes, known, met, pairs = gridding.grid(spark, 3, 2, 0, 0, 9, 6), points.collect(), [], gridding._pairs
    monkeypatch.setattr(gridding, "_pairs", lambda nodes, points, radius: met.append(points.count()) or pairs(nodes, points, radius))
    for r in (None, 4.0):
        near = cells(gridding.nearest(nodes, points, r))
        four = cells(gridding.invdist_nearest(nodes, points, 4, 2.0, r or 20.0))
        for node in nodes.collect():
            d = sorted(((node["gx"] - p["x"]) ** 2 + (node["gy"] - p["y"]) ** 2, p["fid"], p["z"]) for p in known)[:4]
            at = node["row"], node["col"]
            assert near[at] == d[0][2] and abs(four[at] - (d[0][2] if d[0][0] == 0 else sum(z / q for q, _, z in d) / sum(1 / q for q, _, _ in d))) < 1e-9
    assert max(met) <= 4 * 10


def test_tiff_of_many_strips(spark, monkeypatch):
    image = np.random.default_rng(3).gamma(2, 60, (2, 23, 7)).astype("f4").astype(float)
    image[np.random.default_rng(4).random(image.shape) < 0.1] = np.nan
    image[1, 10:15] = np.nan
    schema = "raster_id string, band int, row int, col int, value double"
    pixels = spark.createDataFrame([(n, b + 1, r, c, float(v)) for n in "ab" for (b, r, c), v in np.ndenumerate(image) if not np.isnan(v)], schema)
    monkeypatch.setattr(files, "STRIP", 40, raising=False)
    for options in ({}, {"kind": "u1", "nodata": 255, "epsg": 32629, "gt": [10.0, 2.0, 50.0, -2.0]}):
        written = files.export_tiff(pixels, 23, 7, 2, **options)
        contents = {r["raster_id"]: bytes(r["content"]) for r in written.collect()}
        assert sorted(contents) == ["a", "b"] and set(contents.values()) == {files.encode_tiff(image, **options)}
        back, gt = files.decode_tiff(contents["a"])
        assert gt == options.get("gt") and np.array_equal(back, np.where(np.isnan(image), 255, np.rint(image).clip(0, 255)) if options else image, equal_nan=True)
        at = struct.unpack("<I", contents["a"][4:8])[0]
        entries = [struct.unpack("<HHI", contents["a"][i : i + 8]) for i in range(at + 2, at + 2 + 12 * struct.unpack("<H", contents["a"][at : at + 2])[0], 12)]
        assert {tag: n for tag, _, n in entries}[273] == 2 * 5  # strips
        read = {(r["raster_id"], r["band"] - 1, r["row"], r["col"]): r["value"] for r in files.decode_rasters(written).collect()}
        assert len(read) == 2 * image.size and all(v is None if np.isnan(back[k[1:]]) else v == back[k[1:]] for k, v in read.items())
    for rows, cols in ((22, 7), (23, 6), (20, 7)):
        with pytest.raises(Exception, match="IndexError"):
            files.export_tiff(pixels, rows, cols, 2).collect()
