import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import catalogue
from strandline.functions import waves
from strandline.operators import bathymetry, classify, mapalgebra, roi, spectrum, vector
from strandline.sources import files


def raster(spark, rows, name="r"):
    return spark.createDataFrame([(name, 1, r, c, float(v) if v is not None else None) for r, line in enumerate(rows) for c, v in enumerate(line)], "raster_id string, band int, row int, col int, value double")


def cells(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def test_ranges_are_strict_and_checked(spark):
    masked = cells(mapalgebra.mask(raster(spark, [[1, 2, 3], [4, 5, None]]), None, "1:3,4:"))
    assert masked == {(0, 0): 0, (0, 1): 2, (0, 2): 0, (1, 0): 0, (1, 1): 5, (1, 2): None}
    for bad in (":", "1", "a:b"):
        with pytest.raises(ValueError):
            mapalgebra.range_condition(F.col("value"), bad)


def test_split_of_stack_is_identity(spark):
    a, b = raster(spark, [[1, 2]]), raster(spark, [[3, 4]])
    assert cells(mapalgebra.split_band(mapalgebra.stack([(a, 1), (b, 1)]), 2)) == cells(b)


def test_regions_and_polygon(spark):
    rows = [(r["DN"], r["area"], r["perimeter"]) for r in vector.polygonize(raster(spark, [[1, 1, 2], [2, 1, 2], [1, 2, 2]])).collect()]
    assert sorted(rows) == [(1.0, 1, 4), (1.0, 3, 8), (2.0, 1, 4), (2.0, 4, 10)]
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 1.0, 1.0), (3, 3.0, 3.0)], "fid long, x double, y double")
    assert {r["fid"] for r in roi.within(points, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]).collect()} == {0, 1, 2}


def test_dispersion_round_trip(spark):
    df = spark.createDataFrame([(100.0, 10.0), (200.0, 30.0), (60.0, 2.0)], "wavelength double, h double")
    back = df.select(F.abs(waves.depth_estimate(F.col("wavelength"), waves.wave_period(F.col("wavelength"), F.col("h"))) - F.col("h")).alias("d")).collect()
    assert all(r["d"] < 1e-9 for r in back)
    flags = spark.createDataFrame([(2 * np.pi, -3.0), (2 * np.pi, float("nan")), (2 * np.pi, -4.0), (2 * np.pi, -0.1), (2 * np.pi, -2.0)], "wavelength double, apriori_bathymetry double")
    assert [r["flag"] for r in bathymetry.classify(flags).collect()] == [1.0, 1.0, 0.0, -1.0, 0.5]


def test_isodata_recovers_separated_values(spark):
    px = raster(spark, [[10.0] * 40 + [200.0] * 40 + [0.0] * 5] * 3)
    got, centres = classify.isodata(px, classify.Isodata(k=2))
    assert len(centres) == 2 and {r["cls"] for r in got.where("value = 0").collect()} == {-1}
    assert len({r["cls"] for r in got.where("value > 0").collect()}) == 2


def test_wkt(spark):
    row = spark.range(1).select(vector.wkt_point(F.lit(10), F.lit(20)).alias("p"), F.size(vector.parse_wkt_points(F.lit("POLYGON ((0 0 0,1 0 0,1 1 0))"))).alias("n"), vector.parse_wkt_points(F.lit("NONSENSE (1 2)")).alias("x")).first()
    assert row["p"] == "POINT (10 20 0)" and row["n"] == 3 and row["x"] is None


def test_spectra():
    image = np.sin(2 * np.pi * 4 * np.arange(32) / 32)[None, :].repeat(32, 0)
    assert int(np.argmax(spectrum.radial(spectrum.power(image))[:16])) == 4
    assert spectrum.peak(np.arange(5.0), np.array([0, 1, 5, 1, 0.0]), "centroid") == 2.0
    with pytest.raises(ValueError):
        spectrum.peak(np.arange(3.0), np.ones(3), "other")


def test_tiff_round_trip(spark, tmp_path):
    image = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    data = files.encode_tiff(image, [1.0, 2.0, 3.0, -2.0])
    back, gt = files.decode_tiff(data)
    assert (back == image).all() and gt == [1.0, 2.0, 3.0, -2.0]
    (tmp_path / "a.tif").write_bytes(data)
    assert files.scan_tiff(spark, str(tmp_path)).agg(F.sum("value")).first()[0] == image.sum()


def test_tsv(spark, tmp_path):
    (tmp_path / "t.txt").write_text("ID\tLongitude\tLatitude\n1\t-127.234343\t47.234325\n2\t-127.003243\t46.234343")
    rows = vector.create_vector(files.scan_tsv(spark, str(tmp_path / "t.txt"))).orderBy("fid").collect()
    assert rows[0]["wkt"] == "POINT(-127.234343 47.234325)" and rows[1]["ID"] == 2.0


def test_rbf_merges_positions_of_the_whole_view(spark, tmp_path):
    spark.range(2500).selectExpr("id + 1 AS c_custkey", "CAST(id * id % 977 AS DOUBLE) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(60).selectExpr("id + 1 AS p_partkey", "id % 50 + 1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["fid"]: r["value"] for r in catalogue.QUERIES["j7_rbf"](spark, str(tmp_path)).collect()}
    control = {}
    for i in range(2500):
        control.setdefault(((i + 1) * 37 % 360 - 180.0, (i + 1) * 53 % 180 - 90.0), []).append(i * i % 977)
    xy, z = np.array(list(control)), np.array([np.mean(v) for v in control.values()])
    epsilon = np.sqrt(np.prod(np.ptp(xy, axis=0)) / len(xy))
    distance = lambda a: np.sqrt(((a[:, None] - xy[None]) ** 2).sum(-1) / epsilon**2 + 1)
    targets = np.array([((i + 1) * 7 % 360 - 180.0, (i + 1) // 50 - 20.0) for i in range(60)])
    want = distance(targets) @ np.linalg.solve(distance(xy), z)
    assert len(got) == 60 and np.allclose([got[i + 1] for i in range(60)], want, rtol=1e-4, atol=0.1)
