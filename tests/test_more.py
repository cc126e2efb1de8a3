"""Operators that SQL expresses badly or not at all, against plain Python or NumPy; and what must hold at the borders of tiles, blocks and files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.model import GeoTransform
from strandline.operators import classify, georef, graph, gridding, mapalgebra, neighborhood, roi, spectrum, vector
from strandline.plans import lineage, preparation
from strandline.sources import files
from strandline.streaming import stages
from test_goldens import cells, raster


def image(rows, cols, seed=1, gaps=0.1):
    rng = np.random.default_rng(seed)
    grid = rng.gamma(2, 60, (rows, cols))
    grid[rng.random((rows, cols)) < gaps] = np.nan
    return grid


def around(grid, r, c, half):
    return {(i - r, j - c): grid[i, j] for i in range(max(r - half, 0), min(r + half + 1, grid.shape[0])) for j in range(max(c - half, 0), min(c + half + 1, grid.shape[1])) if not np.isnan(grid[i, j])}


def estimate(x, v, enl):
    v = np.array(v)
    m, q = v.mean(), v.var()
    return m + (max(0, (q - m * m / enl) / (1 + 1 / enl)) / q if q else 0) * (x - m)


def refined_lee(grid, r, c, enl=1.0, threshold=5000.0):
    near, x = around(grid, r, c, 3), grid[r, c]
    v = list(near.values())
    if np.var(v) > threshold:
        best = None
        for a, b in ((0, 1), (1, 1), (1, 0), (1, -1)):
            up, down = ([y for (i, j), y in near.items() if s * (i * a + j * b) >= 0] for s in (1, -1))
            edge = round(abs(np.mean(up) - np.mean(down)), 9)
            if best is None or edge > best[0]:
                best = edge, up if abs(np.mean(up) - x) <= abs(np.mean(down) - x) else down
        v = best[1]
    return estimate(x, v, enl)


def idan(grid, r, c, enl=1.0):
    near = around(grid, r, c, 3)
    seed = np.median([y for (i, j), y in near.items() if abs(i) <= 1 and abs(j) <= 1])
    grown, todo = {(0, 0)}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
            if n in near and n not in grown and abs(near[n] - seed) <= 2 / 3 * abs(seed) * enl**-0.5:
                grown.add(n)
                todo.append(n)
    return estimate(grid[r, c], [near[n] for n in grown], enl)


@pytest.mark.parametrize("name, plain", [("Refined Lee", refined_lee), ("IDAN", idan), ("Median", lambda g, r, c: np.median(list(around(g, r, c, 1).values())))])
def test_filters_across_tiles(spark, monkeypatch, name, plain):
    monkeypatch.setattr(neighborhood, "TILE", 7)
    grid = image(16, 15)
    got = cells(neighborhood.speckle(raster(spark, [[None if np.isnan(x) else x for x in line] for line in grid]), name))
    assert len(got) == grid.size
    for (r, c), value in got.items():
        if np.isnan(grid[r, c]) and name != "Median":
            assert value is None
        elif around(grid, r, c, 1):
            assert abs(value - plain(grid, r, c)) < 1e-6


def test_regions_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILE", 4)
    grid = np.random.default_rng(3).integers(0, 3, (17, 14)).astype(float)
    grid[2:15, 5] = 7
    grid[9, :] = 7
    grid[4, 4] = np.nan
    label = np.full(grid.shape, -1)
    for start in range(grid.size):
        todo = [divmod(start, 14)] if label.flat[start] < 0 else []
        while todo:
            r, c = todo.pop()
            label[r, c] = start
            todo += [(i, j) for i, j in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if 0 <= i < 17 and 0 <= j < 14 and label[i, j] < 0 and grid[i, j] == grid[r, c]]
    found = {(r["row"], r["col"]): r["region"] for r in vector.regions(raster(spark, [[None if np.isnan(x) else x for x in line] for line in grid])).collect()}
    want = {(r, c): int(label[r, c] // 14) * 2**31 + int(label[r, c] % 14) for r in range(17) for c in range(14) if not np.isnan(grid[r, c])}
    assert found == want


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 5)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200), (None, 3)] + [(59, 300)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(60)} | {100 + i: 100 for i in range(41)} | {300: 0}
    for given in (frame, graph.contracted(frame)):
        assert {r["node"]: r["root"] for r in graph.components(given).collect()} == want


def test_gridding_of_many_nodes_and_far_points(spark, monkeypatch):
    monkeypatch.setattr(gridding, "BLOCK", 7)
    rng = np.random.default_rng(5)
    points = [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rng.integers(0, 20, (50, 3)))] + [(99, 500.0, 400.0, 7.0), (100, None, 1.0, 1.0)]
    frame, nodes = spark.createDataFrame(points, "fid long, x double, y double, z double"), gridding.grid(spark, 5, 4, 0, 0, 600, 500)
    known = [p for p in points if p[1] is not None]
    for r in nodes.collect():
        d = [((r["gx"] - x) ** 2 + (r["gy"] - y) ** 2, i, z) for i, x, y, z in known]
        assert cells(gridding.nearest(nodes.where(f"row = {r['row']} AND col = {r['col']}"), frame.where("x IS NOT NULL")))[r["row"], r["col"]] == min(d)[2] if r["col"] in (0, 4) else True
    got = cells(gridding.invdist(nodes, frame))
    assert len(got) == 20
    for r in nodes.collect():
        d = [((r["gx"] - x) ** 2 + (r["gy"] - y) ** 2, z) for _, x, y, z in known]
        assert abs(got[r["row"], r["col"]] - sum(z / q for q, z in d) / sum(1 / q for q, _ in d)) < 1e-9
    assert set(cells(gridding.average(nodes, frame.where("fid < 50"))).values()) == {float(np.mean([p[3] for p in points[:50]]))}
    assert gridding.nearest(nodes, frame.limit(0)).count() == 0


def test_percentiles_equal_numpy(spark):
    grid = image(30, 20, 8)
    row = mapalgebra.percentiles(raster(spark, [[None if np.isnan(x) else round(x) for x in line] for line in grid]), 0.02, 0.98).first()
    values = np.round(grid[~np.isnan(grid)])
    assert abs(row["low"] - np.percentile(values, 2)) < 1e-9 and abs(row["high"] - np.percentile(values, 98)) < 1e-9
    flat = mapalgebra.percentiles(raster(spark, [[3, 3, None]]), 0.02, 0.98).first()
    assert flat["low"] == flat["high"] == 3


def numpy_isodata(values, p):
    """The classification on all values at once."""
    v = values[values != p.nodata].astype(float)
    centres = label = list(np.linspace(v.min(), v.max(), p.k))
    for _ in range(p.iterations):
        last, label = centres, centres
        cls = np.abs(v[:, None] - np.array(centres)).argmin(1)
        sums = {i: (int((cls == i).sum()), v[cls == i].sum()) for i in range(len(centres))}
        centres = sorted(s / (n + 1) for n, s in sums.values() if n > p.theta_m)
        cls = np.abs(v[:, None] - np.array(centres)).argmin(1)
        if len(centres) <= p.k / 2:
            deviation, count = (p.theta_m, p.theta_s) if p.swapped else (p.theta_s, p.theta_m)
            parts = {i: v[cls == i] for i in range(len(centres)) if (cls == i).any()}
            mean = {i: np.abs(x - centres[i]).sum() / (len(x) + 1) for i, x in parts.items()}
            widest = max(parts, key=lambda i: np.sqrt(((parts[i] - centres[i]) ** 2).mean()))
            x = parts[widest]
            if np.sqrt(((x - centres[widest]) ** 2).mean()) > deviation and mean[widest] >= sum(len(parts[i]) / len(v) * mean[i] for i in parts) and len(x) > 2 * count:
                centres = sorted([c for i, c in enumerate(centres) if i != widest] + [centres[widest] - 10, centres[widest] + 10])
        elif len(centres) > 2 * p.k:
            pairs = sorted((abs(centres[i] - centres[j]), i, j) for i in range(len(centres)) for j in range(i))[: p.pairs]
            gone, new = set(), []
            for d, i, j in pairs:
                if d < p.theta_c and not {i, j} & gone:
                    n = [(cls == k).sum() + 1 for k in (i, j)]
                    new.append(float(round((n[0] * centres[i] + n[1] * centres[j]) / sum(n))))
                    gone |= {i, j}
            centres = sorted([c for i, c in enumerate(centres) if i not in gone] + new)
        if len(last) == len(centres) and all(abs(a - b) / (abs(b) + 1) <= p.theta_o for a, b in zip(centres, last, strict=True)):
            break
    return label


@pytest.mark.parametrize("p", [classify.Isodata(k=6, theta_m=3), classify.Isodata(k=10, theta_m=30), classify.Isodata(k=4, theta_m=1, swapped=False, theta_s=5), classify.Isodata(k=15)])
def test_isodata_equals_numpy(spark, p):
    rng = np.random.default_rng(p.k)
    grid = np.concatenate([np.round(rng.normal(m, s, n)) for m, s, n in ((40, 5, 300), (120, 20, 250), (300, 60, 250))]).reshape(20, 40)
    grid[0, :5] = 0
    got, centres = classify.isodata(raster(spark, grid), p)
    want = numpy_isodata(grid.ravel(), p)
    assert np.allclose(centres, want)
    for r in got.collect():
        assert r["cls"] == (-1 if r["value"] == 0 else int(np.abs(r["value"] - np.array(want)).argmin()))


def test_merge_of_close_centres(spark):
    p = classify.Isodata(k=1, theta_m=0, theta_c=3.5, pairs=2)
    h = classify.histogram(raster(spark, [[10, 10, 12, 12, 12, 40, 43, 90]]))
    merged = classify._merge(h, [10.0, 12.0, 40.0, 43.0, 90.0], p)
    assert merged == sorted([90.0, float(round((3 * 10 + 4 * 12) / 7)), float(round((2 * 40 + 2 * 43) / 4))])
    assert classify.closest_pairs([1.0, 2.0, 9.0], 5, 2.0) == [(1, 0)]


def test_clahe_raises_contrast_in_dark_parts(spark):
    grid = np.tile(np.linspace(1, 20, 16), (16, 1))
    grid[:, 8:] += 200
    out = cells(neighborhood.clahe(raster(spark, grid), 16, 16, 8, 1.0))
    values = np.array([[out[r, c] for c in range(16)] for r in range(16)])
    assert values.min() >= 0 and values.max() <= 1 + 1e-9 and (np.diff(values[8, :4]) >= -1e-9).all()
    span = (grid.max() - grid.min())
    assert values[8, 3] - values[8, 0] > 2 * (grid[8, 3] - grid[8, 0]) / span


def test_sar_preparation(spark):
    grid = raster(spark, np.arange(1, 257).reshape(16, 16))
    steps = preparation.Sar(slant=True, scale=2, contrast=True)
    land = raster(spark, [[1.0, 0.0], [0.0, 0.0]])
    out = cells(preparation.scan_sar(grid, 16, 16, steps, land))
    assert len(out) == 64 and out[0, 0] == 0 and all(v is None or 0 <= v <= 255 for v in out.values())
    plain = cells(preparation.scan_sar(grid, 16, 16, preparation.Sar(kind="TSX", slant=True)))
    assert plain == cells(grid)
    assert cells(preparation.to_single_band(grid, 1)) == cells(grid)


def test_georeference(spark):
    rows = georef.meta(raster(spark, [[1, 2, 3]]), GeoTransform(10, 2, 50, -5))
    axes = {(r["axis"], r["i"]): r["value"] for r in georef.axes(rows).collect()}
    assert axes == {("easting", 0): 10, ("easting", 1): 13, ("easting", 2): 16, ("northing", 0): 45}
    assert not georef.flipped(georef.axes(georef.meta(raster(spark, [[1]]), GeoTransform()))).first()["flipped"]
    text = spark.createDataFrame([("EPSG:1 first\nid EPSG:32629 x",), ("EPSG:7",), (None,)], "t string")
    assert [r[0] for r in text.select(georef.epsg(F.col("t"))).collect()] == [32629, None, None]


def test_names_and_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b12/Img_07.tif",), ("plain",), (None,)], "n string")
    assert [r[0] for r in df.select(names.number_of(F.col("n"))).collect()] == ["12", "", None]
    (tmp_path / "d").mkdir()
    for name in ("b.xml", "a.tif", "c.nc"):
        (tmp_path / "d" / name).write_bytes(b"x")
    listed = files.catalogue(spark, str(tmp_path / "d"))
    assert [(r["path"].rsplit("/")[-1], r["kind"]) for r in listed.collect()] == [("a.tif", "GeoTIFF"), ("b.xml", "TSX"), ("c.nc", "NetCDF")]
    with pytest.raises(Exception, match="more than one"):
        files.is_product(spark.createDataFrame([("z", "a.xml"), ("z", "b.xml")], "container string, name string"), "*.xml").collect()
    files.write_dataset(raster(spark, [[1, 2]]), f"{tmp_path}/Img.h5")
    assert spark.read.parquet(f"{tmp_path}/Img.h5").select("dataset").distinct().first()[0] == "Img"


def test_stages_as_a_stream(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "point_id long, wavelength double, apriori_bathymetry double"
    spark.createDataFrame([(1, 100.0, -3.0), (2, 10.0, -50.0)], schema).write.parquet(source)
    from strandline.operators import bathymetry

    query = stages.run(stages.watch(spark, source, schema), bathymetry.classify, str(tmp_path / "out"), str(tmp_path / "log"))
    query.awaitTermination(60)
    assert {r["point_id"]: r["flag"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: -1.0, 2: 0.0}


def test_intermediate_tables_can_be_deleted(spark):
    held = lineage.materialise(spark.range(3).toDF("a"), "some")
    assert held.count() == 3
    folder = lineage.tables(spark).removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    lineage.clear(spark)
    assert not os.path.isdir(folder)
    assert lineage.few(spark.range(3).toDF("a"), "few", 2).count() == 3


@pytest.mark.parametrize("alone", [0, 200_000])
def test_components_in_one_task_and_in_rounds(spark, alone, monkeypatch):
    from strandline.operators import graph

    monkeypatch.setattr(graph, "ALONE", alone)
    edges = [(i, i + 3) for i in range(0, 60) if i % 10 < 6] + [(7, 7), (None, 1), (90, 80), (80, 90)]
    up = {i: i for e in edges if None not in e and e[0] != e[1] for i in e}
    for _ in up:
        for a, b in edges:
            if a in up and b in up:
                up[a] = up[b] = min(up[a], up[b])
    at = lineage.tables(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted(up.items())
    assert alone == 0 or len(set(os.listdir(at)) - before) == 2


def test_spectra_of_directions_and_profiles():
    n = 64
    y, x = np.indices((n, n))
    wave = np.sin(2 * np.pi * 6 * x / n)
    d = spectrum.wave_direction(spectrum.power(wave), 270.0)
    assert min(abs(d - 270), abs(d - 90)) < 3
    kept = spectrum.filtered(wave + np.sin(2 * np.pi * 20 * y / n), 0.0)
    assert kept.shape == (n, n) and np.isfinite(kept).all()
    lines = spectrum.profiles(wave, 270.0, 3, 2.0)
    assert len(lines) == 5 and all(abs(abs(np.corrcoef(line[2:-2], wave[0, : len(line)][2:-2])[0, 1])) <= 1 for line in lines)
    k, s = spectrum.spectrum1d(wave[0], 128)
    assert abs(k[int(np.argmax(s))] - 2 * np.pi * 6 / n) < 0.06
    t = np.arange(10.0)
    heap = np.exp(-((t - 4) ** 2))
    assert spectrum.peak(t, heap) == 4 and abs(spectrum.peak(t, heap, "centroid") - 4) < 1e-6
    assert spectrum.box_dimension(100, 3) if hasattr(spectrum, "box_dimension") else roi.box_dimension(100, 3) == 32
    assert roi.box_dimension(100, 3, False) == 36 and roi.box_dimension(100, 10, False) == 10


def packed(data, how):
    """The same bytes by a plain encoder of each kind."""
    import zlib

    if how == 8:
        return zlib.compress(data)
    if how == 32773:
        return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100))
    if how == 5:  # a clear code before each 200 signs keeps all codes 9 bits wide
        bits = "".join((f"{256:09b}" if i % 200 == 0 else "") + f"{b:09b}" for i, b in enumerate(data)) + f"{257:09b}"
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")
    return data


@pytest.mark.parametrize("how", [1, 5, 8, 32773])
@pytest.mark.parametrize("tiled, predictor", [(False, 1), (True, 1), (False, 2)])
def test_tiff_compressions_and_tiles(how, tiled, predictor):
    import struct

    grid = np.random.default_rng(1).integers(0, 200, (1, 37, 50)).astype("u1")
    if tiled:
        w, h = 16, 32
        wide = np.zeros((64, 64), "u1")
        wide[:37, :50] = grid[0]
        parts = [wide[r : r + h, c : c + w] for r in (0, 32) for c in (0, 16, 32, 48)]
    else:
        w, h = 50, 10
        parts = [grid[0, r : r + h] for r in range(0, 37, h)]
    if predictor == 2:
        parts = [np.diff(p, axis=1, prepend=np.zeros((len(p), 1), "u1")).astype("u1") for p in parts]
    strips = [packed(p.tobytes(), how) for p in parts]
    at = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    body = b"".join(strips) + b"\0" * (sum(map(len, strips)) % 2)
    shape = [(322, 4, (w,)), (323, 4, (h,)), (324, 4, tuple(at)), (325, 4, tuple(map(len, strips)))] if tiled else [(273, 4, tuple(at)), (278, 4, (h,)), (279, 4, tuple(map(len, strips)))]
    entries = sorted([(256, 4, (50,)), (257, 4, (37,)), (258, 3, (8,)), (259, 3, (how,)), (317, 3, (predictor,)), *shape])
    start = 8 + len(body)
    table, extra, place = b"", b"", start + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        raw = struct.pack("<" + {3: "H", 4: "I"}[kind] * len(values), *values)
        table += struct.pack("<HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", place + len(extra)))
        extra += raw if len(raw) > 4 else b""
    data = b"II" + struct.pack("<HI", 42, start) + body + struct.pack("<H", len(entries)) + table + struct.pack("<I", 0) + extra
    assert (files.decode_tiff(data)[0] == grid).all()


def test_tiff_written_and_read(spark, tmp_path):
    data = files.encode_tiff(np.array([[[1.4, np.nan, 300.0]]]), [10.0, 2.0, 50.0, -2.0], "u1", 0, 32629)
    grid, gt = files.decode_tiff(data)
    assert grid.tolist() == [[[1, 0, 255]]] and gt == [10, 2, 50, -2] and b"0\0" in data
    np.savez(tmp_path / "grid.npz", points=np.array([[1.0, 2.0, -3.0], [4.0, 5.0, -6.0]]))
    np.savez(tmp_path / "flat.npz", points=np.array([[1.0, 2.0], [4.0, 5.0]]))
    assert sorted(map(tuple, files.scan_bathymetry_grid(spark, str(tmp_path / "grid.npz")).collect())) == [(1, 2, -3), (4, 5, -6)]
    assert sorted(map(tuple, files.scan_bathymetry_grid(spark, str(tmp_path / "flat.npz")).collect())) == [(1, 2, None), (4, 5, None)]
    with pytest.raises(ValueError):
        files.scan_bathymetry_grid(spark, "grid.csv")


def test_wrong_inputs_raise():
    import io
    import zipfile

    from strandline.operators import bathymetry

    for limits in ((10, 0, 5, 1), (-190, 0, 5, 1), (0, 5, 1, 2), (0, 0, 1, 95)):
        with pytest.raises(ValueError):
            mapalgebra.check_limits(*limits)
    mapalgebra.check_limits(-10, -5, 10, 5)
    with pytest.raises(ValueError):
        bathymetry.check_inputs(False, 0)
    bathymetry.check_inputs(True, 0)
    bathymetry.check_inputs(False, 16.6)
    with pytest.raises(ValueError):
        roi.polygon([(0.0, 0.0)])
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a/product.xml", b"<x/>")
        z.writestr("b.tif", b"t")
        z.writestr("c.tif", b"u")
    assert files.open_product(box.getvalue(), "*product.xml") == b"<x/>"
    for pattern in ("*.tif", "*.nc"):
        with pytest.raises(ValueError):
            files.open_product(box.getvalue(), pattern)
