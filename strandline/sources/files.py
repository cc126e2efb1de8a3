"""Readers and writers: tables of points, rasters as Parquet and GeoTIFF, SAR product catalogues."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PIXELS


def scan_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with header, without quoting; fid numbers the rows of the file in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("fid", "line")).where("trim(line) <> ''")
    header = lines.where("fid = 0").first()["line"].split("\t")
    return lines.where("fid > 0").select((F.col("fid") - 1).cast("long").alias("fid"), *[F.get(F.split("line", "\t"), i).alias(h) for i, h in enumerate(header)])


def scan_points_text(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated numbers, one to three a line, as x, y, z with nulls for what lacks."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(*[F.get(parts, i).try_cast("double").alias(c) for i, c in enumerate("xyz")])


def scan_points_csv(spark: SparkSession, path: str, x: str = "X", y: str = "Y", z: str = "elev") -> DataFrame:
    """A CSV layer by its column mapping."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))


def scan_bathymetry_grid(spark: SparkSession, path: str) -> DataFrame:
    """(easting, northing, apriori_bathymetry) from text, Parquet or the first array of an .npz file; the third is null for all if it is missing or its mean is 0. Other names raise ValueError."""
    columns = ["easting", "northing", "apriori_bathymetry"]
    if path.endswith(".npz"):
        raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_first_array, ", ".join(f"{c} double" for c in columns))
    elif path.endswith(".parquet"):
        raw = spark.read.parquet(path)
    elif path.endswith(".txt"):
        raw = scan_points_text(spark, path).toDF(*columns)
    else:
        raise ValueError("a grid is a .npz, .txt or .parquet file")
    mean = raw.agg(F.avg("apriori_bathymetry").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("easting", "northing", F.when(F.col("mean") != 0, F.col("apriori_bathymetry")).alias("apriori_bathymetry"))  # one row


def write_bathymetry(points: DataFrame, path: str) -> None:
    """(easting, northing, apriori_bathymetry) as Parquet, which ``scan_bathymetry_grid`` reads."""
    points.select("easting", "northing", "apriori_bathymetry").write.mode("overwrite").parquet(path)


def write_spectra(spectra: DataFrame, path: str) -> None:
    """Spectra of all points (key, k, s, std) in one table, dealt by point."""
    spectra.select("key", "i", "k", "s", "std").repartition("key").sortWithinPartitions("key", "i").write.mode("overwrite").parquet(path)


def write_provenance(spark: SparkSession, parameters: dict, path: str) -> None:
    """The parameters of a run as one JSON row."""
    import json

    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_vector(features: DataFrame, path: str) -> None:
    """A layer of features as Parquet; an old one goes."""
    features.write.mode("overwrite").parquet(path)


def scan_vector(spark: SparkSession, path: str) -> DataFrame:
    """A layer of features that ``write_vector`` wrote."""
    return spark.read.parquet(path)


def write_dataset(raster: DataFrame, path: str) -> None:
    """One table a raster, named by the last part of the path, as hierarchical files name their datasets."""
    raster.withColumn("dataset", F.lit(path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0])).write.mode("overwrite").partitionBy("dataset").parquet(path)


def scan_stages(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """All tables below ``path`` whose folder begins with the prefix, as one."""
    return spark.read.parquet(f"{path}/{prefix}*")


def _first_array(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    for frame in frames:
        for content in frame["content"]:
            with np.load(io.BytesIO(content)) as arrays:
                points = np.asarray(arrays[arrays.files[0]], float)
            wide = np.full((len(points), 3), np.nan)
            wide[:, : min(points.shape[1], 3)] = points[:, :3]
            rows = pd.DataFrame(wide, columns=["easting", "northing", "apriori_bathymetry"])
            yield rows.astype(object).where(rows.notna(), None) if rows.isna().any().any() else rows


def typed(raster: DataFrame, datatype: str = "uint16") -> DataFrame:
    """Values truncated to uint16 (negatives wrap) or as float32; other types raise ValueError."""
    value = {"uint16": F.pmod(F.col("value").cast("long"), F.lit(65536)).cast("int"), "float32": F.col("value").cast("float")}
    if datatype not in value:
        raise ValueError(f"unknown type {datatype!r}")
    return raster.withColumn("value", value[datatype])


def scan_raster(spark: SparkSession, path: str, datatype: str = "uint16") -> DataFrame:
    """Pixels from Parquet, by ``typed``."""
    return typed(spark.read.parquet(path), datatype)


def topography(raster: DataFrame) -> DataFrame:
    """Heights, 0 where there is none."""
    return raster.withColumn("value", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))


def depths(raster: DataFrame) -> DataFrame:
    """Depths that are positive down as negative ones; heights are null."""
    return raster.withColumn("value", F.when(-F.col("value") <= 0, -F.col("value")))


def write_raster(raster: DataFrame, path: str) -> None:
    raster.write.mode("overwrite").partitionBy("raster_id", "band").parquet(path)


def write_points_text(points: DataFrame, path: str) -> None:
    points.select(F.format_string("%.6f %.6f", "x", "y").alias("value")).write.mode("overwrite").text(path)


#: TIFF sample formats (kind, bits) as NumPy types.
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 12: ("d", 8)}


def _lzw(data: bytes) -> bytes:
    """TIFF's variable-length codes, most significant bit first."""
    out, table, at, width, last = bytearray(), [], 0, 9, b""
    value, held = 0, 0
    while True:
        while held < width:
            if at >= len(data):
                return bytes(out)
            value, held, at = (value << 8 | data[at]) & 0xFFFFFFFF, held + 8, at + 1
        code = value >> held - width & (1 << width) - 1
        held -= width
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def _opened(data: bytes) -> tuple[tuple[int, int, int], str, list[float] | None, Iterator[tuple[int, int, int, np.ndarray]]]:
    """((bands, rows, columns), NumPy type, transform or None, pieces) of a TIFF. A piece is a strip or tile, decoded when it is asked for: (first band, row, column, its values by band, row and column)."""
    import zlib

    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, tags = struct.unpack(order + "I", data[4:8])[0], {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in FIELDS:
            continue
        code, size = FIELDS[kind]
        place = at + 10 + 12 * i if size * count <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        raw = data[place : place + size * count]
        tags[tag] = raw if kind == 2 else struct.unpack(order + code * count, raw)
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(tags.get(259, (1,))[0])
    kind = SAMPLES.get((tags.get(339, (1,))[0], tags.get(258, (8,))[0]))
    if unpack is None or kind is None:
        raise ValueError("unknown compression or sample format")
    width, height, bands, predictor = tags[256][0], tags[257][0], tags.get(277, (1,))[0], tags.get(317, (1,))[0]
    if predictor not in (1, 2):
        raise ValueError("unknown predictor")
    planes = bands if tags.get(284, (1,))[0] == 2 else 1
    deep = bands // planes
    tiled = 324 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, (height,))[0], height))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // w), -(-height // h)
    if len(places) != planes * across * down:
        raise ValueError("not as many strips or tiles as the image takes")

    def pieces() -> Iterator[tuple[int, int, int, np.ndarray]]:
        for i, (start, size) in enumerate(zip(places, sizes, strict=True)):
            plane, r, c = i // (across * down), i // across % down * h, i % across * w
            rows = h if tiled else min(h, height - r)
            part = np.frombuffer(unpack(data[start : start + size]), order + kind, rows * w * deep).reshape(rows, w, deep)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
            yield plane * deep, r, c, np.moveaxis(part, 2, 0)[:, : height - r, : width - c]

    gt = None
    if 33550 in tags and 33922 in tags:
        sx, sy, tie = tags[33550][0], tags[33550][1], tags[33922]
        gt = [tie[3] - tie[0] * sx, sx, tie[4] + tie[1] * sy, -sy]
    return (bands, height, width), order + kind, gt, pieces()


def decode_tiff(data: bytes) -> tuple[np.ndarray, list[float] | None]:
    """(bands x rows x columns, [x0, dx, y0, dy] or None) of a TIFF in strips or tiles, uncompressed or by LZW, Deflate or PackBits. Other files raise ValueError."""
    size, kind, gt, pieces = _opened(data)
    image = np.zeros(size, kind)
    for b, r, c, part in pieces:
        image[b : b + part.shape[0], r : r + part.shape[1], c : c + part.shape[2]] = part
    return image, gt


#: Cells of one band that make a strip of a written TIFF, and that are read at one time.
STRIP = 262_144


def _tall(width: int) -> int:
    """Rows of a strip."""
    return max(1, STRIP // width)


def _strip(part: np.ndarray, kind: str = "f4", nodata: float | None = None) -> bytes:
    """Rows of a band as a deflated strip."""
    import zlib

    if kind == "u1":
        part = np.where(np.isnan(part), nodata or 0, np.clip(np.rint(part), 0, 255))
    data = zlib.compress(part.astype("<" + kind).tobytes())
    return data + b"\0" * (len(data) % 2)


def _file(strips: list[bytes], size: tuple[int, int, int], tall: int, gt: list[float] | None = None, kind: str = "f4", nodata: float | None = None, epsg: int | None = None) -> bytes:
    """The TIFF of strips of ``tall`` rows, all of a band before those of the next."""
    bands, height, width = size
    places = np.cumsum([8, *map(len, strips)]).tolist()
    bits, form = (32, 3) if kind == "f4" else (8, 1)
    entries = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (bits,) * bands), (259, 3, (8,)), (262, 3, (1,)), (273, 4, tuple(places[:-1])), (277, 3, (bands,)), (278, 4, (min(tall, height),)), (279, 4, tuple(map(len, strips))), (284, 3, (2,)), (339, 3, (form,) * bands)]
    if gt:
        entries += [(33550, 12, (gt[1], -gt[3], 0.0)), (33922, 12, (0.0, 0.0, 0.0, gt[0], gt[2], 0.0))]
    if epsg:  # a directory of three keys: projected or geographic model, cells as areas, the code
        flat = epsg in range(4000, 5000)
        entries.append((34735, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, 2048 if flat else 3072, 0, 1, epsg)))
    if nodata is not None:
        text = f"{nodata:g}".encode() + b"\0"
        entries.append((42113, 2, text))
    start = places[-1]
    table, extra, place = b"", b"", start + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        raw = values if kind == 2 else struct.pack("<" + FIELDS[kind][0] * len(values), *values)
        if len(raw) > 4:
            table += struct.pack("<HHII", tag, kind, len(values), place + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            table += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return b"".join([b"II" + struct.pack("<HI", 42, start), *strips, struct.pack("<H", len(entries)), table, struct.pack("<I", 0), extra])


def encode_tiff(image: np.ndarray, gt: list[float] | None = None, kind: str = "f4", nodata: float | None = None, epsg: int | None = None) -> bytes:
    """A little-endian TIFF of float32 ("f4") or byte ("u1") samples, deflated, bands in planes of strips of whole rows; with its transform, nodata value and reference system, if given. NaN becomes nodata in bytes."""
    tall = _tall(image.shape[2])
    strips = [_strip(band[r : r + tall], kind, nodata) for band in image for r in range(0, image.shape[1], tall)]
    return _file(strips, image.shape, tall, gt, kind, nodata, epsg)


def scan_tiff(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of TIFF files, decoded on the executors a row at a time; raster_id is the file's stem."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return decode_rasters(spark.read.format("binaryFile").load(path).select(stem.alias("raster_id"), "content"))


def decode_rasters(rasters: DataFrame) -> DataFrame:
    """Pixels of TIFF files (raster_id, content), decoded on the executors a row at a time, strip by strip or tile by tile."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stem, content in zip(frame["raster_id"], frame["content"], strict=True):
                for first, top, left, part in _opened(content)[3]:
                    high, wide = _tall(part.shape[2]), part.shape[2]
                    for b, band in enumerate(part):
                        for r in range(0, len(band), high):
                            lines = band[r : r + high]
                            rows = np.arange(top + r, top + r + len(lines), dtype=np.int32)
                            cols = np.arange(left, left + wide, dtype=np.int32)
                            yield pd.DataFrame({"raster_id": stem, "band": np.int32(first + b + 1), "row": rows.repeat(wide), "col": np.tile(cols, len(lines)), "value": lines.astype(float).ravel()})

    return rasters.select("raster_id", "content").mapInPandas(run, PIXELS)


def export_tiff(raster: DataFrame, rows: int, cols: int, bands: int = 1, **options) -> DataFrame:
    """(raster_id, content): one GeoTIFF a raster, whose strips are packed a task each and put together by one, so the file, not the raster, must fit a task and a value of 2 GB; null and missing pixels are NaN, or nodata in bytes. Pixels outside raise IndexError. ``options`` are those of ``encode_tiff``."""
    tall, samples = _tall(cols), {k: v for k, v in options.items() if k in ("kind", "nodata")}
    down = -(-rows // tall)

    def blank(i: int) -> np.ndarray:
        return np.full((min(tall, rows - i * tall), cols), np.nan)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        band, i = int(frame["band"].iloc[0]), int(frame["strip"].iloc[0])
        if not (1 <= band <= bands and 0 <= i < down):
            raise IndexError(f"pixels outside of {bands} x {rows} x {cols} cells")
        part = blank(i)
        part[frame["row"] - i * tall, frame["col"]] = frame["value"]
        return pd.DataFrame({"raster_id": [frame["raster_id"].iloc[0]], "at": [(band - 1) * down + i], "data": [_strip(part, **samples)]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        found = dict(zip(frame["at"], frame["data"], strict=True))
        strips = [found[k] if k in found else _strip(blank(k % down), **samples) for k in range(bands * down)]
        return pd.DataFrame({"raster_id": [frame["raster_id"].iloc[0]], "content": [_file(strips, (bands, rows, cols), tall, **options)]})

    cells = raster.select("raster_id", "band", F.floor(F.col("row") / tall).cast("int").alias("strip"), "row", "col", "value")
    packed = cells.groupBy("raster_id", "band", "strip").applyInPandas(pack, "raster_id string, at int, data binary")
    return packed.groupBy("raster_id").applyInPandas(join, "raster_id string, content binary")


def random_raster(spark: SparkSession, width: int, height: int, bands: int = 1, low: int = 0, high: int = 255, seed: int = 1) -> DataFrame:
    if low > high:
        raise ValueError("the lowest value is above the highest")
    cell = F.col("id") % (width * height)
    return spark.range(bands * width * height).select(F.lit("random").alias("raster_id"), (F.floor(F.col("id") / (width * height)) + 1).cast("int").alias("band"), F.floor(cell / width).cast("int").alias("row"), (cell % width).cast("int").alias("col"), (F.lit(float(low)) + F.rand(seed) * (high - low)).alias("value"))


def catalogue(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, kind) of files below a folder, in order of their paths; kind by extension."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = F.when(name.rlike(r"\.tiff?$"), "GeoTIFF").when(name.rlike(r"\.nc$"), "NetCDF").when(name.rlike(r"\.(n1|e1|e2)$"), "ENVISAT").when(name.rlike(r"\.safe$|manifest"), "SENTINEL-1").when(name.rlike(r"\.xml$"), "TSX").when(name.rlike(r"\.zip$"), "zip").otherwise("unknown")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", kind.alias("kind")).orderBy("path")


def probe(files: DataFrame) -> DataFrame:
    """The product to open of (folder, path, kind): the first readable one that is no generic image, else the last generic image."""
    generic = F.col("kind").isin("GeoTIFF", "BigTIFF", "NetCDF")
    known = files.where("kind <> 'unknown'")
    return known.groupBy("folder").agg(F.coalesce(F.min(F.when(~generic, F.col("path"))), F.max(F.when(generic, F.col("path")))).alias("path"))


def glob_pattern(pattern: str) -> str:
    """A regular expression for a file pattern."""
    import fnmatch

    return fnmatch.translate(pattern).replace("(?s:", "(?s:^").replace(r"\Z", "$").replace(r"\z", "$")


def is_product(files: DataFrame, pattern: str) -> DataFrame:
    """(container, product) of containers that hold files (container, name); more than one match raises an error."""
    counted = files.groupBy("container").agg(F.count_if(F.col("name").rlike(glob_pattern(pattern))).alias("n"))
    return counted.select("container", F.when(F.col("n") > 1, F.raise_error(F.lit("more than one product matches")).cast("boolean")).otherwise(F.col("n") == 1).alias("product"))


def open_product(content: bytes, pattern: str) -> bytes:
    """The one member of a zip file that matches, read in memory; none or several raise ValueError."""
    import fnmatch
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if fnmatch.fnmatch(n, pattern)]
        if len(names) != 1:
            raise ValueError(f"{len(names)} members match {pattern!r}")
        return z.read(names[0])
