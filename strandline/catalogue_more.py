"""More registered queries: georeference, regions of interest, SAR preparation, lines and profiles, names, files written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import GT, ROI, _add, _px, shape
from .functions import lines, names, waves
from .model import view
from .operators import bathymetry, classify, georef, gridding, mapalgebra, roi, spectrum, stats
from .plans import preparation
from .plans.lineage import tables
from .sources import files


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{tables(spark)}/{name}-{uuid.uuid4().hex}"


def _meta(s: SparkSession, d: str) -> DataFrame:
    return georef.meta(view(s, d, "ras_orders"), GT, "Coordinate System is:\nEPSG:9122 units\nID EPSG:4326")


SIZE = ", m AS (SELECT max(row)+1 AS h, max(col)+1 AS w FROM ras_orders)"
AXES = SIZE + ", a AS (SELECT 'easting' AS axis, CAST(i AS INT) AS i, -50+i*(w*1.0::DOUBLE)/(w-1) AS value FROM m, (SELECT unnest(range(100000)) i) WHERE i<w UNION ALL SELECT 'northing', CAST(i AS INT), 80-h*0.1::DOUBLE+(h-1-i)*(h*0.1::DOUBLE)/(h-1) FROM m, (SELECT unnest(range(100000)) i) WHERE i<h)"
_add("s5_raster_resolution", lambda s, d: georef.resolution(_meta(s, d)), "SELECT 'orders' AS raster_id, 0.1::DOUBLE AS yres, 1.0::DOUBLE AS xres FROM (SELECT count(*) FROM ras_orders)")
_add("s7_projection", lambda s, d: georef.projection(_meta(s, d)).select("axis", "i", F.round("value", 6).alias("value"), "yres", "xres"), AXES + " SELECT axis, i, round(value,6) AS value, 0.1::DOUBLE AS yres, 1.0::DOUBLE AS xres FROM a")
_add("x16_axes", lambda s, d: georef.axes(_meta(s, d)).select("axis", "i", F.round("value", 6).alias("value")), AXES + " SELECT axis, i, round(value,6) AS value FROM a")
_add("s8_raster_epsg", lambda s, d: _meta(s, d).select("raster_id", georef.epsg(F.col("srs")).alias("epsg")), "SELECT 'orders' AS raster_id, CAST(4326 AS INT) AS epsg FROM (SELECT count(*) FROM ras_orders)")
_add("r31_flip_check", lambda s, d: georef.flipped(georef.axes(_meta(s, d))), "SELECT 'orders' AS raster_id, true AS flipped FROM (SELECT count(*) FROM ras_orders)")
_add("x14_image_centre", lambda s, d: georef.centre(_meta(s, d)).select("x", "y"), SIZE + " SELECT (w-1)/2.0::DOUBLE AS x, (w-1)/2.0::DOUBLE AS y FROM m")
_add("x18_resolution_pixels", lambda s, d: view(s, d, "wave").select("point_id", *[c.alias(n) for c, n in zip(georef.in_pixels(F.col("wavelength"), F.lit(16.0)), ("pixels", "metres"), strict=True)]), "SELECT point_id, CAST(round_even(wavelength/16,0) AS INT) AS pixels, round_even(wavelength/16,0)*16.0::DOUBLE AS metres FROM wave")
_add("k5_refitted_transform", lambda s, d: georef.refitted(_meta(s, d), georef.axes(_meta(s, d))).select(*[F.round(c, 6).alias(c) for c in ("x0", "dx", "y0", "dy")]), SIZE + " SELECT -50.0::DOUBLE AS x0, 1.0::DOUBLE AS dx, 80.0::DOUBLE AS y0, -0.1::DOUBLE AS dy FROM m")

BYTES = "CAST(CAST(floor({v}*255.0/(SELECT max({v}) FROM {t})) AS BIGINT) % 256 AS DOUBLE)"
_add("k4_byte_raster", lambda s, d: _px(preparation.byte_raster(view(s, d, "ras_events"))), "SELECT row, col, nullif(CAST(greatest(0,least(255,round_even(value,0))) AS DOUBLE),0) AS value FROM ras_events")
_add("k6_single_band_bytes", lambda s, d: _px(preparation.single_band_bytes(view(s, d, "ras_part"), 1)), f"SELECT row, col, nullif({BYTES.format(v='value', t='ras_part2')},0) AS value FROM ras_part2")
_add("r13_to_single_band", lambda s, d: _px(preparation.to_single_band(view(s, d, "ras_part"), mapalgebra.band_count(view(s, d, "ras_part")), 0)), f"SELECT row, col, nullif({BYTES.format(v='value', t='ras_part1')},0) AS value FROM ras_part1")
_add("r20_stretched", lambda s, d: _px(preparation.stretched(view(s, d, "ras_events"), *shape(view(s, d, "ras_events")))))
_add("r22_slant_bytes", lambda s, d: _px(preparation.slant_bytes(view(s, d, "ras_events"), *shape(view(s, d, "ras_events")))))


def _scan_sar(s: SparkSession, d: str) -> DataFrame:
    raster, land = view(s, d, "ras_orders"), view(s, d, "ras_class").withColumn("value", F.col("value") - 3)
    steps = preparation.Sar(scale=2, x=F.col("col") * 1.5 + 0.25, y=F.col("row") * 0.75, dx=4.0, dy=2.0)
    return preparation.scan_sar(raster, *shape(raster), steps, land)


_add("s10_scan_sar", lambda s, d: _px(_scan_sar(s, d)), ", h AS (SELECT CAST(floor(row/2) AS INT) AS row, CAST(floor(col/2) AS INT) AS col, avg(nullif(value,0)) AS value FROM ras_orders GROUP BY 1,2), p AS (SELECT CAST(floor(row*0.75/2) AS INT) AS row, CAST(floor((col*1.5+0.25)/4) AS INT) AS col, avg(value) AS value FROM h WHERE value<>0 GROUP BY 1,2) SELECT p.row, p.col, round(CASE WHEN c.value-3>0 THEN 0 ELSE p.value END,6) AS value FROM p LEFT JOIN ras_class c ON c.row=p.row AND c.col=p.col")

_add("r25_known_depth", lambda s, d: bathymetry.known_depth(_gappy(s, d)).select("point_id"), "SELECT point_id FROM wave WHERE wavelength % 3 <> 0")
_add("r26_unknown_depth", lambda s, d: bathymetry.unknown_depth(_gappy(s, d)).select("point_id"), "SELECT point_id FROM wave WHERE wavelength % 3 = 0")
_add("r33_depth_anomalies", lambda s, d: bathymetry.depth_anomalies(view(s, d, "wave")).select("point_id", "apriori_bathymetry"), "SELECT point_id, apriori_bathymetry FROM wave")


def _gappy(s: SparkSession, d: str) -> DataFrame:
    """Points without depth where the wavelength divides by 3: null, or NaN where it divides by 2 too."""
    gap = F.when(F.col("wavelength") % 6 == 0, float("nan")).when(F.col("wavelength") % 3 != 0, F.col("apriori_bathymetry"))
    return view(s, d, "wave").withColumn("apriori_bathymetry", gap)


def _axis(s: SparkSession, d: str) -> tuple:
    rows, cols = shape(view(s, d, "ras_orders"))
    return rows, cols, F.col("col") * 1.0 - 50, 60 - F.col("row") * 0.5


def _grid_sql(step: int) -> str:
    return f", m AS (SELECT max(row)+1 AS h FROM ras_orders), y AS (SELECT CAST(i AS INT) AS row FROM m, (SELECT unnest(range(100000)) i) WHERE i<h AND i%{step}=((h-1)%{step})//2), x AS (SELECT CAST(i AS INT) AS col FROM (SELECT unnest(range(100)) i) WHERE i%{step}=(99%{step})//2), g AS (SELECT row, col, round(col-50.0::DOUBLE,6) AS easting, round(60-row*0.5::DOUBLE,6) AS northing FROM y, x)"


def _index_grid(s: SparkSession, d: str) -> DataFrame:
    rows, cols, e, n = _axis(s, d)
    return roi.index_grid(view(s, d, "ras_orders"), 7, rows, cols, e, n).select("row", "col", F.round("easting", 6).alias("easting"), F.round("northing", 6).alias("northing"))


def _computation_grid(s: SparkSession, d: str) -> DataFrame:
    rows, cols, e, n = _axis(s, d)
    return roi.computation_grid(view(s, d, "ras_orders"), 5.2, 1.0, rows, cols, e, n, ROI).select("row", "col")


INSIDE = "(220*({y}+60)-20*({x}+100))>=0 AND (-30*({y}+40)-110*({x}-120))>=0 AND (-150*({y}-70)+20*({x}-90))>=0 AND (-40*({y}-50)+110*({x}+60))>=0"
_add("g3_index_grid", _index_grid, _grid_sql(7) + " SELECT row, col, easting, northing FROM g")
_add("g1_computation_grid", _computation_grid, _grid_sql(5) + " SELECT row, col FROM g WHERE " + INSIDE.format(x="(col-50.0::DOUBLE)", y="(60-row*0.5::DOUBLE)"))
_add("g4_g5_polygon", lambda s, d: roi.within(view(s, d, "pts"), roi.polygon([(-100.0, 40.0), (50.0, -60.0)])).select("fid"), "SELECT fid FROM pts WHERE x BETWEEN -100 AND 50 AND y BETWEEN -60 AND 40")
_add("j4_nearest_of", lambda s, d: view(s, d, "pts").select("fid", roi.nearest_of(F.col("x"), [-150.0, -20.5, 0.0, 33.0, 170.0]).alias("v")), "SELECT fid, list_extract(list_sort([{'d': abs(v-x), 'v': v} FOR v IN [-150.0::DOUBLE,-20.5,0.0,33.0,170.0]]),1).v AS v FROM pts")


def _targets(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "wave").select(F.col("point_id").alias("fid"), (F.col("direction") / 4 + 2).alias("x"), (F.col("northing") / 50 + 2).alias("y"))


def _depths(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "ras_events").withColumn("value", F.col("value") - 400)


CELLS = ", p AS (SELECT point_id AS fid, direction/4+2 AS x, northing/50+2 AS y FROM wave), b AS (SELECT min(x)-3 AS x0, max(x)+3 AS x1, min(y)-3 AS y0, max(y)+3 AS y1 FROM p), k AS (SELECT row, col, value-400 AS value FROM ras_events, b WHERE value-400<=0 AND col+0.5 BETWEEN x0 AND x1 AND row+0.5 BETWEEN y0 AND y1)"
KEYS = "(CASE WHEN abs({t})<=1 THEN 1.5*abs({t})^3-2.5*({t})^2+1 WHEN abs({t})<2 THEN -0.5*abs({t})^3+2.5*({t})^2-4*abs({t})+2 ELSE 0 END)"
_add("g7_apriori_bathymetry", lambda s, d: roi.apriori_bathymetry(_depths(s, d), _targets(s, d), 3.0, 0.0, 1.0, 0.0, 1.0).select("fid", F.round("value", 6).alias("value")), CELLS + ", c AS (SELECT fid, CAST(floor(y-0.5)+i AS INT) AS row, CAST(floor(x-0.5)+j AS INT) AS col, (CASE WHEN i=1 THEN y-0.5-floor(y-0.5) ELSE 1-(y-0.5-floor(y-0.5)) END)*(CASE WHEN j=1 THEN x-0.5-floor(x-0.5) ELSE 1-(x-0.5-floor(x-0.5)) END) AS w FROM p, (SELECT unnest([0,1]) i), (SELECT unnest([0,1]) j)) SELECT fid, round(CASE WHEN count(k.value)=count(*) THEN sum(w*k.value) END,6) AS value FROM c LEFT JOIN k ON k.row=c.row AND k.col=c.col WHERE w>0 GROUP BY fid")
_add("j7_bicubic", lambda s, d: roi.apriori_bathymetry(_depths(s, d), _targets(s, d), 3.0, 0.0, 1.0, 0.0, 1.0, "cubic").select("fid", F.round("value", 6).alias("value")), CELLS + f", c AS (SELECT fid, CAST(floor(y-0.5)+i AS INT) AS row, CAST(floor(x-0.5)+j AS INT) AS col, {KEYS.format(t='y-0.5-floor(y-0.5)-i')}*{KEYS.format(t='x-0.5-floor(x-0.5)-j')} AS w FROM p, (SELECT unnest([-1,0,1,2]) i), (SELECT unnest([-1,0,1,2]) j)) SELECT fid, round(CASE WHEN count(k.value)=count(*) THEN sum(w*k.value) END,6) AS value FROM c LEFT JOIN k ON k.row=c.row AND k.col=c.col WHERE w<>0 GROUP BY fid")
_add("j7_nearest", lambda s, d: roi.apriori_bathymetry(_depths(s, d), _targets(s, d), 3.0, 0.0, 1.0, 0.0, 1.0, "nearest").select("fid", F.round("value", 6).alias("value")), CELLS + " SELECT fid, round(k.value,6) AS value FROM p LEFT JOIN k ON k.row=floor(p.y) AND k.col=floor(p.x)")

LINE = ", l AS (SELECT point_id, tan(radians(direction+0.5)) AS a, easting, northing, direction+0.5 AS d FROM wave), k AS (SELECT *, northing-a*easting AS b FROM l)"


def _drawn(s: SparkSession, d: str, orthogonal: bool = False) -> DataFrame:
    return view(s, d, "wave").select("point_id", "direction", "easting", "northing", lines.line(F.col("direction") + 0.5, F.col("easting"), F.col("northing"), orthogonal).alias("line"))


_add("p21_define_line", lambda s, d: _drawn(s, d).select("point_id", F.round("line.slope", 6).alias("slope"), F.round("line.offset", 5).alias("offset"), F.round(F.element_at(lines.heights(F.col("line"), F.lit(50)), -1), 4).alias("last")), LINE + " SELECT point_id, round(a,6) AS slope, round(b,5) AS \"offset\", round(49*a+b,4) AS last FROM k")
_add("p21_orthogonal_line", lambda s, d: _drawn(s, d, True).select("point_id", F.round("line.slope", 6).alias("slope"), F.round("line.offset", 5).alias("offset")), LINE + " SELECT point_id, round(-1/a,6) AS slope, round(northing+easting/a,5) AS \"offset\" FROM k")
_add("p22_offset_points", lambda s, d: view(s, d, "wave").select("point_id", F.posexplode(lines.offsets(F.col("easting"), F.col("northing"), F.col("direction"), 30.0, 5, 10.0, 20.0)).alias("i", "p")).select("point_id", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")), ", o AS (SELECT CAST(unnest([0,1,2,3,4]) AS INT) AS i, unnest([0,1,-1,2,-2]) AS k) SELECT point_id, i, round(easting+k*30*cos(radians(direction+90))/10,6) AS x, round(northing+k*30*sin(radians(direction+90))/20,6) AS y FROM wave, o")
_add("p23_line_edges", lambda s, d: _drawn(s, d).select("point_id", lines.edges(F.col("line"), 64, 48).alias("e")).select("point_id", "e.*"), LINE + ", q AS (SELECT *, least(b,63*a+b) AS lo, greatest(b,63*a+b) AS hi FROM k) SELECT point_id, CAST(CASE WHEN lo<0 THEN round_even(-b/a,0) ELSE 0 END AS INT) AS x1, CAST(CASE WHEN lo<0 THEN 0 ELSE round_even(b,0) END AS INT) AS y1, CAST(CASE WHEN hi>47 THEN round_even((47-b)/a,0) ELSE 63 END AS INT) AS x2, CAST(CASE WHEN hi>47 THEN 47 ELSE round_even(63*a+b,0) END AS INT) AS y2 FROM q")


def _signals(s: SparkSession, d: str) -> DataFrame:
    one = view(s, d, "sig").groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("p"))
    return one.select("vec_id", F.transform("p", lambda x: x["v"]).alias("y"), F.transform("p", lambda x: x["i"] * 2.5).alias("x"))


_add("p24_zero_padding", lambda s, d: _signals(s, d).select("vec_id", lines.zero_padded(F.col("y"), 128).alias("y"), lines.extended(F.col("x"), 128).alias("x")).select("vec_id", F.posexplode(F.arrays_zip("x", "y")).alias("i", "p")).select("vec_id", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")), "SELECT v.vec_id, CAST(i.i AS INT) AS i, round(i.i*2.5::DOUBLE,6) AS x, round(coalesce(g.v,0),6) AS y FROM (SELECT DISTINCT vec_id FROM sig) v CROSS JOIN (SELECT unnest(range(128)) AS i) i LEFT JOIN sig g ON g.vec_id=v.vec_id AND g.i=i.i")
_add("p25_distance_axis", lambda s, d: _drawn(s, d).select("point_id", F.posexplode(lines.distances(lines.edges(F.col("line"), 64, 48), F.lit(5), 10.0)).alias("i", "x")).select("point_id", "i", (F.round(F.col("x") * 1e5) / 1e5).alias("x")), LINE + ", q AS (SELECT *, least(b,63*a+b) AS lo, greatest(b,63*a+b) AS hi FROM k), e AS (SELECT point_id, CASE WHEN lo<0 THEN round_even(-b/a,0) ELSE 0 END AS x1, CASE WHEN lo<0 THEN 0 ELSE round_even(b,0) END AS y1, CASE WHEN hi>47 THEN round_even((47-b)/a,0) ELSE 63 END AS x2, CASE WHEN hi>47 THEN 47 ELSE round_even(63*a+b,0) END AS y2 FROM q) SELECT point_id, CAST(i AS INT) AS i, round(i*sqrt((x2-x1)^2+(y2-y1)^2)*10/4,5) AS x FROM e, (SELECT unnest(range(5)) AS i)")
_add("p8_spectrum_range", lambda s, d: _signals(s, d).select("vec_id", F.round(lines.spectrum_range(F.col("y"), F.col("x"), F.lit(31.5), F.lit(4)), 6).alias("k")), ", g AS (SELECT vec_id, max(v) AS a, max(i)*2.5::DOUBLE AS b FROM sig WHERE i BETWEEN 17 AND 44 GROUP BY 1) SELECT vec_id, round(greatest(abs(a),abs(b)),6) AS k FROM g")
_add("u3_p11_half_domains", lambda s, d: lines.half_domains(view(s, d, "sig").select(F.col("vec_id").alias("key"), (F.col("i") * 6 - F.floor(F.col("i") / 61) * 6).cast("double").alias("theta"), "v").groupBy("key", "theta").agg(F.max("v").alias("v")), 200.0).select("key", "part", "theta", F.round("v", 6).alias("v")), ", t AS (SELECT vec_id AS key, CAST(i*6-floor(i/61)*6 AS DOUBLE) AS theta, max(v) AS v FROM sig GROUP BY 1,2) SELECT key, CAST(1 AS INT) AS part, theta, round(v,6) AS v FROM t WHERE theta BETWEEN 110 AND 290 UNION ALL SELECT key, CAST(2 AS INT), theta, round(arg_min(v,turn),6) FROM (SELECT key, theta, v, 0 AS turn FROM t WHERE theta>=290 UNION ALL SELECT key, theta+360, v, 1 FROM t WHERE theta<=110) GROUP BY key, theta")
_add("p9_band_mask", lambda s, d: view(s, d, "ras_events").select("row", "col", spectrum.outside(F.col("row"), F.col("col"), 100, 10.0, 150.0).alias("outside")), "SELECT row, col, sqrt((row-50)^2+(col-50)^2) > round_even((2*pi()/150)/(2*pi()/1000),0) AS outside FROM ras_events")
_add("p1_box_dimension", lambda s, d: view(s, d, "wave").select("point_id", F.pow(F.lit(2), F.rint(F.log2(F.rint(F.col("wavelength") / 3)))).cast("int").alias("n")), "SELECT point_id, CAST(2^round_even(log2(round_even(wavelength/3,0)),0) AS INT) AS n FROM wave")
_add("p16_peak_centroid", lambda s, d: _signals(s, d).select("vec_id", F.round(spectrum.centroid_of(F.col("x"), F.transform("y", lambda v: F.abs(v)), 1, 0.2), 6).alias("x")), ", t AS (SELECT vec_id, i*2.5::DOUBLE AS x, abs(v) AS y, max(abs(v)) OVER (PARTITION BY vec_id) AS m FROM sig) SELECT vec_id, round(sum(x*y)/sum(y),6) AS x FROM t WHERE y>0.2::DOUBLE*m GROUP BY 1")
_add("p26_wavelength", lambda s, d: _signals(s, d).select("vec_id", F.round(spectrum.wavelength(F.transform("x", lambda v: v / 100), F.transform("y", lambda v: F.abs(v))), 6).alias("w")), ", t AS (SELECT vec_id, i*2.5::DOUBLE/100 AS x, abs(v) AS y FROM sig), k AS (SELECT *, max(y) OVER (PARTITION BY vec_id) AS m FROM t WHERE x>0.01) SELECT vec_id, round(2*pi()*sum((y/m)^5)/sum(x*(y/m)^5),6) AS w FROM k GROUP BY 1")
_add("k17_peak_marker", lambda s, d: view(s, d, "sig").groupBy("vec_id").agg(F.min_by("i", F.struct(F.abs(F.col("i") - 20.3), "i")).alias("i")), "SELECT vec_id, arg_min(i, (abs(i-20.3::DOUBLE), i)) AS i FROM sig GROUP BY 1")

_add("x1_degrees", lambda s, d: view(s, d, "wave").select("point_id", F.round(waves.degrees(F.col("wavelength") / 100), 6).alias("a")), "SELECT point_id, round(degrees(wavelength/100),6) AS a FROM wave")
_add("x8_chi", lambda s, d: view(s, d, "wave").select("point_id", F.round(waves.chi(F.col("wavelength") / 100, 4.0), 6).alias("p")), "SELECT point_id, round((wavelength/100)^3*exp(-((wavelength/100)^2)/2)/2,6) AS p FROM wave")
_add("x10_half_squares", lambda s, d: _signals(s, d).select("vec_id", F.round(waves.half_squares(F.col("y"), F.transform("x", lambda v: v / 1000)), 6).alias("q")), "SELECT vec_id, round(sum((v-i*2.5::DOUBLE/1000)^2)/2,6) AS q FROM sig GROUP BY 1")
_add("x11_along", lambda s, d: view(s, d, "wave").select("point_id", *[F.round(c, 6).alias(n) for c, n in zip(waves.along(F.col("wavelength"), F.col("direction") / 100), ("dx", "dy"), strict=True)]), "SELECT point_id, round(wavelength*sqrt((direction/100)^2+1),6) AS dx, round(direction/100*wavelength*sqrt((direction/100)^2+1),6) AS dy FROM wave")
_add("x15_epsg_code", lambda s, d: view(s, d, "wave").select("point_id", waves.epsg_code(F.concat(F.col("point_id").cast("string"), F.lit(".7"))).alias("code")), "SELECT point_id, CAST(point_id AS INT) AS code FROM wave")
NAMED = "SELECT c_custkey, c_name, CASE c_custkey%8 WHEN 0 THEN 'a/Img_1.TIF' WHEN 1 THEN 'b2/x.nc' WHEN 2 THEN 'S.N1' WHEN 3 THEN 'q.e2' WHEN 4 THEN 'p/manifest.safe' WHEN 5 THEN 'a.xml' WHEN 6 THEN 'z.zip' ELSE 'plain' END AS path FROM {t}"


def _named(s: SparkSession, d: str) -> DataFrame:
    return s.sql(NAMED.format(t=f"parquet.`{d}/customer.parquet`"))


NAMES = f", n AS ({NAMED.format(t='customer')})"
_add("x24_index_of_name", lambda s, d: _named(s, d).select("c_custkey", waves.index_of_name(F.concat("path", "c_name")).alias("i")), NAMES + " SELECT c_custkey, TRY_CAST(regexp_extract(list_extract(string_split(path||c_name,'/'),-1),'([0-9]+)',1) AS INT) AS i FROM n")
_add("x25_stage_file", lambda s, d: _named(s, d).select("c_custkey", names.stage_file(F.col("c_name"), "Subset").alias("name")), NAMES + " SELECT c_custkey, 'Subset'||regexp_extract(c_name,'([0-9]+)',1)||'.out' AS name FROM n")
_add("x22_parameter", lambda s, d: _named(s, d).select("c_custkey", names.parameter(F.lit("P"), F.col("path")).alias("text"), names.parameter(F.lit("n"), F.col("c_custkey"), False).alias("number")), NAMES + " SELECT c_custkey, '-P=\"'||path||'\"' AS text, '-n='||c_custkey AS number FROM n")
_add("r34_by_digits", lambda s, d: names.by_digits(_named(s, d), "path")[0].select("c_custkey", F.lit(True).alias("numbered")).unionAll(names.by_digits(_named(s, d), "path")[1].select("c_custkey", F.lit(False))), NAMES + " SELECT c_custkey, regexp_matches(path,'[0-9]') AS numbered FROM n")
_add("s6_raster_format", lambda s, d: _named(s, d).select("c_custkey", names.kind_of(F.col("path")).alias("kind")), NAMES + " SELECT c_custkey, CASE c_custkey%8 WHEN 0 THEN 'GeoTIFF' WHEN 1 THEN 'NetCDF' WHEN 2 THEN 'ENVISAT' WHEN 3 THEN 'ERS1/2' WHEN 4 THEN 'SENTINEL-1' WHEN 5 THEN 'TSX' WHEN 6 THEN 'zip' ELSE 'unknown' END AS kind FROM n")
_add("k18_labels", lambda s, d: view(s, d, "wave").select("point_id", F.posexplode(F.arrays_zip(names.labels(F.col("easting"), F.col("wavelength"), 5, 2).alias("label"), names.labels(F.col("easting"), F.col("wavelength"), 5, 0).alias("whole"), names.ticks(F.col("wavelength"), 5).alias("tick"))).alias("i", "x")).select("point_id", "i", F.col("x.label").cast("double").alias("label"), "x.whole", "x.tick"), "SELECT point_id, CAST(i AS INT) AS i, round(easting+i*(wavelength-easting)/4,2) AS label, CAST(CAST(trunc(easting+i*(wavelength-easting)/4) AS BIGINT) AS VARCHAR) AS whole, i*wavelength/4 AS tick FROM wave, (SELECT unnest(range(5)) AS i)")
_add("s18_probe_product", lambda s, d: files.probe(_named(s, d).select((F.col("c_custkey") % 5).alias("folder"), F.concat("c_name", "path").alias("path"), names.kind_of(F.col("path")).alias("kind"))), NAMES + ", k AS (SELECT c_custkey%5 AS folder, c_name||path AS path, c_custkey%8 AS k FROM n WHERE c_custkey%8<7) SELECT folder, coalesce(min(path) FILTER (k NOT IN (0,1)), max(path) FILTER (k IN (0,1))) AS path FROM k GROUP BY 1")
_add("s16_is_product", lambda s, d: files.is_product(_named(s, d).select(F.col("c_custkey").alias("container"), F.col("path").alias("name")), "*.n?"), NAMES + " SELECT c_custkey AS container, c_custkey%8=1 AS product FROM n")
_add("s19_t7_list_products", lambda s, d: _named(s, d).select("path", names.kind_of(F.col("path")).alias("kind")).groupBy("path", "kind").agg(F.count("*").alias("n")).orderBy("path"), NAMES + " SELECT path, CASE c_custkey%8 WHEN 0 THEN 'GeoTIFF' WHEN 1 THEN 'NetCDF' WHEN 2 THEN 'ENVISAT' WHEN 3 THEN 'ERS1/2' WHEN 4 THEN 'SENTINEL-1' WHEN 5 THEN 'TSX' WHEN 6 THEN 'zip' ELSE 'unknown' END AS kind, count(*) AS n FROM n GROUP BY 1,2")


def _points_text(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "points-text")
    files.write_points_text(view(s, d, "pts"), path)
    return files.scan_points_text(s, path).groupBy("x", "y").agg(F.count("*").alias("n"))


def _bathymetry_grid(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "grid") + ".parquet"
    files.write_bathymetry(view(s, d, "wave"), path)
    return files.scan_bathymetry_grid(s, path).groupBy("easting", "northing").agg(F.round(F.sum("apriori_bathymetry"), 6).alias("total"))


def _tsv(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "tsv")
    view(s, d, "pts").orderBy("fid").coalesce(1).select(F.col("fid").alias("no"), "x", "z").write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return files.scan_tsv(s, path).select("fid", F.col("no").cast("long").alias("no"), F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))


def _csv_layer(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "csv")
    view(s, d, "pts").select(F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("elev")).write.option("header", True).csv(path)
    return files.scan_points_csv(s, path).groupBy("x", "y").agg(F.round(F.sum("z"), 4).alias("z"))


def _tiff(s: SparkSession, d: str) -> DataFrame:
    raster = view(s, d, "ras_events")
    return files.decode_rasters(files.export_tiff(raster, *shape(raster)))


def _features(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "features")
    files.write_vector(view(s, d, "pts"), path)
    return files.scan_vector(s, path).select("fid", "x", "y", "z")


def _stages(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "stages")
    for part in (0, 1):
        view(s, d, "wave").where(F.col("point_id") % 2 == part).write.parquet(f"{path}/Subset{part}")
    view(s, d, "wave").limit(0).write.parquet(f"{path}/Other")
    return files.scan_stages(s, path, "Subset").select("point_id", "wavelength")


def _merged_spectra(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "spectra")
    means = stats.box_mean(view(s, d, "sig").select((F.col("vec_id") % 10).alias("key"), F.col("vec_id").alias("box"), "i", F.col("i").cast("double").alias("k"), F.col("v").alias("s")))
    files.write_spectra(means, path)
    return s.read.parquet(path).select("key", "k", F.round("s", 6).alias("s"), F.round("std", 6).alias("std"))


def _provenance(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "provenance")
    files.write_provenance(s, {"InterpolationMethod": "linear", "GridResolution": 500.0, "boxes": 9}, path)
    return s.read.json(path).select("InterpolationMethod", "GridResolution", F.col("boxes").cast("long").alias("boxes"))


_add("s11_k7_points_text", _points_text, "SELECT x, y, count(*) AS n FROM pts GROUP BY 1,2")
_add("s12_k8_bathymetry_grid", _bathymetry_grid, "SELECT easting, northing, round(sum(apriori_bathymetry),6) AS total FROM wave GROUP BY 1,2")
_add("s13_tsv", _tsv, "SELECT CAST(row_number() OVER (ORDER BY fid)-1 AS BIGINT) AS fid, CAST(fid AS BIGINT) AS no, x, z FROM pts")
_add("s14_csv_layer", _csv_layer, "SELECT x, y, round(sum(z),4) AS z FROM pts GROUP BY 1,2")
_add("s15_scan_vector", _features, "SELECT fid, x, y, z FROM pts")
_add("s23_scan_stages", _stages, "SELECT point_id, wavelength FROM wave")
_add("k1_s3_tiff_round_trip", lambda s, d: _px(_tiff(s, d)), "SELECT row, col, round(CAST(CAST(value AS FLOAT) AS DOUBLE),6) AS value FROM ras_events")
_add("k14_merged_spectra", _merged_spectra, "SELECT vec_id%10 AS key, CAST(i AS DOUBLE) AS k, round(avg(v),6) AS s, round(stddev_pop(v),6) AS std FROM sig GROUP BY vec_id%10, i")
_add("k15_provenance", _provenance, "SELECT 'linear' AS \"InterpolationMethod\", 500.0::DOUBLE AS \"GridResolution\", CAST(9 AS BIGINT) AS boxes FROM (SELECT count(*) FROM pts)")

_add("j11_t3_centre_pairs", lambda s, d: classify.centre_pairs(classify.cluster_stats(classify.histogram(view(s, d, "ras_events"), None), [10.0, 60.0, 150.0, 400.0])).select("i", "j", F.round("d", 6).alias("d")), ", k AS (SELECT value, CASE WHEN value<=35 THEN 0 WHEN value<=105 THEN 1 WHEN value<=275 THEN 2 ELSE 3 END AS cls FROM ras_events), c AS (SELECT CAST(cls AS INT) AS cls, sum(value)/(count(*)+1) AS m FROM k GROUP BY 1) SELECT a.cls AS i, b.cls AS j, round(abs(a.m-b.m),6) AS d FROM c a JOIN c b ON a.cls>b.cls")
_add("a11_influence_radius", lambda s, d: stats.influence_radius(stats.radial_profile(view(s, d, "ras_events"), 5, 50), 0.01), ", p AS (SELECT CAST(round_even(sqrt((col-50)^2+(row-5)^2),0) AS INT) AS r, avg(value) AS mean FROM ras_events GROUP BY 1 HAVING round_even(sqrt((any_value(col)-50)^2+(any_value(row)-5)^2),0)>0), t AS (SELECT max(mean) AS top FROM p) SELECT arg_max(r, (mean, -r)) AS peak, round(2*pi()/0.01/min(r) FILTER (mean>0.2*top)/10)*10 AS longest, floor(2*pi()/0.01/max(r) FILTER (mean>0.2*top)/10)*10 AS shortest, floor(2*pi()/0.01/max(r) FILTER (mean>0.05*top)/10)*10 AS \"limit\" FROM p, t")
_add("r38_utm", lambda s, d: view(s, d, "pts").where("abs(y) < 80").select("fid", *[F.round(c, 2).alias(n) for c, n in zip(mapalgebra.utm(F.col("x") / 60 - 9, F.col("y"), 29), ("e", "n"), strict=True)]), """, p AS (SELECT fid, radians(y) AS phi, radians(x/60-9+9) AS lam FROM pts WHERE abs(y)<80), c AS (SELECT *, 0.0016792203863837047 AS n FROM p),
    t AS (SELECT *, sinh(atanh(sin(phi))-(2*sqrt(n)/(1+n))*atanh((2*sqrt(n)/(1+n))*sin(phi))) AS t FROM c), q AS (SELECT *, atan2(t,cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta, n/2-2*n^2/3+5*n^3/16 AS a1, 13*n^2/48-3*n^3/5 AS a2, 61*n^3/240 AS a3, 0.9996*6378137/(1+n)*(1+n^2/4+n^4/64) AS k FROM t)
    SELECT fid, round(500000+k*(eta+a1*cos(2*xi)*sinh(2*eta)+a2*cos(4*xi)*sinh(4*eta)+a3*cos(6*xi)*sinh(6*eta)),2) AS e, round(k*(xi+a1*sin(2*xi)*cosh(2*eta)+a2*sin(4*xi)*cosh(4*eta)+a3*sin(6*xi)*cosh(6*eta)),2) AS n FROM q""")


def _tiles(s: SparkSession, d: str) -> DataFrame:
    """Each signal of 64 values as a box of 8 x 8 cells."""
    return spectrum.boxes(view(s, d, "sig").select(F.col("vec_id").alias("point_id"), F.lit(0).alias("box_id"), F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).cast("int").alias("c"), F.col("v").alias("value")))


TILE = ", t AS (SELECT vec_id, i//8 AS r, i%8 AS c, v-avg(v) OVER (PARTITION BY vec_id) AS z, v FROM sig), k AS (SELECT a.y AS ky, b.x AS kx FROM (SELECT unnest(range(8)) AS y) a, (SELECT unnest(range(8)) AS x) b)"
_add("p5_p7_image_spectrum", lambda s, d: spectrum.image_spectra(_tiles(s, d)).select(F.col("point_id").alias("vec_id"), "r", "c", F.round("p", 5).alias("p")), TILE + " SELECT vec_id, CAST(ky AS INT) AS r, CAST(kx AS INT) AS c, round(sum(z*cos(-2*pi()*((ky-4)*t.r+(kx-4)*t.c)/8))^2+sum(z*sin(-2*pi()*((ky-4)*t.r+(kx-4)*t.c)/8))^2,5) AS p FROM t, k GROUP BY 1,2,3")
_add("p6_p15_image_filter", lambda s, d: spectrum.filtered_images(_tiles(s, d), 0.0).select(F.col("point_id").alias("vec_id"), "r", "c", F.round("value", 5).alias("value")), TILE + ", f AS (SELECT vec_id, ky, kx, 1/(1+(((kx-4)/8.0::DOUBLE/0.125)^2+((ky-4)/8.0::DOUBLE/0.05)^2)^2) AS h, sum(v*cos(-2*pi()*((ky-4)*t.r+(kx-4)*t.c)/8)) AS re, sum(v*sin(-2*pi()*((ky-4)*t.r+(kx-4)*t.c)/8)) AS im FROM t, k GROUP BY 1,2,3), g AS (SELECT vec_id, y.y AS r, x.x AS c, 2*pi()*((ky-4)*y.y+(kx-4)*x.x)/8 AS w, h*re AS re, h*im AS im FROM f, (SELECT unnest(range(8)) AS y) y, (SELECT unnest(range(8)) AS x) x) SELECT vec_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(sqrt(sum(re*cos(w)-im*sin(w))^2+sum(re*sin(w)+im*cos(w))^2)/64,5) AS value FROM g GROUP BY 1,2,3")


def _clusters(s: SparkSession, d: str) -> DataFrame:
    return classify.cluster_stats(classify.histogram(view(s, d, "ras_events"), None), [10.0, 60.0, 150.0, 400.0])


CENTRES = ", k AS (SELECT value, CASE WHEN value<=35 THEN 0 WHEN value<=105 THEN 1 WHEN value<=275 THEN 2 ELSE 3 END AS cls FROM ras_events), c AS (SELECT CAST(cls AS INT) AS cls, sum(value)/(count(*)+1) AS m FROM k GROUP BY 1)"
_add("t3_closest_pairs", lambda s, d: classify.closest(classify.centre_pairs(_clusters(s, d)), 2, 90.0).select("i", "j", F.round("d", 6).alias("d")), CENTRES + ", p AS (SELECT a.cls AS i, b.cls AS j, abs(a.m-b.m) AS d FROM c a JOIN c b ON a.cls>b.cls ORDER BY d, i, j LIMIT 2) SELECT i, j, round(d,6) AS d FROM p WHERE d<90")
_add("t2_ranked_centres", lambda s, d: classify.ranked(_clusters(s, d).withColumn("centre", -F.col("centre"))).select("rank", "cls", F.round("centre", 6).alias("centre")), CENTRES + " SELECT CAST(row_number() OVER (ORDER BY -m, cls)-1 AS INT) AS rank, cls, round(-m,6) AS centre FROM c")
_add("v12_grid_nodes", lambda s, d: gridding.grid(s, 250, 250, -180, -90, 180, 90).select("row", "col", F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy")), "SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(-180+(c+0.5::DOUBLE)*360/250,6) AS gx, round(-90+(r+0.5::DOUBLE)*180/250,6) AS gy FROM (SELECT unnest(range(250)) AS r) CROSS JOIN (SELECT unnest(range(250)) AS c)")
