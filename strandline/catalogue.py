"""The registered queries of the operators and their DuckDB twins, over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import waves
from .model import GeoTransform, view, views_sql
from .operators import bathymetry, classify, georef, gridding, mapalgebra, neighborhood, roi, spectrum, stats, vector
from .plans import pipeline as chain
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GT = GeoTransform(-50.0, 1.0, 80.0, -0.1)
ROI = [(-100.0, -60.0), (120.0, -40.0), (90.0, 70.0), (-60.0, 50.0)]


def _add(name: str, query: Callable, sql: str | None = None, recursive: bool = False) -> None:
    QUERIES[name] = query
    if sql:
        views = views_sql()
        ORACLES[name] = f"{views.replace('WITH', 'WITH RECURSIVE', 1) if recursive else views} {sql}"


def shape(raster: DataFrame) -> tuple[int, int]:
    """Rows and columns of the one raster."""
    return tuple(raster.agg(F.max("row") + 1, F.max("col") + 1).first())


def _px(df: DataFrame, value=None, digits: int = 6) -> DataFrame:
    value = F.col("value") if value is None else value
    return df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.round(value.cast("double"), digits).alias("value"))


def _bpx(df: DataFrame) -> DataFrame:
    return df.select(F.col("band").cast("int").alias("band"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.round(F.col("value").cast("double"), 6).alias("value"))


def _raster(name: str, f: Callable, source: str, sql: str | None) -> None:
    _add(name, lambda s, d: _px(f(view(s, d, source))), sql)


def _tworasters(name: str, f: Callable, a: str, b: str, sql: str | None) -> None:
    _add(name, lambda s, d: _px(f(view(s, d, a), view(s, d, b))), sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events masked by class, then statistics."""
    masked = mapalgebra.mask(view(spark, sf_dir, "ras_events"), view(spark, sf_dir, "ras_class"), "1:4,4:")
    s = stats.image_stats(masked)
    return s.select("band", F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")])


_add("a17_masked_stats", flagship, "SELECT CAST(1 AS INT) AS band, count(*) AS n, round(min(v),6) AS min, round(max(v),6) AS max, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std FROM (SELECT e.value * CASE WHEN (c.value>1 AND c.value<4) OR c.value>4 THEN 1 ELSE 0 END AS v FROM ras_events e JOIN ras_class c USING (row, col))")

E_ = "SELECT row, col, round({v},6) AS value FROM ras_events"
_tworasters("r1_mask_multiply", lambda a, b: mapalgebra.mask(a, b), "ras_events", "ras_class", "SELECT row, col, round(e.value*c.value,6) AS value FROM ras_events e JOIN ras_class c USING (row,col)")
_tworasters("r2_mask_range", lambda a, b: mapalgebra.mask(a, b, "1:3,4:"), "ras_events", "ras_class", "SELECT row, col, round(CASE WHEN (c.value>1 AND c.value<3) OR c.value>4 THEN e.value ELSE 0 END,6) AS value FROM ras_events e JOIN ras_class c USING (row,col)")
_add("r3_mask_all_bands", lambda s, d: _bpx(mapalgebra.mask(view(s, d, "ras_part"), view(s, d, "ras_part"), "10:40", all_bands=True)), "SELECT band, row, col, CASE WHEN value>10 AND value<40 THEN round(value,6) ELSE 0.0 END AS value FROM ras_part")
_raster("r4_mask_self", lambda a: mapalgebra.mask(a, None, "100:300"), "ras_events", "SELECT row, col, round(CASE WHEN value>100 AND value<300 THEN value ELSE 0 END,6) AS value FROM ras_events")
_raster("r5_set_type", lambda a: mapalgebra.set_type(a, "Byte"), "ras_events", "SELECT row, col, CAST(greatest(0,least(255,round_even(value,0))) AS DOUBLE) AS value FROM ras_events")
_raster("r6_set_nodata", lambda a: mapalgebra.set_nodata(a, 3.0), "ras_class", "SELECT row, col, nullif(value,3.0) AS value FROM ras_class")
_raster("r7_split_band", lambda a: mapalgebra.split_band(a, 2), "ras_part", "SELECT row, col, round(value,6) AS value FROM ras_part WHERE band=2")
_add("r8_split_all", lambda s, d: mapalgebra.split_all(view(s, d, "ras_part")).select("raster_id", "band", "row", "col", F.round("value", 6).alias("value")), "SELECT band || '_' || raster_id AS raster_id, CAST(1 AS INT) AS band, row, col, round(value,6) AS value FROM ras_part")
_raster("r9_crop_limits", lambda a: mapalgebra.crop(a, GT, -40, 60, 20, 79.5), "ras_orders", "SELECT CAST(row-5 AS INT) AS row, CAST(col-10 AS INT) AS col, round(value,6) AS value FROM ras_orders WHERE col BETWEEN 10 AND 69 AND row BETWEEN 5 AND 199")
_raster("r10_crop_polygon", lambda a: mapalgebra.crop_polygon(a, GeoTransform(0.0, 1.0, 0.0, 1.0), [(10.0, 1.0), (80.0, 1.0), (45.0, 9.0)]), "ras_events", "SELECT row, col, round(CASE WHEN NOT (col+0.5 - 10 < (row+0.5-1)*35/8 OR 80 - (col+0.5) < (row+0.5-1)*35/8) THEN value END,6) AS value FROM ras_events WHERE col+0.5 BETWEEN 10 AND 80 AND row+0.5 BETWEEN 1 AND 9")
_raster("r12_uniband", lambda a: mapalgebra.uniband(a, 1), "ras_part", "SELECT row, col, round(value,6) AS value FROM ras_part WHERE band=2")
_raster("r12_uniband_mean", lambda a: mapalgebra.uniband(a, 4), "ras_part", "SELECT row, col, round(avg(value),6) AS value FROM ras_part WHERE band < 2 GROUP BY row, col")
_raster("r14_invert_mask", mapalgebra.invert_mask, "ras_events", "SELECT row, col, CASE WHEN value>0 THEN 0.0 ELSE 255.0 END AS value FROM ras_events")
for bits, n, wrap in ((8, 255, 256), (16, 65536, 65536)):
    _raster(f"r15_scale_image_{bits}", lambda a, bits=bits: mapalgebra.scale_image(a, bits), "ras_events", f"SELECT row, col, CAST(CAST(floor(value*{n}.0/(SELECT max(value) FROM ras_events)) AS BIGINT) % {wrap} AS DOUBLE) AS value FROM ras_events")
_raster("r15_scale_image_32", lambda a: mapalgebra.scale_image(a, 32), "ras_events", "SELECT row, col, round(value/(SELECT max(value) FROM ras_events),6) AS value FROM ras_events")
_raster("r16_minmax_stretch", mapalgebra.minmax_stretch, "ras_events", "SELECT row, col, round((value-l)*255/(h-l),6) AS value FROM ras_events, (SELECT min(value) l, max(value) h FROM ras_events)")
_raster("r17_percentile_stretch", mapalgebra.percentile_stretch, "ras_events", "SELECT row, col, round(greatest(0,least(1,(value-l)/(h-l))),6) AS value FROM ras_events, (SELECT quantile_cont(value,0.02) l, quantile_cont(value,0.98) h FROM ras_events)")
_raster("r18_hist_equalize", mapalgebra.hist_equalize, "ras_events", ", b AS (SELECT row, col, CAST(least(255, floor((value-l)*256/(h-l))) AS INT) AS bin FROM ras_events, (SELECT min(value) l, max(value) h FROM ras_events)), c AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin) AS k FROM b GROUP BY bin) SELECT row, col, round(k/(SELECT count(*) FROM b),6) AS value FROM b JOIN c USING (bin)")
_raster("r19_clahe", lambda a: neighborhood.clahe(a, *shape(a)), "ras_events", ", s AS (SELECT min(value) AS l, max(value) AS h, (max(row)+8)//8 AS nr, (max(col)+8)//8 AS nc FROM ras_events), b AS (SELECT row, col, nr, nc, CAST(coalesce(least(255, floor((value-l)*256/nullif(h-l,0))),0) AS INT) AS bin FROM ras_events, s), n AS (SELECT row//8 AS tr, col//8 AS tc, bin, count(*) AS n FROM b GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY tr, tc) AS al, least(n::DOUBLE, greatest(1.0::DOUBLE, sum(n) OVER (PARTITION BY tr, tc)*0.03::DOUBLE)) AS kept FROM n), c AS (SELECT tr, tc, bin, (sum(kept) OVER (PARTITION BY tr, tc ORDER BY bin)+(al-sum(kept) OVER (PARTITION BY tr, tc))*(bin+1)/256)/al AS cdf FROM a), p AS (SELECT row, col, bin, i, j, greatest(0,least(nr-1,floor((row+0.5)/8-0.5)+i)) AS tr, greatest(0,least(nc-1,floor((col+0.5)/8-0.5)+j)) AS tc, (CASE WHEN i=1 THEN (row+0.5)/8-0.5-floor((row+0.5)/8-0.5) ELSE 1-((row+0.5)/8-0.5-floor((row+0.5)/8-0.5)) END)*(CASE WHEN j=1 THEN (col+0.5)/8-0.5-floor((col+0.5)/8-0.5) ELSE 1-((col+0.5)/8-0.5-floor((col+0.5)/8-0.5)) END)::DOUBLE AS w FROM b, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j)), v AS (SELECT row, col, i, j, any_value(w) AS w, coalesce(max(cdf) FILTER (c.bin<=p.bin),0) AS level FROM p JOIN c ON c.tr=p.tr AND c.tc=p.tc GROUP BY row, col, i, j) SELECT row, col, round(sum(w*level)/sum(w),6) AS value FROM v GROUP BY 1, 2")
_raster("r21_slant_correct", mapalgebra.slant_correct, "ras_events", ", m AS (SELECT col, avg(value) m FROM ras_events GROUP BY col), e AS (SELECT avg(CASE WHEN col<15 THEN m END) s0, avg(CASE WHEN col>=85 THEN m END) s1 FROM m) SELECT row, col, round(value*(s1+(s0-s1)*(col/99.0)),6) AS value FROM ras_events, e")
_tworasters("r23_land_mask", lambda a, b: mapalgebra.apply_land_mask(a, b.withColumn("value", F.col("value") - 3)), "ras_events", "ras_class", "SELECT row, col, round(CASE WHEN c.value-3>0 THEN 0 ELSE e.value END,6) AS value FROM ras_events e JOIN ras_class c USING (row,col)")
_add("r24_drop_land_points", lambda s, d: roi.drop_land(view(s, d, "ras_events").select("row", "col"), view(s, d, "ras_class").withColumn("value", F.col("value") - 2)), "SELECT row, col FROM ras_class WHERE value-2>0")
_add("r27_above_threshold", lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.size(stats.above(F.col("embedding").cast("array<double>"), 0.1)).cast("long").alias("n")), "SELECT vec_id, len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.1::DOUBLE)) AS n FROM embeddings")
_raster("r28_dilate", neighborhood.dilate, "ras_class", "SELECT a.row, a.col, max(b.value) AS value FROM ras_class a JOIN ras_class b ON b.row BETWEEN a.row-4 AND a.row+4 AND b.col BETWEEN a.col-4 AND a.col+4 GROUP BY a.row, a.col")
_raster("r29_topo_mask", lambda a: mapalgebra.topo_mask(a.withColumn("value", F.col("value") - 1)), "ras_class", "SELECT row, col, CASE WHEN value-1=0 THEN 0.0 ELSE 255.0 END AS value FROM ras_class")
_add("r32_anomaly_params", lambda s, d: view(s, d, "wave").select("point_id", waves.anomaly_parameters(F.col("direction")).alias("p")).select("point_id", "p.flip", "p.transpose"), "SELECT point_id, NOT (direction BETWEEN 225 AND 315 OR direction BETWEEN 45 AND 135) AS flip, (direction BETWEEN 225 AND 315 OR (direction>135 AND direction<225)) AS transpose FROM wave")
_add("r35_calibrate", lambda s, d: mapalgebra.calibrate(view(s, d, "ras_events"), s.range(100).select(F.col("id").cast("int").alias("col"), (F.col("id") * 0.01 + 1.0).cast("double").alias("sigma"), F.lit(2.0).alias("beta"), F.lit(3.0).alias("gamma")), ("sigma", "beta")).select("row", "col", F.round("sigma0", 4).alias("sigma0"), F.round("beta0", 4).alias("beta0")), "SELECT row, col, round(value*value/((col*0.01::DOUBLE+1.0)*(col*0.01::DOUBLE+1.0)),4) AS sigma0, round(value*value/4.0,4) AS beta0 FROM ras_events")
_raster("r37_sigma0_db", mapalgebra.sigma0_db, "ras_events", "SELECT row, col, round(CASE WHEN value>0 THEN 10*log10(value) END,6) AS value FROM ras_events")
_raster("r38_reproject_average", lambda a: mapalgebra.reproject_average(a, F.col("col") * 1.5 + 0.25, F.col("row") * 0.75, 4.0, 2.0), "ras_events", "SELECT CAST(floor(row*0.75/2) AS INT) AS row, CAST(floor((col*1.5+0.25)/4) AS INT) AS col, round(avg(value),6) AS value FROM ras_events WHERE value<>0 GROUP BY 1,2")
_raster("r39_rescale", lambda a: mapalgebra.rescale(a, 4), "ras_orders", "SELECT CAST(floor(row/4) AS INT) AS row, CAST(floor(col/4) AS INT) AS col, round(avg(value),6) AS value FROM ras_orders GROUP BY 1,2")
_raster("r40_resize_nearest", lambda a: mapalgebra.resize_nearest(a, *shape(a), 25, 40), "ras_class", ", m AS (SELECT max(row)+1 AS h FROM ras_class) SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, value FROM m, (SELECT unnest(range(25)) r), (SELECT unnest(range(40)) c), ras_class k WHERE k.row=floor(r*h/25.0) AND k.col=floor(c*100/40.0)")
_tworasters("r41_mosaic", lambda a, b: mapalgebra.mosaic(a, b.withColumn("value", F.col("value") - 3).where("row % 2 = 0")), "ras_events", "ras_class", "SELECT row, col, round(coalesce(nullif(c.value-3,0), e.value),6) AS value FROM ras_events e LEFT JOIN (SELECT * FROM ras_class WHERE row%2=0) c USING (row,col)")
_raster("r30_pad", lambda a: mapalgebra.pad(a, max(shape(a)) + 6, *shape(a)), "ras_events", ", m AS (SELECT max(row)+1 AS h, greatest(max(row)+1,100)+6 AS n FROM ras_events), g AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, (n-h)//2 AS up, (n-100)//2 AS lft FROM m, (SELECT unnest(range(3000)) r), (SELECT unnest(range(3000)) c) WHERE r<n AND c<n) SELECT g.row, g.col, round(coalesce(k.value,(SELECT avg(value) FROM ras_events)),6) AS value FROM g LEFT JOIN ras_events k ON k.row=g.row-up AND k.col=g.col-lft")
_add("u1_stack", lambda s, d: _bpx(mapalgebra.stack([(view(s, d, "ras_events"), 1), (view(s, d, "ras_part"), 2)])), "SELECT band, row, col, round(value,6) AS value FROM ras_events UNION ALL SELECT CAST(band+1 AS INT), row, col, round(value,6) FROM ras_part")

NB = ", nb AS (SELECT a.row, a.col, any_value(a.value) x, avg(b.value) m, var_pop(b.value) v, median(b.value) md FROM ras_events a JOIN ras_events b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 GROUP BY a.row, a.col) "
_raster("f1_none", lambda a: neighborhood.speckle(a, "None"), "ras_events", E_.format(v="value"))
_raster("f2_boxcar", lambda a: neighborhood.speckle(a, "Boxcar"), "ras_events", NB + "SELECT row, col, round(m,6) AS value FROM nb")
_raster("f3_median", lambda a: neighborhood.speckle(a, "Median"), "ras_events", NB + "SELECT row, col, round(md,6) AS value FROM nb")
_raster("f4_frost", lambda a: neighborhood.speckle(a, "Frost"), "ras_events", NB + "SELECT n.row, n.col, round(sum(b.value*exp(-2*(v/(m*m))*sqrt((b.row-n.row)^2+(b.col-n.col)^2)))/sum(exp(-2*(v/(m*m))*sqrt((b.row-n.row)^2+(b.col-n.col)^2))),6) AS value FROM nb n JOIN ras_events b ON b.row BETWEEN n.row-1 AND n.row+1 AND b.col BETWEEN n.col-1 AND n.col+1 GROUP BY n.row, n.col")
_raster("f5_gamma_map", lambda a: neighborhood.speckle(a, "Gamma Map", enl=4.0), "ras_events", NB + ", g AS (SELECT *, v/(m*m) c2, 1.25/(v/(m*m)-0.25) al FROM nb) SELECT row, col, round(CASE WHEN c2<=0.25 THEN m WHEN c2>=0.5 THEN x ELSE ((al-5)*m+sqrt((al-5)*(al-5)*m*m+16*al*m*x))/(2*al) END,6) AS value FROM g")
_raster("f6_lee", lambda a: neighborhood.speckle(a, "Lee", enl=4.0), "ras_events", NB + "SELECT row, col, round(m+greatest(0,least(1,(1-0.25/(v/(m*m)))/1.25))*(x-m),6) AS value FROM nb")
HALVES = [(0, 1), (1, 1), (1, 0), (1, -1)]
_raster("f7_refined_lee", lambda a: neighborhood.speckle(a, "Refined Lee"), "ras_events", ", n AS (SELECT a.row, a.col, a.value AS x, b.row-a.row AS r, b.col-a.col AS c, b.value AS v FROM ras_events a JOIN ras_events b ON b.row BETWEEN a.row-3 AND a.row+3 AND b.col BETWEEN a.col-3 AND a.col+3), g AS (SELECT row, col, any_value(x) AS x, avg(v) AS m, var_pop(v) AS q, [" + ", ".join(f"{{'k': {k}, 'u': avg(v) FILTER (r*{a}+c*{b}>=0), 'd': avg(v) FILTER (r*{a}+c*{b}<=0), 'uq': var_pop(v) FILTER (r*{a}+c*{b}>=0), 'dq': var_pop(v) FILTER (r*{a}+c*{b}<=0)}}" for k, (a, b) in enumerate(HALVES)) + "] AS hs FROM n GROUP BY row, col), e AS (SELECT *, list_extract(list_sort(list_transform(hs, lambda h: {'e': -round(abs(h.u-h.d),9), 'k': h.k, 'h': h})),1).h AS h FROM g), f AS (SELECT row, col, x, CASE WHEN q<=5000 THEN m WHEN abs(h.u-x)<=abs(h.d-x) THEN h.u ELSE h.d END AS m, CASE WHEN q<=5000 THEN q WHEN abs(h.u-x)<=abs(h.d-x) THEN h.uq ELSE h.dq END AS q FROM e) SELECT row, col, round(m+CASE WHEN q=0 THEN 0 ELSE greatest(0,(q-m*m)/2)/q END*(x-m),6) AS value FROM f")
_raster("f8_lee_sigma", lambda a: neighborhood.speckle(a, "Lee Sigma", enl=16.0), "ras_events", "SELECT a.row, a.col, round(avg(b.value),6) AS value FROM ras_events a JOIN ras_events b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND b.value BETWEEN a.value*0.5 AND a.value*1.5 GROUP BY a.row, a.col")
_raster("f9_idan", lambda a: neighborhood.speckle(a, "IDAN"), "ras_events", None)

_add("s2_raster_info", lambda s, d: georef.meta(view(s, d, "ras_part"), GT).select("raster_id", F.col("rows").cast("long").alias("nrows"), F.col("cols").cast("long").alias("ncols"), F.col("bands").cast("long").alias("nbands")), "SELECT raster_id, CAST(max(row)+1 AS BIGINT) AS nrows, CAST(max(col)+1 AS BIGINT) AS ncols, count(DISTINCT band) AS nbands FROM ras_part GROUP BY 1")
_add("s1_scan_raster_uint16", lambda s, d: files.typed(view(s, d, "ras_events").withColumn("value", F.col("value") - 100), "uint16").select("row", "col", F.col("value").cast("long").alias("value")), "SELECT row, col, ((CAST(trunc(value-100) AS BIGINT)%65536)+65536)%65536 AS value FROM ras_events")
_add("s4_raster_corners", lambda s, d: georef.corners(georef.meta(view(s, d, "ras_orders"), GT)).select(*[F.round(c, 6).alias(c) for c in ("west", "east", "north", "south")]), "SELECT CAST(-50 AS DOUBLE) AS west, round(-50+(max(col)+1)*1.0::DOUBLE,6) AS east, CAST(80 AS DOUBLE) AS north, round(80-(max(row)+1)*0.1::DOUBLE,6) AS south FROM ras_orders")
_add("s20_random_raster", lambda s, d: files.random_raster(s, 64, 48, 2).agg(F.count("*").alias("n"), F.countDistinct("row", "col").alias("cells"), (F.min("value") >= 0).alias("low"), (F.max("value") < 255).alias("high")), "SELECT CAST(6144 AS BIGINT) AS n, CAST(3072 AS BIGINT) AS cells, true AS low, true AS high")
_add("s21_scan_topography", lambda s, d: _px(files.topography(view(s, d, "ras_events").withColumn("value", F.when(F.col("value") > 400, float("nan")).when(F.col("value") > 2, F.col("value"))))), E_.format(v="CASE WHEN value<=400 AND value>2 THEN value ELSE 0 END"))
_add("s22_scan_bathymetry", lambda s, d: _px(files.depths(view(s, d, "ras_events").withColumn("value", F.col("value") - 50))), E_.format(v="CASE WHEN -(value-50)<=0 THEN -(value-50) END"))

_add("a7_radial_profile", lambda s, d: stats.radial_profile(view(s, d, "ras_events"), 50, 50).select("r", F.round("mean", 6).alias("mean"), "n"), "SELECT CAST(round_even(sqrt((col-50)^2+(row-50)^2),0) AS INT) AS r, round(avg(value),6) AS mean, count(*) AS n FROM ras_events GROUP BY 1")
_add("a8_directional_hist", lambda s, d: stats.directional_histogram(view(s, d, "ras_events"), 50.5, 50.5).select("theta", F.round("mean", 6).alias("mean")), "SELECT CAST(round_even(((degrees(atan2(row-50.5,col-50.5))%360)+360)%360,0) AS INT) AS theta, round(sum(value)/nullif(count(*) FILTER (value<>0),0),6) AS mean FROM ras_events GROUP BY 1")
_add("a14_block_mean", lambda s, d: stats.block_mean(view(s, d, "sig").withColumnRenamed("vec_id", "key")).select("key", "block", F.round("mean", 6).alias("mean")), "SELECT vec_id AS key, CAST(floor(i/6) AS INT) AS block, round(sum(v)/6,6) AS mean FROM sig GROUP BY 1,2 HAVING count(*)=6")
_add("a15_a18_error_metrics", lambda s, d: stats.error_metrics(view(s, d, "ras_part1").join(view(s, d, "ras_part2").select("row", "col", F.col("value").alias("reference")), ["row", "col"]).select(F.col("value").alias("signal"), "reference")).select(*[F.round(c, 6).alias(c) for c in ("rmse", "bias", "mae", "corr")]), "SELECT round(sqrt(avg((a.value-b.value)^2)),6) AS rmse, round(avg(a.value-b.value),6) AS bias, round(avg(abs(a.value-b.value)),6) AS mae, round(corr(a.value,b.value),6) AS corr FROM ras_part1 a JOIN ras_part2 b USING (row,col)")
_add("a17_histogram", lambda s, d: stats.histogram(view(s, d, "ras_events"), 0, 500, 50).select("bin", "n"), "SELECT CAST(least(49,floor(value*50/500)) AS INT) AS bin, count(*) AS n FROM ras_events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
_add("a19_column_mean", lambda s, d: stats.column_mean(view(s, d, "ras_events")).select("col", F.round("mean", 6).alias("mean")), "SELECT col, round(avg(value),6) AS mean FROM ras_events GROUP BY 1")
_add("a20_band_mean", lambda s, d: stats.band_mean(view(s, d, "ras_part")).select("row", "col", F.round("mean", 6).alias("mean")), "SELECT row, col, round(avg(value),6) AS mean FROM ras_part GROUP BY 1,2")
_add("a9_box_mean", lambda s, d: stats.box_mean(view(s, d, "sig").select((F.col("vec_id") % 10).alias("key"), F.col("vec_id").alias("box"), "i", F.col("i").cast("double").alias("k"), F.col("v").alias("s"))).select("key", "i", F.round("s", 6).alias("s"), F.round("std", 6).alias("std")), "SELECT vec_id%10 AS key, i, round(avg(v),6) AS s, round(stddev_pop(v),6) AS std FROM sig GROUP BY 1,2")
_add("a10_profile_mean", lambda s, d: stats.weighted_profile(view(s, d, "sig").select((F.col("vec_id") % 10).alias("key"), (1.0 / (1 + F.col("vec_id"))).alias("w"), "i", F.col("v").alias("s"))).select("key", "i", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")), "SELECT vec_id%10 AS key, i, round(sum(v/(1+vec_id))/sum(1.0::DOUBLE/(1+vec_id)),6) AS mean, round(stddev_pop(v),6) AS std FROM sig GROUP BY 1,2")
_add("w2_crossings", lambda s, d: stats.crossings(view(s, d, "sig").withColumnRenamed("vec_id", "key"), 0.05), "SELECT key, i FROM (SELECT vec_id AS key, i, sign(v-0.05)-lag(sign(v-0.05)) OVER (PARTITION BY vec_id ORDER BY i) d FROM sig) WHERE d<>0")
_add("w3_detect_peaks", lambda s, d: stats.detect_peaks(view(s, d, "sig").withColumnRenamed("vec_id", "key"), mph=0.1).select("key", "i", F.round("v", 6).alias("v")), "SELECT key, i, round(v,6) AS v FROM (SELECT vec_id AS key, i, v, lag(v) OVER w a, lead(v) OVER w b FROM sig WINDOW w AS (PARTITION BY vec_id ORDER BY i)) WHERE b-v<=0 AND v-a>0 AND v>=0.1")
_add("w3_detect_peaks_spaced", lambda s, d: stats.detect_peaks(view(s, d, "sig").withColumnRenamed("vec_id", "key"), mpd=6).select("key", "i", F.round("v", 6).alias("v")), ", p AS (SELECT key, i, v FROM (SELECT vec_id AS key, i, v, lag(v) OVER w a, lead(v) OVER w b FROM sig WINDOW w AS (PARTITION BY vec_id ORDER BY i)) WHERE b-v<=0 AND v-a>0), l AS (SELECT key, list({'i': i, 'v': v} ORDER BY v DESC, i) AS rest FROM p GROUP BY 1), g(key, top, rest) AS (SELECT key, rest[1], list_filter(rest, lambda x: abs(x.i-rest[1].i)>=6) FROM l UNION ALL SELECT key, rest[1], list_filter(rest, lambda x: abs(x.i-rest[1].i)>=6) FROM g WHERE len(rest)>0) SELECT key, top.i AS i, round(top.v,6) AS v FROM g", recursive=True)
_add("t5_argmax", lambda s, d: view(s, d, "sig").groupBy("vec_id").agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("i")), "SELECT vec_id, arg_max(i, (v, -i)) AS i FROM sig GROUP BY 1")
_add("p5_p20_dft", lambda s, d: spectrum.dft(view(s, d, "sig").withColumnRenamed("vec_id", "key"), 64).select("key", "f", F.round("p", 5).alias("p")), ", c AS (SELECT vec_id, i, v-avg(v) OVER (PARTITION BY vec_id) v FROM sig), f AS (SELECT CAST(unnest(range(33)) AS INT) f) SELECT vec_id AS key, f, round(sum(v*cos(-2*pi()/64*f*i))^2+sum(v*sin(-2*pi()/64*f*i))^2,5) AS p FROM c, f GROUP BY 1,2")

W = "wavelength"
_add("x2_nautical", lambda s, d: view(s, d, "wave").select("point_id", waves.nautical(F.col("direction")).alias("a")), "SELECT point_id, (((450-direction)%360)+360)%360 AS a FROM wave")
_add("x3_wave_period", lambda s, d: view(s, d, "wave").select("point_id", F.round(waves.wave_period(F.col(W), -F.col("apriori_bathymetry")), 6).alias("tp")), "SELECT point_id, round(CASE WHEN 2*pi()*-apriori_bathymetry/wavelength<3 THEN sqrt(2*pi()*wavelength/9.80665/tanh(2*pi()*-apriori_bathymetry/wavelength)) ELSE sqrt(2*pi()*wavelength/9.80665) END,6) AS tp FROM wave")
_add("x4_depth_estimate", lambda s, d: view(s, d, "wave").select("point_id", F.round(waves.depth_estimate(F.col(W), F.col("tp")), 6).alias("h")), "SELECT point_id, round(CASE WHEN 2*pi()*wavelength/(9.80665*tp*tp)<1 THEN atanh(least(0.9999999999,2*pi()*wavelength/(9.80665*tp*tp)))*wavelength/(2*pi()) END,6) AS h FROM wave")
_add("x5_deep_water_period", lambda s, d: view(s, d, "wave").select("point_id", F.round(waves.deep_water_period(F.col(W)), 6).alias("tp")), "SELECT point_id, round(sqrt(2*pi()*wavelength/9.80665),6) AS tp FROM wave")
FLAG = "CASE WHEN kh>3 THEN 0.0 WHEN kh<0.3 THEN -1.0 WHEN kh>1.5 AND kh<3 THEN 0.5 ELSE 1.0 END"
KH = ", k AS (SELECT *, -apriori_bathymetry*2*pi()/wavelength kh FROM wave) "
_add("b4_classify_depth", lambda s, d: bathymetry.classify(view(s, d, "wave")).select("point_id", "flag"), f"{KH} SELECT point_id, CAST({FLAG} AS DOUBLE) AS flag FROM k")
_add("b5_discriminate", lambda s, d: bathymetry.discriminate(view(s, d, "wave")).select("point_id", "group", F.round("tp", 6).alias("tp"), "bathymetry"), f"{KH} SELECT point_id, CASE WHEN kh>3 THEN 'deep' WHEN kh<0.3 THEN 'shallow' ELSE 'compute' END AS \"group\", round(CASE WHEN kh>3 THEN sqrt(2*pi()*wavelength/9.80665) WHEN kh<0.3 THEN 0 ELSE tp END,6) AS tp, CASE WHEN kh>3 THEN apriori_bathymetry END AS bathymetry FROM k")
INV = f"{KH}, q AS (SELECT *, CASE WHEN kh>3 THEN apriori_bathymetry WHEN kh<0.3 THEN NULL WHEN 2*pi()*wavelength/(9.80665*tp*tp)<1 THEN -atanh(least(0.9999999999,2*pi()*wavelength/(9.80665*tp*tp)))*wavelength/(2*pi()) END b FROM k) "
_add("b6_direct_inversion", lambda s, d: bathymetry.direct_inversion(bathymetry.discriminate(view(s, d, "wave"))).select("point_id", F.round("bathymetry", 6).alias("bathymetry")), f"{INV} SELECT point_id, round(b,6) AS bathymetry FROM q")
_add("b9_merge_points", lambda s, d: bathymetry.merge_points(bathymetry.discriminate(view(s, d, "wave"))).select("point_id", "part"), f"{KH} SELECT point_id, CAST(CASE WHEN kh>3 THEN 0 WHEN kh<0.3 THEN 2 ELSE 1 END AS INT) AS part FROM k")
_add("b10_bathymetry_table", lambda s, d: bathymetry.table_lines(view(s, d, "wave").withColumn("bathymetry", F.col("apriori_bathymetry"))), ", w AS (SELECT easting, northing, arg_min(direction, point_id) direction, arg_min(tp, point_id) tp, arg_min(wavelength, point_id) wavelength, arg_min(apriori_bathymetry, point_id) b FROM wave GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (ORDER BY easting, northing) AS idx FROM w) SELECT idx, printf('%4d %16.3f %16.3f %10.3f %10.3f %10.3f %10.3f', idx, easting, northing, direction, tp, wavelength, b) AS line FROM n")
_add("b11_x21_residuals", lambda s, d: bathymetry.residuals(bathymetry.direct_inversion(bathymetry.discriminate(view(s, d, "wave")))).select("point_id", F.round("residual", 5).alias("residual"), F.round("percent", 4).alias("percent"), F.round("arrow", 6).alias("arrow")), f"{INV} SELECT point_id, round(apriori_bathymetry-b,5) AS residual, round(100*(apriori_bathymetry-b)/apriori_bathymetry,4) AS percent, round(radians(180+(((450-direction)%360)+360)%360),6) AS arrow FROM q")
_add("a12_period_stats", lambda s, d: bathymetry.period_stats(bathymetry.discriminate(view(s, d, "wave"))).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n"), f"{KH} SELECT round(avg(sqrt(2*pi()*wavelength/9.80665)),6) AS mean, round(stddev_pop(sqrt(2*pi()*wavelength/9.80665)),6) AS std, count(*) AS n FROM k WHERE kh>3")
_add("a13_group_counts", lambda s, d: bathymetry.group_counts(bathymetry.discriminate(view(s, d, "wave"))), f"{KH} SELECT CASE WHEN kh>3 THEN 'deep' WHEN kh<0.3 THEN 'shallow' ELSE 'compute' END AS \"group\", count(*) AS n FROM k GROUP BY 1")
_add("t1_sort_points", lambda s, d: bathymetry.sort_points(view(s, d, "wave")).select("point_id", "easting", "northing"), "SELECT min(point_id) AS point_id, easting, northing FROM wave GROUP BY easting, northing")
_add("t4_sample_deep", lambda s, d: bathymetry.sample_deep(bathymetry.classify(view(s, d, "wave")), 10).select("point_id", "wavelength"), f"{KH} SELECT point_id, wavelength FROM k WHERE kh>3 ORDER BY md5('1:' || point_id), point_id LIMIT 10")
_add("p13_ambiguity", lambda s, d: view(s, d, "wave").select("point_id", F.round(waves.ambiguity(F.col("direction"), F.pmod(F.col("direction") + 170, F.lit(360.0)), 270.0), 6).alias("d")), ", a AS (SELECT point_id, 0.5*(least(direction,(direction+170)%360)+(greatest(direction,(direction+170)%360)+180)%360) d FROM wave), b AS (SELECT point_id, d, (d+180)%360 t FROM a) SELECT point_id, round(CASE WHEN least(abs(d-270),360-abs(d-270))<=least(abs(t-270),360-abs(t-270)) THEN d ELSE t END,6) AS d FROM b")
_add("p14_butterworth", lambda s, d: view(s, d, "ras_events").select("row", "col", F.round(waves.butterworth((F.col("col") - 50) / 100.0, (F.col("row") - 50) / 100.0, 0.0), 6).alias("value")), "SELECT row, col, round(1/(1+(((col-50)/100.0::DOUBLE)^2/0.125^2+((row-50)/100.0::DOUBLE)^2/0.05^2)^2),6) AS value FROM ras_events")
_add("x7_x9_distributions", lambda s, d: view(s, d, "wave").select("point_id", F.round(waves.rayleigh(F.col(W) / 100, 1.0, 0.5), 6).alias("rayleigh"), F.round(waves.positive_sine(F.col("direction"), 2.0, 10.0, 0.5), 6).alias("sine")), "SELECT point_id, round(4*(wavelength/100)*exp(-2*power(wavelength/100,2)),6) AS rayleigh, round(greatest(2*sin(2*pi()*(direction+10)/180)+0.5,0.5),6) AS sine FROM wave")
_add("x12_x13_padding", lambda s, d: view(s, d, "wave").select("point_id", waves.power_of_two(F.col(W)).alias("power"), waves.padded_length(F.col(W), F.lit(100.0), 1).alias("length")), "SELECT point_id, CAST(round_even(log2(wavelength),0) AS INT) AS power, CAST(2^(greatest(round_even(log2(wavelength),0),7)+1) AS BIGINT) AS length FROM wave")

_add("v1_create_vector", lambda s, d: vector.create_vector(view(s, d, "pts"), "x", "y").select("fid", "x", "y", "z", "wkt"), "SELECT fid, x, y, z, printf('POINT(%.6f %.6f)', x, y) AS wkt FROM pts")
_add("v2_edit_vector", lambda s, d: vector.edit_vector(view(s, d, "pts").select("fid", "x"), view(s, d, "wave").select(F.col("point_id").alias("fid"), W)), "SELECT p.fid, p.x, w.wavelength FROM pts p LEFT JOIN wave w ON w.point_id=p.fid")
_add("v3_wkt", lambda s, d: view(s, d, "pts").select("fid", vector.wkt_point(F.col("x"), F.col("y")).alias("wkt")), "SELECT fid, 'POINT (' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ' 0)' AS wkt FROM pts")
_add("v4_polygon_to_polyline", lambda s, d: vector.polygon_to_polyline(view(s, d, "pts").select("fid", "z", F.array(F.array(F.struct("x", "y"), F.struct((F.col("x") + 1).alias("x"), "y")), F.array(F.struct("x", "y"))).alias("geom"))).select("fid", "z", "ring", F.size("line").cast("long").alias("points")), "SELECT fid, z, CAST(r AS INT) AS ring, CAST(2-r AS BIGINT) AS points FROM pts, (SELECT unnest(range(2)) r)")
_add("v5_polygonize", lambda s, d: vector.polygonize(view(s, d, "ras_class")).groupBy("DN").agg(F.count("*").alias("regions"), F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter")).drop("regions"), "SELECT a.value AS \"DN\", count(*) AS area, sum(4-(SELECT count(*) FROM ras_class b WHERE b.value=a.value AND abs(b.row-a.row)+abs(b.col-a.col)=1)) AS perimeter FROM ras_class a GROUP BY 1")
_add("v5_regions", lambda s, d: vector.polygonize(view(s, d, "ras_class")).select("region", "DN", "area", "perimeter"), ", c AS (SELECT CAST(row AS BIGINT)*2147483648+col AS c, row, col, value FROM ras_class), e AS (SELECT x.c AS a, y.c AS b FROM c x JOIN c y ON x.value=y.value AND ((y.row=x.row AND y.col IN (x.col-1,x.col+1)) OR (y.col=x.col AND y.row IN (x.row-1,x.row+1)))), g(c, m) AS (SELECT c, c FROM c UNION SELECT g.c, e.b FROM g JOIN e ON e.a=g.m), r AS (SELECT c, min(m) AS region FROM g GROUP BY c) SELECT region, any_value(value) AS \"DN\", count(*) AS area, CAST(sum(4-(SELECT count(*) FROM e WHERE e.a=c.c)) AS BIGINT) AS perimeter FROM c JOIN r USING (c) GROUP BY 1", recursive=True)
_add("v6_polyline_to_raster", lambda s, d: vector.rasterize_lines(view(s, d, "pts").select("fid", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 7).alias("bx"), (F.col("y") + 3).alias("by"), F.col("z").alias("value")), 72, 36, -180, -90, 180, 90), ", c AS (SELECT fid, z, (x+180)/5 AS ca, (x+187)/5 AS cb, (90-y)/5 AS ra, (87-y)/5 AS rb, 2 AS n FROM pts), h AS (SELECT fid, z, floor(ra+(rb-ra)*i/n) AS r, floor(ca+(cb-ca)*i/n) AS c FROM c, (SELECT unnest(range(3)) AS i)), t AS (SELECT r, c, arg_max(z, (fid, z)) AS v FROM h GROUP BY 1, 2) SELECT CAST(a.row AS INT) AS row, CAST(b.col AS INT) AS col, coalesce(t.v, 0.0) AS value FROM (SELECT unnest(range(36)) AS row) a CROSS JOIN (SELECT unnest(range(72)) AS col) b LEFT JOIN t ON t.r=a.row AND t.c=b.col")
NODES = ", g AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, -180+(c+0.5)*18 gx, -90+(r+0.5)*18 gy FROM (SELECT unnest(range(10)) r), (SELECT unnest(range(20)) c)) "


def _grid(s: SparkSession) -> DataFrame:
    return gridding.grid(s, 20, 10, -180, -90, 180, 90)


_add("v7_grid_invdist", lambda s, d: _px(gridding.invdist(_grid(s), view(s, d, "pts")), digits=5), NODES + "SELECT row, col, round(coalesce(arg_min(z, fid) FILTER (x=gx AND y=gy), sum(CASE WHEN NOT (x=gx AND y=gy) THEN z/((gx-x)^2+(gy-y)^2) END)/sum(CASE WHEN NOT (x=gx AND y=gy) THEN 1/((gx-x)^2+(gy-y)^2) END)),5) AS value FROM g, pts GROUP BY row, col")
_add("v8_grid_invdistnn", lambda s, d: _px(gridding.invdist_nearest(_grid(s), view(s, d, "pts"), radius=30.0), digits=5), NODES + "SELECT row, col, round(coalesce(arg_min(z, fid) FILTER (d2=0), sum(z/nullif(d2,0))/sum(1/nullif(d2,0))),5) AS value FROM (SELECT row, col, fid, z, (gx-x)^2+(gy-y)^2 d2, row_number() OVER (PARTITION BY row, col ORDER BY (gx-x)^2+(gy-y)^2, fid) k FROM g, pts WHERE (gx-x)^2+(gy-y)^2<=900) WHERE k<=4 GROUP BY row, col")
_add("v9_grid_average", lambda s, d: _px(gridding.average(_grid(s), view(s, d, "pts"), 25.0)), NODES + "SELECT row, col, round(avg(z),6) AS value FROM g JOIN pts ON (gx-x)^2+(gy-y)^2<=625 GROUP BY row, col")
_add("v10_grid_nearest", lambda s, d: _px(gridding.nearest(_grid(s), view(s, d, "pts"))), NODES + "SELECT row, col, round(arg_min(z, ((gx-x)^2+(gy-y)^2, fid)),6) AS value FROM g, pts GROUP BY row, col")
_add("v11_grid_linear", lambda s, d: _px(gridding.linear(_grid(s), view(s, d, "pts"))))
_add("j3_nearest_index", lambda s, d: view(s, d, "pts").select("fid", roi.nearest_index(F.col("x") + 0.3, -179.0, 2.5, 140).alias("i")), "SELECT fid, CAST(greatest(0,least(139,ceil((x+0.3+179)/2.5-0.5))) AS INT) AS i FROM pts")
_add("j5_points_in_polygon", lambda s, d: roi.within(view(s, d, "pts"), ROI).select("fid"), "SELECT fid FROM pts WHERE (220*(y+60)-20*(x+100))>=0 AND (-30*(y+40)-110*(x-120))>=0 AND (-150*(y-70)+20*(x-90))>=0 AND (-40*(y-50)+110*(x+60))>=0")
_add("j6_window_around", lambda s, d: roi.window_around(view(s, d, "pts"), view(s, d, "pts").where("fid < 5"), 1.0).select("fid"), "SELECT p.fid FROM pts p, (SELECT min(x)-1 a, max(x)+1 b, min(y)-1 c, max(y)+1 d FROM pts WHERE fid<5) WHERE p.x BETWEEN a AND b AND p.y BETWEEN c AND d")
_add("j7_bilinear", lambda s, d: gridding.bilinear(view(s, d, "wave").select(F.col("point_id").alias("fid"), (F.col("direction") / 4).alias("x"), (F.col("northing") / 8).alias("y")), view(s, d, "ras_events"), 0.0, 1.0, 0.0, 1.0).select("fid", F.round("value", 6).alias("value")), ", p AS (SELECT point_id fid, direction/4-0.5 fc, northing/8-0.5 fr FROM wave), c AS (SELECT fid, CAST(floor(fr)+i AS INT) AS row, CAST(floor(fc)+j AS INT) AS col, (CASE WHEN i=1 THEN fr-floor(fr) ELSE 1-(fr-floor(fr)) END)*(CASE WHEN j=1 THEN fc-floor(fc) ELSE 1-(fc-floor(fc)) END) w FROM p, (SELECT unnest([0,1]) i), (SELECT unnest([0,1]) j)) SELECT fid, round(CASE WHEN count(e.value)=count(*) THEN sum(w*e.value) END,6) AS value FROM c LEFT JOIN ras_events e USING (row,col) WHERE w>0 GROUP BY fid")
_add("j7_rbf", lambda s, d: gridding.rbf(view(s, d, "wave").select(F.col("point_id").alias("fid"), (F.col("direction") - 180).alias("x"), (F.col("northing") - 20).alias("y")), view(s, d, "pts")))
_add("j10_cluster_assign", lambda s, d: view(s, d, "ras_events").select("row", "col", classify.assign(F.col("value"), [10.0, 60.0, 150.0, 400.0]).alias("cls")), "SELECT row, col, CAST(list_position(ds, list_min(ds))-1 AS INT) AS cls FROM (SELECT row, col, [abs(value-10),abs(value-60),abs(value-150),abs(value-400)] ds FROM ras_events)")
_add("g2_global_grid", lambda s, d: roi.global_grid(view(s, d, "ras_events"), 7, 100, 100), "SELECT CAST(r*7 AS INT) AS row, CAST(c*7 AS INT) AS col FROM (SELECT unnest(range(15)) r), (SELECT unnest(range(15)) c) WHERE true".replace("r*7", "r*7+0").replace("c*7", "c*7+0"))
_add("p3_subset_centers", lambda s, d: roi.centres(view(s, d, "wave").select("point_id", F.col("northing").cast("int").alias("row"), F.col("easting").cast("int").alias("col")), 4, 9), "SELECT point_id, CAST((r+1)*3+c+1 AS INT) AS box_id, CAST(northing+r*4 AS INT) AS row, CAST(easting+c*4 AS INT) AS col FROM wave, (SELECT unnest([-1,0,1]) r), (SELECT unnest([-1,0,1]) c)")


def _points(s: SparkSession, d: str) -> DataFrame:
    raster = view(s, d, "ras_events")
    grid = roi.global_grid(raster, 10, *shape(raster))
    return grid.select((F.col("row") * 100 + F.col("col")).cast("long").alias("point_id"), "row", "col", F.col("col").cast("double").alias("easting"), F.col("row").cast("double").alias("northing"), F.lit(-12.0).alias("apriori_bathymetry"))


_add("p2_image_subset", lambda s, d: roi.fft_boxes(view(s, d, "ras_events"), _points(s, d).select("point_id", F.lit(0).alias("box_id"), "row", "col"), 4).groupBy("point_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total")), ", m AS (SELECT max(row)+1 AS h FROM ras_events), p AS (SELECT row*100+col AS point_id, row, col FROM ras_events, m WHERE row%10=((h-1)%10)//2 AND col%10=4) SELECT CAST(point_id AS BIGINT) AS point_id, count(*) AS n, round(sum(e.value),5) AS total FROM p JOIN ras_events e ON e.row BETWEEN p.row-4 AND p.row+3 AND e.col BETWEEN p.col-4 AND p.col+3 GROUP BY 1")
_add("p17_radial_spectrum", lambda s, d: spectrum.compute(chain.tiles(view(s, d, "ras_events"), _points(s, d).select("point_id", "row", "col"), 8, 9)))
_add("p18_wave_spectrum", lambda s, d: spectrum.compute(chain.tiles(view(s, d, "ras_events"), _points(s, d).select("point_id", "row", "col"), 8, 5), "Waves"))
_add("sar_bathymetry_chain", lambda s, d: chain.run(view(s, d, "ras_events"), _points(s, d), size=8).select("point_id", "direction", "wavelength", "flag", "group", "tp", "bathymetry"))


def _isodata_sql(source: str, k: int, final: str, rounds: int = 100) -> str:
    """The classification's rounds as a recursion over the list of centres; merging needs more than 2 k centres, which don't arise here."""
    nearest = "list_transform({c}, lambda x: abs(h.value-x))"
    members = f"SELECT list_position({nearest}, list_min({nearest})) AS g, h.value, h.n FROM h"
    kept = f"(SELECT list(s/(n+1) ORDER BY s/(n+1)) FROM (SELECT g, sum(n) AS n, sum(value*n) AS s FROM ({members.format(c='r.cen')}) GROUP BY g HAVING sum(n)>10))"
    spread = f"(SELECT list({{'g': g, 'n': n, 'mean': d/(n+1), 'std': sqrt(q/n)}} ORDER BY g) FROM (SELECT g, sum(n) AS n, sum(abs(value-k.kept[g])*n) AS d, sum((value-k.kept[g])^2*n) AS q FROM ({members.format(c='k.kept')}) GROUP BY g))"
    return f""", h AS MATERIALIZED (SELECT value, count(*) AS n FROM {source} WHERE value<>0 GROUP BY 1), r(it, cen, lab, stop) AS (
        SELECT 0, list_transform(range({k}), lambda i: l+i*(u-l)/{k - 1}), NULL::DOUBLE[], false FROM (SELECT min(value) AS l, max(value) AS u FROM h)
        UNION ALL SELECT it+1, nxt, cen, len(nxt)=len(cen) AND list_bool_and(list_transform(range(1,len(cen)+1), lambda i: abs(nxt[i]-cen[i])/(abs(cen[i])+1)<=0.01)) FROM (
            SELECT it, cen, CASE WHEN len(kept)<={k}/2.0 AND w.std>10 AND w.mean>=total AND w.n>0.2 THEN list_sort(list_concat(list_filter(kept, lambda x, i: i<>w.g), [kept[w.g]-10, kept[w.g]+10])) ELSE kept END AS nxt FROM (
                SELECT *, list_sum(list_transform(st, lambda x: x.n*x.mean))/list_sum(list_transform(st, lambda x: x.n)) AS total, list_extract(list_sort(list_transform(st, lambda x: {{'k': -x.std, 'g': x.g, 'x': x}})),1).x AS w FROM (
                    SELECT k.*, {spread} AS st FROM (SELECT r.it, r.cen, {kept} AS kept FROM r WHERE NOT r.stop AND r.it<{rounds}) k)))),
        f AS (SELECT lab FROM r ORDER BY it DESC LIMIT 1), o AS (SELECT row, col, CAST(CASE WHEN value<>0 THEN list_position(list_transform(lab, lambda x: abs(value-x)), list_min(list_transform(lab, lambda x: abs(value-x))))-1 ELSE -1 END AS INT) AS cls FROM {source}, f) {final}"""


_add("i0_isodata", lambda s, d: classify.isodata(view(s, d, "ras_events"))[0].groupBy("cls").agg(F.count("*").alias("n")), _isodata_sql("ras_events", 15, "SELECT cls, count(*) AS n FROM o GROUP BY 1"), recursive=True)
_add("i5_isodata_split", lambda s, d: classify.isodata(view(s, d, "ras_events"), classify.Isodata(k=60, iterations=6))[0].select("row", "col", "cls"), _isodata_sql("ras_events", 60, "SELECT row, col, cls FROM o", 6), recursive=True)
_add("i0_isodata_classes", lambda s, d: classify.isodata(view(s, d, "ras_class"), classify.Isodata(k=5))[0].select("row", "col", "cls"), _isodata_sql("ras_class", 5, "SELECT row, col, cls FROM o"), recursive=True)
_add("a6_initial_centres", lambda s, d: classify.initial_centres(view(s, d, "ras_events"), 15).select("i", F.round("centre", 6).alias("centre")), "SELECT CAST(i AS INT) AS i, round(l+i*(h-l)/14,6) AS centre FROM (SELECT min(value) l, max(value) h FROM ras_events), (SELECT unnest(range(15)) i)")
K4 = ", k AS (SELECT value, CASE WHEN value<=35 THEN 0 WHEN value<=105 THEN 1 WHEN value<=275 THEN 2 ELSE 3 END AS cls FROM ras_events)"
_add("a1_a3_a5_cluster_stats", lambda s, d: classify.cluster_stats(classify.histogram(view(s, d, "ras_events"), None), [10.0, 60.0, 150.0, 400.0]).select("cls", "n", F.round("centre", 6).alias("centre"), F.round("distance", 6).alias("distance"), F.round("std", 6).alias("std")), K4 + " SELECT CAST(cls AS INT) AS cls, CAST(count(*) AS BIGINT) AS n, round(sum(value)/(count(*)+1),6) AS centre, round(sum(abs(value-c))/(count(*)+1),6) AS distance, round(sqrt(sum((value-c)^2)/count(*)),6) AS std FROM (SELECT *, ([10.0,60.0,150.0,400.0])[cls+1]::DOUBLE AS c FROM k) GROUP BY 1")
_add("a2_kept_clusters", lambda s, d: classify.kept_clusters(classify.cluster_stats(classify.histogram(view(s, d, "ras_events"), None), [10.0, 60.0, 150.0, 400.0]), 50).select("cls", "n"), K4 + " SELECT CAST(cls AS INT) AS cls, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1 HAVING count(*) > 50")
_add("a4_overall_distance", lambda s, d: classify.overall_distance(classify.cluster_stats(classify.histogram(view(s, d, "ras_events"), None), [10.0, 60.0, 150.0, 400.0])).select(F.round("distance", 6).alias("distance")), K4 + ", q AS (SELECT cls, count(*) n, sum(abs(value-([10.0,60.0,150.0,400.0])[cls+1]::DOUBLE))/(count(*)+1) d FROM k GROUP BY 1) SELECT round(sum(n*d)/sum(n),6) AS distance FROM q")

from . import catalogue_more  # noqa: E402, F401  its queries join those above
