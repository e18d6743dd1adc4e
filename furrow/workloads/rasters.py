"""Rasters: every embedding is an 8 x 8 image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.geo import from_utm, to_utm, world_window
from furrow.functions.pixels import (
    centikelvin_to_c, disparity_to_xyz, ir_crop_window, low_gain_fix, orient_cloud, raw_to_celsius,
    rgb_to_hsv, hsv_leaf_mask, swap_bytes)
from furrow.operators.raster import (
    apply_calibration, box_height_area, canopy_temp, crop_height, drone_traits, exg, fix_raw_thermal,
    leaf_mask, mosaic, otsu_threshold, plot_windows, pyramid, raster_pixels, raster_window,
    reproject_raster, vegetation_fraction, vegetation_mask)
from furrow.operators.spatial import nearest_pixel
from furrow.workloads import Workload
from furrow.workloads.spatial import PLOTS_SQL, plots
from furrow.workloads.tables import degrees_sql, table, utm_sql

work = Workload()

PIXELS_SQL = """
px AS (
  SELECT vec_id AS raster_id, CAST(i // 8 AS INTEGER) AS row, CAST(i % 8 AS INTEGER) AS col,
         CAST(embedding[i + 1] AS DOUBLE) AS v, label,
         CAST((i * 37 + vec_id * 11) % 256 AS INTEGER) AS g, CAST((i * 13 + label * 7) % 256 AS INTEGER) AS b
  FROM embeddings, range(0, 64) t(i)
), pixels AS (SELECT *, CAST(floor((v + 1) * 100) AS INTEGER) AS r FROM px)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    tiles = e.select(
        F.col("vec_id").alias("raster_id"), F.lit(0).alias("tile_row"), F.lit(0).alias("tile_col"),
        F.transform("embedding", lambda v: v.cast("double")).alias("v"),
        F.array_repeat(F.col("label"), 64).alias("label"))
    px = raster_pixels(tiles, 8, ["v", "label"])
    i = F.col("row") * 8 + F.col("col")
    return px.withColumn("r", F.floor((F.col("v") + 1) * 100).cast("int")).withColumn(
        "g", ((i * 37 + F.col("raster_id") * 11) % 256).cast("int")).withColumn(
        "b", ((i * 13 + F.col("label") * 7) % 256).cast("int"))


@work.query("tiles_to_pixels", f"""
WITH {PIXELS_SQL} SELECT raster_id, row, col, round(v, 6) AS v FROM pixels
""")
def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("raster_id", "row", "col", F.round("v", 6).alias("v"))


EXG_SQL = f"""{PIXELS_SQL}, x AS (
  SELECT *, coalesce((2 * g - r - b) / nullif(CAST(r + g + b AS DOUBLE), 0), 0) AS e FROM pixels
), lohi AS (SELECT raster_id, min(e) AS lo, max(e) AS hi FROM x GROUP BY raster_id),
exg AS (
  SELECT x.*, CAST(round_even((e - lo) * (CAST(255.0 AS DOUBLE) / (hi - lo)), 0) AS INTEGER) AS exg
  FROM x JOIN lohi USING (raster_id)
)"""
OTSU_SQL = f"""{EXG_SQL}, hist AS (SELECT raster_id, exg AS t, count(*) AS n FROM exg GROUP BY ALL),
cum AS (
  SELECT raster_id, t, lag(t) OVER w AS p, sum(n) OVER lo AS c0, sum(n * t) OVER lo AS s0, sum(n * t * t) OVER lo AS q0,
         sum(n) OVER a AS c, sum(n * t) OVER a AS s, sum(n * t * t) OVER a AS q
  FROM hist WINDOW w AS (PARTITION BY raster_id ORDER BY t),
       lo AS (PARTITION BY raster_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       a AS (PARTITION BY raster_id)
), cost AS (
  SELECT raster_id, p, (CAST(q0 AS DOUBLE) - CAST(s0 * s0 AS DOUBLE) / CAST(c0 AS DOUBLE) + (CAST(q - q0 AS DOUBLE)
    - CAST((s - s0) * (s - s0) AS DOUBLE) / CAST(c - c0 AS DOUBLE))) / CAST(c AS DOUBLE) AS k FROM cum WHERE p IS NOT NULL
), otsu AS (SELECT raster_id, CAST(arg_min(p, (k, p)) + 1 AS INTEGER) AS threshold FROM cost GROUP BY raster_id)"""


@work.query("excess_green_byte", f"WITH {EXG_SQL} SELECT raster_id, row, col, exg FROM exg")
def excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exg(pixels(spark, sf_dir)).select("raster_id", "row", "col", "exg")


@work.query("otsu_threshold", f"WITH {OTSU_SQL} SELECT raster_id, threshold FROM otsu")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otsu_threshold(exg(pixels(spark, sf_dir)))


def _window(source: str, value: str, fn: str, reach: int) -> str:
    return f"""
  SELECT a.raster_id, a.row, a.col, {fn}(b.{value}) AS {value}
  FROM {source} a JOIN {source} b ON a.raster_id = b.raster_id
    AND abs(a.row - b.row) <= {reach} AND abs(a.col - b.col) <= {reach} GROUP BY ALL"""


MASK_SQL = f"""{OTSU_SQL}, m0 AS (
  SELECT raster_id, row, col, CAST(exg > threshold AS INTEGER) AS m FROM exg JOIN otsu USING (raster_id)
), m1 AS ({_window('m0', 'm', 'max', 2)}), m2 AS ({_window('m1', 'm', 'min', 2)})"""


@work.query("vegetation_mask", f"WITH {MASK_SQL} SELECT raster_id, row, col, m AS mask FROM m2")
def veg_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vegetation_mask(pixels(spark, sf_dir)).select("raster_id", "row", "col", "mask")


@work.query("vegetation_fraction", f"""
WITH {MASK_SQL} SELECT raster_id, round(avg(m), 4) AS "Vegetation_Fraction" FROM m2 GROUP BY raster_id
""")
def veg_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vegetation_fraction(vegetation_mask(pixels(spark, sf_dir)))


LEAF_SQL = f"""{PIXELS_SQL}, hsv AS (
  SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span FROM pixels
), leaf AS (
  SELECT *, CASE WHEN span = 0 THEN 0 ELSE
    ((CASE WHEN b = top THEN 4 + (r - g) / CAST(span AS DOUBLE) WHEN g = top THEN 2 + (b - r) / CAST(span AS DOUBLE)
           ELSE (g - b) / CAST(span AS DOUBLE) END) / 6 % 1 + 1) % 1 END AS h,
    CASE WHEN top = 0 THEN 0 ELSE span / CAST(top AS DOUBLE) END AS s, top / CAST(255 AS DOUBLE) AS vv FROM hsv
), l0 AS (
  SELECT raster_id, row, col, v, CAST(trunc(h * 255) > 40 AND trunc(s * 255) > 15 AND trunc(vv * 255) > 15 AS INTEGER) AS m
  FROM leaf
)"""


@work.query("leaf_colour_mask", f"WITH {LEAF_SQL} SELECT raster_id, row, col, m = 1 AS mask FROM l0")
def leaf_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.select("raster_id", "row", "col", hsv_leaf_mask(F.col("r"), F.col("g"), F.col("b")).alias("mask"))


def _diamond(source: str, fn: str) -> str:
    return f"""
  SELECT a.raster_id, a.row, a.col, {fn}(b.m) AS m FROM {source} a JOIN {source} b
    ON a.raster_id = b.raster_id AND abs(a.row - b.row) + abs(a.col - b.col) <= 3 GROUP BY ALL"""


@work.query("leaf_mask_opened", f"""
WITH {LEAF_SQL}, o1 AS ({_diamond('l0', 'min')}), o2 AS ({_diamond('o1', 'max')})
SELECT raster_id, row, col, m AS mask FROM o2
""")
def leaf_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaf_mask(pixels(spark, sf_dir)).select("raster_id", "row", "col", "mask")


@work.query("crop_height", f"""
WITH {PIXELS_SQL}
SELECT label AS raster_id,
       round(coalesce(quantile_cont(v, 0.95) FILTER (r > 90) - quantile_cont(v, 0.05) FILTER (r > 90), 0), 4) AS "Height_95p_meters"
FROM pixels GROUP BY label
""")
def height(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).select(
        F.col("label").alias("raster_id"), F.col("v").alias("dem"), (F.col("r") > 90).cast("int").alias("mask"))
    return crop_height(p)


@work.query("canopy_temperature", f"""
WITH {PIXELS_SQL}
SELECT raster_id, round(avg((g + 29000) / 100.0::DOUBLE - 273.15::DOUBLE) FILTER (r > 90), 2) AS "Avg_Temp_C"
FROM pixels GROUP BY raster_id
""")
def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return canopy_temp(p.withColumn("celsius", centikelvin_to_c(F.col("g") + 29000)).withColumn(
        "mask", (F.col("r") > 90).cast("int")))


@work.query("drone_traits", f"""
WITH {MASK_SQL}, j AS (SELECT m2.*, v FROM m2 JOIN pixels USING (raster_id, row, col))
SELECT raster_id, round(raster_id * 2 + 1.5, 4) AS lon, round(avg(m), 4) AS "Vegetation_Fraction",
       round(round(coalesce(quantile_cont(v, 0.95) FILTER (m = 1 AND v <> 0) - quantile_cont(v, 0.05) FILTER (m = 1 AND v <> 0), 0), 4), 3) AS "Height_95p_meters"
FROM j GROUP BY raster_id
""")
def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).withColumn("dem", F.col("v"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    x = F.col("vec_id") * 2
    plots = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("raster_id"),
        F.array(point(x, 0), point(x + 3, 0), point(x + 3, 2), point(x, 0)).alias("ring"))
    out = drone_traits(p, plots)
    return out.select("raster_id", F.round("lon", 4).alias("lon"), "Vegetation_Fraction",
                      F.round("Height_95p_meters", 3).alias("Height_95p_meters"))


def _bilinear(source: str, target: str, height: str, width: str, size: tuple[int, int], bands: list[str]) -> str:
    """Bands of an 8 x 8 grid (or ``size``) on the places of another one, halves rounded up."""
    y, x = f"(row + 0.5) * ({size[0]} / {height}::DOUBLE) - 0.5", f"(col + 0.5) * ({size[1]} / {width}::DOUBLE) - 0.5"
    pick = lambda b, i, j: f"max(s.{b}) FILTER (s.row = least(y0 + {i}, {size[0] - 1}) AND s.col = least(x0 + {j}, {size[1] - 1}))"
    line = lambda b, i: (f"(CASE WHEN fx > 0 THEN {pick(b, i, 0)} * (1 - fx) + {pick(b, i, 1)} * fx ELSE {pick(b, i, 0)} END)")
    blend = lambda b: (f"floor((CASE WHEN fy > 0 THEN {line(b, 0)} * (1 - fy) + {line(b, 1)} * fy ELSE {line(b, 0)} END) + 0.5)::INTEGER AS {b}")
    return f"""
  SELECT p.raster_id, p.row, p.col, {', '.join(blend(b) for b in bands)}
  FROM (SELECT raster_id, row, col, greatest(floor({y}), 0)::INTEGER AS y0, greatest(floor({x}), 0)::INTEGER AS x0,
      CASE WHEN {y} < 0 OR floor({y}) >= {size[0] - 1} THEN 0 ELSE {y} - floor({y}) END AS fy,
      CASE WHEN {x} < 0 OR floor({x}) >= {size[1] - 1} THEN 0 ELSE {x} - floor({x}) END AS fx FROM {target}) p
  JOIN {source} s ON s.raster_id = p.raster_id AND s.row BETWEEN y0 AND y0 + 1 AND s.col BETWEEN x0 AND x0 + 1
  GROUP BY p.raster_id, p.row, p.col, fx, fy"""


# 8 x 8 colours, 5 x 6 heights, 4 x 3 temperatures
GRIDS_SQL = f"""{PIXELS_SQL.replace('pixels AS (', 'colours AS (')}, heights AS (
  SELECT vec_id AS raster_id, CAST(i // 6 AS INTEGER) AS row, CAST(i % 6 AS INTEGER) AS col,
         CAST(embedding[i * 2 + 1] AS DOUBLE) AS dem FROM embeddings, range(0, 30) t(i)
), warmth AS (
  SELECT vec_id AS raster_id, CAST(i // 3 AS INTEGER) AS row, CAST(i % 3 AS INTEGER) AS col,
         (29000 + (i * 53 + vec_id * 17) % 900) / 100.0::DOUBLE - 273.15::DOUBLE AS celsius
  FROM embeddings, range(0, 12) t(i)
), pixels AS ({_bilinear('colours', 'heights', '5', '6', (8, 8), ['r', 'g', 'b'])})"""


@work.query("drone_traits_across_grids", f"""
WITH {MASK_SQL.replace(PIXELS_SQL, GRIDS_SQL)}, tall AS (SELECT raster_id, avg(m) AS share,
    quantile_cont(dem, 0.95) FILTER (m = 1 AND dem <> 0) - quantile_cont(dem, 0.05) FILTER (m = 1 AND dem <> 0) AS h
  FROM m2 JOIN heights USING (raster_id, row, col) GROUP BY raster_id),
marked AS ({_bilinear('m2', 'warmth', '4', '3', (5, 6), ['m'])}),
warm AS (SELECT raster_id, avg(celsius) FILTER (m = 1 AND celsius <> 0) AS c
  FROM warmth JOIN marked USING (raster_id, row, col) GROUP BY raster_id)
SELECT raster_id, round(share, 4) AS "Vegetation_Fraction", round(round(coalesce(h, 0), 4), 3) AS "Height_95p_meters",
       round(c, 2) AS "Avg_Temp_C" FROM tall JOIN warm USING (raster_id)
""")
def traits_across_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings")
    cells = lambda n: F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i", "_")
    spot = lambda width: [F.col("vec_id").alias("raster_id"), F.floor(F.col("i") / width).cast("int").alias("row"),
                          (F.col("i") % width).cast("int").alias("col")]
    dem = vec.select("vec_id", "embedding", cells(30)).select(
        *spot(6), F.element_at("embedding", F.col("i") * 2 + 1).cast("double").alias("dem"))
    thermal = vec.select("vec_id", cells(12)).select(
        *spot(3), centikelvin_to_c(29000 + (F.col("i") * 53 + F.col("vec_id") * 17) % 900).alias("celsius"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    x = F.col("vec_id") * 2
    plots = vec.select(F.col("vec_id").alias("raster_id"),
                       F.array(point(x, 0), point(x + 3, 0), point(x + 3, 2), point(x, 0)).alias("ring"))
    out = drone_traits(pixels(spark, sf_dir).select("raster_id", "row", "col", "r", "g", "b"), plots, thermal, dem)
    return out.select("raster_id", "Vegetation_Fraction", F.round("Height_95p_meters", 3).alias("Height_95p_meters"),
                      "Avg_Temp_C")


@work.query("box_height_and_area", f"""
WITH {PIXELS_SQL}, z AS (SELECT *, -300 + r * 2.0 AS z, b % 3 > 0 AS leaf FROM pixels)
SELECT raster_id, CAST(k AS INTEGER) AS box_id, round(avg(z + 170), 4) AS height, round(count(z) * CAST(0.00667 AS DOUBLE), 6) AS area
FROM (SELECT DISTINCT raster_id FROM pixels), range(0, 3) t(k)
LEFT JOIN (SELECT raster_id AS rid, * EXCLUDE (raster_id) FROM z WHERE leaf AND z < -60 AND z + 170 > 0) q
  ON rid = raster_id AND col >= k * 2 AND col < k * 2 + 4 AND row >= 1 AND row < 7
GROUP BY raster_id, k HAVING count(z) > 0
""")
def box_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).withColumn("z", -300 + F.col("r") * 2.0).withColumn(
        "mask", (F.col("b") % 3 > 0).cast("int"))
    boxes = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("raster_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("box_id")).select(
        "raster_id", "box_id", (F.col("box_id") * 2).alias("x1"), F.lit(1).alias("y1"),
        (F.col("box_id") * 2 + 4).alias("x2"), F.lit(7).alias("y2"))
    out = box_height_area(p, boxes, "box_id").where(F.col("`Height (cm)`").isNotNull())
    return out.select("raster_id", "box_id", F.round("Height (cm)", 4).alias("height"),
                      F.round("Area (cm2)", 6).alias("area"))


@work.query("overview_pyramid", f"""
WITH {PIXELS_SQL}
SELECT raster_id, f AS factor, CAST(row // f AS INTEGER) AS row, CAST(col // f AS INTEGER) AS col,
       round(avg(v), 6) AS v, round(avg(g), 6) AS g
FROM pixels, (SELECT CAST(unnest([2, 4, 8, 16]) AS INTEGER) AS f) GROUP BY ALL
""")
def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pyramid(pixels(spark, sf_dir), ["v", "g"], (2, 4, 8, 16))
    return out.select("raster_id", "factor", "row", "col", F.round("v", 6).alias("v"), F.round("g", 6).alias("g"))


# Rasters on one axis-aligned grid, each shifted by whole pixels: bilinear is exact there.
def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    zero = F.lit(0.0)
    return e.select(
        F.col("vec_id").alias("raster_id"), F.col("vec_id").alias("plot_order"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(0.5).alias("a"), zero.alias("b"),
        (F.col("vec_id") % 25 * 2.0).alias("c"), zero.alias("d"), F.lit(-0.5).alias("e"),
        (F.col("vec_id") % 7 * 1.5 + 4).alias("f"))


@work.query("mosaic_last_wins", f"""
WITH {PIXELS_SQL}, placed AS (
  SELECT raster_id, CAST(row + (6 - raster_id % 7) * 3 AS BIGINT) AS out_row,
         CAST(col + raster_id % 25 * 4 AS BIGINT) AS out_col, g % 4 * 60 AS r, g, b FROM pixels
)
SELECT out_row, out_col,
       coalesce(arg_max(r, raster_id) FILTER (r <> 0), 255) AS r, coalesce(arg_max(g, raster_id) FILTER (g <> 0), 255) AS g,
       coalesce(arg_max(b, raster_id) FILTER (b <> 0), 255) AS b
FROM placed GROUP BY ALL
""")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).select("raster_id", "row", "col", (F.col("g") % 4 * 60).alias("r"), "g", "b")
    return mosaic(p, shifted(spark, sf_dir))


# Every cell near a raster looks back at it: the four pixels around weigh in.
@work.query("mosaic_rotated", f"""
WITH {PIXELS_SQL}, turn AS (SELECT vec_id, vec_id % 7 * 0.1::DOUBLE AS t FROM embeddings), r AS (
  SELECT vec_id AS raster_id, 0.5 * cos(t) AS a, 0.5 * sin(t) AS b, vec_id % 25 * 2.0::DOUBLE AS c,
         0.5 * sin(t) AS d, -0.5 * cos(t) AS e, vec_id % 7 * 1.5::DOUBLE + 4 AS f FROM turn
), corner AS (
  SELECT *, a * i + b * j + c AS x, d * i + e * j + f AS y
  FROM r, (SELECT unnest([0, 8]) AS i), (SELECT unnest([0, 8]) AS j)
), ends AS (
  SELECT raster_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM corner GROUP BY raster_id
), g0 AS (
  SELECT min(x0) AS gx, max(x1) AS hx, min(y0) AS ly, max(y1) AS gy,
         (SELECT min(least(abs(a), abs(e))) FROM r) AS px FROM ends
), g AS (
  SELECT gx, gy, CAST(trunc((hx - gx) / px) AS BIGINT) AS w, CAST(trunc((gy - ly) / px) AS BIGINT) AS h,
         (hx - gx) / trunc((hx - gx) / px) AS sx, (gy - ly) / trunc((gy - ly) / px) AS sy FROM g0
), spot AS (
  SELECT raster_id, q.c AS out_col, p.c AS out_row, gx + (q.c + 0.5::DOUBLE) * sx AS x, gy - (p.c + 0.5::DOUBLE) * sy AS y
  FROM ends, g, (SELECT unnest(range(0, w)) AS c FROM g) q, (SELECT unnest(range(0, h)) AS c FROM g) p
  WHERE gx + (q.c + 0.5::DOUBLE) * sx BETWEEN x0 - 1 AND x1 + 1 AND gy - (p.c + 0.5::DOUBLE) * sy BETWEEN y0 - 1 AND y1 + 1
), back AS (
  SELECT raster_id, out_col, out_row, ((x - c) * e - (y - f) * b) / (a * e - b * d) AS u,
         ((y - f) * a - (x - c) * d) / (a * e - b * d) AS v FROM spot JOIN r USING (raster_id)
), near AS (
  SELECT *, CAST(floor(u - 0.5::DOUBLE) AS INTEGER) + i AS col, CAST(floor(v - 0.5::DOUBLE) AS INTEGER) + j AS row
  FROM back, range(0, 2) s(i), range(0, 2) t(j) WHERE u BETWEEN 0 AND 8 AND v BETWEEN 0 AND 8
), weighed AS (
  SELECT n.raster_id, out_row, out_col, p.r, p.g, p.b,
         greatest(0, 1 - abs(u - n.col - 0.5::DOUBLE)) * greatest(0, 1 - abs(n.v - n.row - 0.5::DOUBLE)) AS k
  FROM near n JOIN pixels p ON p.raster_id = n.raster_id AND p.row = n.row AND p.col = n.col
), mean AS (
  SELECT raster_id, out_row, out_col, CAST(floor(sum(k * r) / sum(k) + 0.5::DOUBLE) AS INTEGER) AS r,
         CAST(floor(sum(k * g) / sum(k) + 0.5::DOUBLE) AS INTEGER) AS g,
         CAST(floor(sum(k * b) / sum(k) + 0.5::DOUBLE) AS INTEGER) AS b
  FROM weighed WHERE k > 0 GROUP BY ALL
)
SELECT out_row, out_col, coalesce(arg_max(r, raster_id) FILTER (r <> 0), 255) AS r,
       coalesce(arg_max(g, raster_id) FILTER (g <> 0), 255) AS g, coalesce(arg_max(b, raster_id) FILTER (b <> 0), 255) AS b
FROM mean GROUP BY ALL
""")
def rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).select("raster_id", "row", "col", "r", "g", "b")
    angle = F.col("raster_id") % 7 * 0.1
    turned = shifted(spark, sf_dir).withColumn("a", 0.5 * F.cos(angle)).withColumn(
        "b", 0.5 * F.sin(angle)).withColumn("d", 0.5 * F.sin(angle)).withColumn("e", -0.5 * F.cos(angle))
    return mosaic(p, turned)


@work.query("reproject_utm_to_degrees", f"""
WITH {PIXELS_SQL}, r AS (
  SELECT vec_id AS raster_id, vec_id % 25 * 2.0::DOUBLE + 608082 AS c, vec_id % 7 * 1.5::DOUBLE + 4 + 4265350 AS f
  FROM embeddings
), corner AS (
  SELECT *, c + i * 0.5::DOUBLE AS x, f - j * 0.5::DOUBLE AS y
  FROM r, (SELECT unnest([0, 8]) AS i), (SELECT unnest([0, 8]) AS j)
), {degrees_sql('placed', 'corner')}, ends AS (
  SELECT raster_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM placed GROUP BY raster_id
), g AS (SELECT min(x0) AS gx, max(y1) AS gy, 5e-6::DOUBLE AS res FROM ends), spot AS (
  SELECT raster_id, out_col, out_row, gx + (out_col + 0.5::DOUBLE) * res AS lon, gy - (out_row + 0.5::DOUBLE) * res AS lat
  FROM (
    SELECT *, unnest(range(greatest(0, CAST(floor((gy - y1) / res) AS BIGINT) - 1), CAST(floor((gy - y0) / res) AS BIGINT) + 2)) AS out_row
    FROM (
      SELECT *, unnest(range(greatest(0, CAST(floor((x0 - gx) / res) AS BIGINT) - 1), CAST(floor((x1 - gx) / res) AS BIGINT) + 2)) AS out_col
      FROM ends, g))
), {utm_sql('back', 'spot')}, near AS (
  SELECT raster_id, out_col, out_row, (x - c) * 2 AS u, (f - y) * 2 AS v,
         CAST(floor((x - c) * 2 - 0.5::DOUBLE) AS INTEGER) + i AS col, CAST(floor((f - y) * 2 - 0.5::DOUBLE) AS INTEGER) + j AS row
  FROM back JOIN r USING (raster_id), range(0, 2) s(i), range(0, 2) t(j)
), weighed AS (
  SELECT n.*, p.v AS value, greatest(0, 1 - abs(u - n.col - 0.5::DOUBLE)) * greatest(0, 1 - abs(n.v - n.row - 0.5::DOUBLE)) AS k
  FROM near n JOIN pixels p ON p.raster_id = n.raster_id AND p.row = n.row AND p.col = n.col
  WHERE u BETWEEN 0 AND 8 AND n.v BETWEEN 0 AND 8
)
SELECT raster_id, out_row, out_col, round(sum(k * value) / sum(k), 3) + 0.0 AS v FROM weighed WHERE k > 0 GROUP BY ALL
""")
def reprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).select("raster_id", "row", "col", "v")
    r = shifted(spark, sf_dir).withColumn("c", F.col("c") + 608082.0).withColumn(
        "f", F.col("f") + 4265350.0).drop("plot_order")
    zone = F.lit(32610)

    def to_degrees(x, y):
        at = from_utm(x, y, zone)
        return F.struct(at["lon"].alias("x"), at["lat"].alias("y"))

    out = reproject_raster(p, r, ["v"], to_degrees, lambda x, y: to_utm(x, y, zone), 5e-6)
    return out.withColumn("v", F.round("v", 3) + 0.0)


# Odd rasters lie half a pixel off the grid: their values are means of two neighbours.
@work.query("resample_half_pixel", f"""
WITH {PIXELS_SQL}
SELECT raster_id, CAST(row AS BIGINT) AS out_row, CAST(col AS BIGINT) AS out_col, round(v, 6) + 0.0 AS v
FROM pixels WHERE raster_id % 2 = 0
UNION ALL
SELECT raster_id, CAST(row AS BIGINT), c, round(avg(v), 6) + 0.0
FROM (SELECT *, unnest([col, col + 1]) AS c FROM pixels WHERE raster_id % 2 = 1) GROUP BY raster_id, row, c
""")
def half_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).select("raster_id", "row", "col", "v")
    r = shifted(spark, sf_dir).drop("plot_order").withColumn("a", F.lit(1.0)).withColumn(
        "e", F.lit(-1.0)).withColumn("c", F.col("raster_id") % 2 * 0.5).withColumn("f", F.lit(8.0))
    plain = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    out = reproject_raster(p, r, ["v"], plain, plain, 1.0)
    return out.select("raster_id", "out_row", "out_col", (F.round("v", 6) + 0.0).alias("v"))


def affine_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    gt = F.array(*[F.lit(float(v)) for v in (100, 0.5, 0, 50, 0, -0.5)])
    return e.select(F.col("vec_id").alias("raster_id"), gt.alias("geotransform"),
                    F.lit(8).alias("width"), F.lit(8).alias("height"))


@work.query("nearest_pixel", f"""
WITH {PIXELS_SQL}, s AS (SELECT count(*) AS n FROM embeddings), spot AS (
  SELECT event_id, event_id % n AS raster_id, 99 + user_id % 50 / 10.0 AS x, 45 + value % 6 AS y FROM events, s
)
SELECT event_id, round(v, 6) AS v FROM spot AS p JOIN pixels q ON q.raster_id = p.raster_id
  AND q.col = greatest(0, least(7, floor((x - 100) / 0.5 + 0.5)))
  AND q.row = greatest(0, least(7, floor((y - 50) / -0.5 + 0.5)))
""")
def pixel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").select(F.count("*")).scalar()
    places = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % n).alias("raster_id"),
        (99 + F.col("user_id") % 50 / 10.0).alias("x"), (45 + F.col("value") % 6).alias("y"))
    found = nearest_pixel(places, pixels(spark, sf_dir).select("raster_id", "row", "col", "v"),
                          affine_rasters(spark, sf_dir))
    return found.select("event_id", F.round("v", 6).alias("v"))


@work.query("raster_windows", f"""
WITH {PIXELS_SQL}
SELECT label AS window_id, raster_id, row, col FROM pixels
WHERE col BETWEEN label % 4 AND label % 4 + 3 AND row BETWEEN 2 AND 5
""")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("window_id"), F.col("vec_id").alias("raster_id"), (F.col("label") % 4).alias("col1"),
        F.lit(2).alias("row1"), (F.col("label") % 4 + 3).alias("col2"), F.lit(5).alias("row2"))
    return raster_window(pixels(spark, sf_dir).select("raster_id", "row", "col"), w)


@work.query("world_box_to_window", """
WITH w AS (
  SELECT event_id, value AS x, 500 - value AS y, user_id / 10.0 AS w, user_id / 7.0 AS h FROM events
), i AS (
  SELECT event_id, greatest(0, least(CAST(trunc((x - 50) / 0.25) AS INTEGER), 999)) AS col1,
         greatest(0, least(CAST(trunc((y - 480) / -0.25) AS INTEGER), 799)) AS row1,
         greatest(0, least(CAST(trunc((x + w - 50) / 0.25) AS INTEGER), 999)) AS col2,
         greatest(0, least(CAST(trunc((y - h - 480) / -0.25) AS INTEGER), 799)) AS row2 FROM w
)
SELECT *, col1 <= col2 AND row1 <= row2 AS valid FROM i
""")
def box_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    gt = F.array(*[F.lit(float(v)) for v in (50, 0.25, 0, 480, 0, -0.25)])
    return e.select("event_id", world_window(
        F.col("value"), 500 - F.col("value"), F.col("user_id") / 10.0, F.col("user_id") / 7.0, gt,
        F.lit(1000), F.lit(800)).alias("w")).select("event_id", "w.*")


@work.query("plot_crop_windows", f"""
WITH {PLOTS_SQL}, edge AS (
  SELECT ordinal, plot AS field, accession, unnest([
    {{'lon': x0 + w * i / 20.0::DOUBLE, 'lat': y0}}, {{'lon': x0 + w * i / 20.0::DOUBLE, 'lat': y0 + h}},
    {{'lon': x0, 'lat': y0 + h * i / 20.0::DOUBLE}}, {{'lon': x0 + w, 'lat': y0 + h * i / 20.0::DOUBLE}}]) AS p
  FROM plots, range(0, 21) t(i)
), {utm_sql('flat', 'edge', 'p.lon', 'p.lat')}, box AS (
  SELECT field, ordinal, accession, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM flat GROUP BY ALL
), pad AS (SELECT *, greatest(0.1::DOUBLE, (x1 - x0) * 0.1) AS px, greatest(0.1::DOUBLE, (y1 - y0) * 0.1) AS py FROM box)
SELECT field, CAST(ordinal AS VARCHAR) AS plot, accession, 'ortho-' || field AS raster_id,
       round((x0 - px - 608000) / 0.01::DOUBLE, 2) AS col_off, round((4265500 - y1 - py) / 0.01::DOUBLE, 2) AS row_off,
       round((x1 - x0 + 2 * px) / 0.01::DOUBLE, 2) AS width, round((y1 - y0 + 2 * py) / 0.01::DOUBLE, 2) AS height FROM pad
""")
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one orthomosaic per brand
    rasters = table(spark, sf_dir, "part").select(F.col("p_brand").alias("field")).distinct().select(
        "field", F.concat(F.lit("ortho-"), "field").alias("raster_id"), F.lit(32610).alias("epsg"),
        F.array(*[F.lit(float(v)) for v in (608000, 0.01, 0, 4265500, 0, -0.01)]).alias("geotransform"))
    areas = plots(spark, sf_dir).select(
        F.col("plot").alias("field"), F.col("ordinal").cast("string").alias("plot"), "accession", "ring")
    out = plot_windows(areas, rasters, ["field"])
    return out.withColumns({n: F.round(n, 2) for n in ("col_off", "row_off", "width", "height")})


# --- camera pixels


CELSIUS_SQL = """
SELECT event_id, round(b / ln(r1 / (0.0125 * (seen + o)) + 1) - 273.15, 3) + 0.0 AS celsius FROM (
  SELECT *, raw / 0.95 / tau / tau - (1 - tau) / 0.95 / tau * air - (1 - tau) / 0.95 / tau / tau * air
         - (1 - 0.95) / 0.95 * (r1 / (0.0125 * (exp(b / (25 + 273.15)) - 1)) - o) AS seen
  FROM (
    SELECT *, r1 / (0.0125 * (exp(b / (20 + 273.15)) - 1)) - o AS air,
           1.9 * exp(-sqrt(10 / 2.0) * (0.006569 - 0.002276 * sqrt(water)))
             - 0.9 * exp(-sqrt(10 / 2.0) * (0.01262 - 0.00667 * sqrt(water))) AS tau
    FROM (
      SELECT event_id, 12000 + value * 10 AS raw, 12755.36::DOUBLE AS r1, 1435.0::DOUBLE AS b, -6706.86::DOUBLE AS o,
             (user_id % 60 + 20) / 100.0 * exp(1.5587 + 0.06939 * 20 - 0.00027816 * 400 + 0.00000068455 * 8000) AS water
      FROM events)))
"""


@work.query("thermal_counts_to_celsius", CELSIUS_SQL)
def celsius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = raw_to_celsius(
        12000 + F.col("value") * 10, F.lit(0.95), F.lit(10.0), F.lit(25.0), F.lit(20.0), F.lit(20.0), F.lit(1.0),
        F.col("user_id") % 60 + 20, F.lit(12755.36), F.lit(1435.0), F.lit(1.0), F.lit(-6706.86), F.lit(0.0125))
    return e.select("event_id", (F.round(value, 3) + 0.0).alias("celsius"))


@work.query("thermal_raw_fixes", """
WITH raw AS (SELECT event_id, user_id, CAST(floor(value * 30) AS INTEGER) AS c FROM events),
s AS (SELECT *, (c >> 8) + ((c & 255) << 8) AS swapped FROM raw),
m AS (SELECT user_id, max(c) AS top FROM s GROUP BY user_id)
SELECT event_id, swapped, round(CASE WHEN top < 7500 THEN c * CAST(3.356422717437227 AS DOUBLE) + CAST(-1404.6130301150079 AS DOUBLE) ELSE c END, 6) AS fixed
FROM s JOIN m USING (user_id)
""")
def thermal_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("raster_id"), F.floor(F.col("value") * 30).cast("int").alias("raw"))
    e = e.withColumn("swapped", swap_bytes(F.col("raw")))
    return fix_raw_thermal(e).select("event_id", "swapped", F.round("raw", 6).alias("fixed"))


@work.query("camera_calibration_lookup", """
SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN 21106.77 ELSE s_acctbal END AS "PlanckR1",
       CASE WHEN s_suppkey IS NULL THEN -7340.0 ELSE -s_acctbal END AS "PlanckO"
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("CameraSerialNumber"),
        F.lit(21106.77).alias("PlanckR1"), F.lit(-7340.0).alias("PlanckO"))
    known = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("SN"),
        F.col("s_acctbal").alias("PR1"), (-F.col("s_acctbal")).alias("PO"))
    return apply_calibration(meta, known).select("c_custkey", "PlanckR1", "PlanckO")


@work.query("disparity_to_points", f"""
WITH {PIXELS_SQL}, z AS (SELECT *, CAST(0.075 AS DOUBLE) * 1400 / (r + CAST(1e-8 AS DOUBLE)) AS z FROM pixels WHERE r > 0)
SELECT raster_id, row, col, round((col - 4) * z / 1400, 6) AS x, round((row - 3.5) * z / 1350, 6) AS y, round(z, 6) AS z FROM z
""")
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).where(F.col("r") > 0)
    xyz = disparity_to_xyz(F.col("col"), F.col("row"), F.col("r"), F.lit(1400.0), F.lit(1350.0), F.lit(4.0), F.lit(3.5))
    return p.withColumn("p", xyz).select(
        "raster_id", "row", "col", *[F.round(f"p.{c}", 6).alias(c) for c in ("x", "y", "z")])


@work.query("cloud_turned_to_heading", f"""
WITH {PIXELS_SQL}, h AS (SELECT *, ['North', 'East', 'South', 'West'][raster_id % 4 + 1] AS heading FROM pixels)
SELECT raster_id, row AS from_row, col AS from_col,
       CASE heading WHEN 'North' THEN 7 - row WHEN 'East' THEN col WHEN 'West' THEN 7 - col ELSE row END AS row,
       CASE heading WHEN 'North' THEN 7 - col WHEN 'East' THEN 7 - row WHEN 'West' THEN row ELSE col END AS col,
       round(CASE heading WHEN 'North' THEN v ELSE -v END + 608.25, 6) AS x, round(g + 4265.5, 6) AS y
FROM h
""")
def turned_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in ("North", "East", "South", "West")])
    heading = F.get(names, (F.col("raster_id") % 4).cast("int"))
    cloud = orient_cloud(heading, F.col("row"), F.col("col"), F.lit(8), F.lit(8), F.col("v"), F.col("g"),
                         F.col("b"), F.lit(608.25), F.lit(4265.5))
    return p.select("raster_id", F.col("row").alias("from_row"), F.col("col").alias("from_col"),
                    cloud.alias("c")).select(
        "raster_id", "from_row", "from_col", "c.row", "c.col", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@work.query("thermal_window_in_visible", """
WITH m AS (
  SELECT event_id, user_id % 2 = 0 AS turned, 1 + user_id % 10 / 10.0 AS s, CAST(user_id % 9 AS INTEGER) AS ox, CAST(event_id % 13 AS INTEGER) AS oy FROM events
), n AS (
  SELECT *, CASE WHEN turned THEN 1080 ELSE 1440 END AS w, CASE WHEN turned THEN 1440 ELSE 1080 END AS h,
         CASE WHEN turned THEN oy ELSE ox END AS shift FROM m
)
SELECT event_id, CAST(trunc(w / 2.0 - w / s / 2) AS INTEGER) + shift AS x1, CAST(trunc(h / 2.0 - h / s / 2) AS INTEGER) + 32 AS y1,
       CAST(trunc(w / 2.0 + w / s / 2) AS INTEGER) + shift AS x2, CAST(trunc(h / 2.0 + h / s / 2) AS INTEGER) + 32 AS y2 FROM n
""")
def thermal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    landscape = F.col("user_id") % 2 == 0
    w = ir_crop_window(
        F.lit(1440), F.lit(1080), 1 + F.col("user_id") % 10 / 10.0, F.col("user_id") % 9, F.col("event_id") % 13,
        F.when(landscape, 640).otherwise(480), F.when(landscape, 480).otherwise(640))
    return e.select("event_id", w.alias("w")).select("event_id", "w.*")
