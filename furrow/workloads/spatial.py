"""Spatial joins: event positions against boxes, triangles and points derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.geo import (
    from_utm, geodesic_m, heading_direction, line_to_quad, to_utm, to_web_mercator, utm_epsg)
from furrow.operators.plots import image_query
from furrow.operators.spatial import (
    associate_plots, match_borders, max_overlap_join, nearest_within, pip_first, pip_join,
    select_gcp_images)
from furrow.workloads import Workload
from furrow.workloads.tables import TRACK_SQL, table, track

work = Workload()

# Every part is a plot: a box 6 columns wide for even keys, a triangle for odd ones.
# Neighbours overlap; the field grows with the number of plots, so their density stays.
PLOTS_SQL = """
plots AS (
  SELECT p_partkey AS ordinal, p_brand AS plot, p_type AS accession,
         CAST(-121.76 AS DOUBLE) + (p_partkey % 60) * CAST(1e-5 AS DOUBLE) + CAST(5e-7 AS DOUBLE) AS x0,
         CAST(38.53 AS DOUBLE) + (p_partkey // 60) * CAST(4e-5 AS DOUBLE) + CAST(5e-9 AS DOUBLE) AS y0,
         p_size * CAST(1e-6 AS DOUBLE) AS w, p_size * CAST(2e-6 AS DOUBLE) AS h,
         p_partkey % 2 = 0 AS is_box
  FROM part
)"""
# strictly inside the box or the lower-left triangle
INSIDE_SQL = """
(CASE WHEN is_box THEN lon > x0 AND lon < x0 + w AND lat > y0 AND lat < y0 + h
      ELSE lon > x0 AND lat > y0
           AND (x0 - (x0 + w)) * (lat - y0) - (y0 + h - y0) * (lon - (x0 + w)) > 0 END)"""


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    x0 = F.lit(-121.76) + (key % 60) * 1e-5 + 5e-7
    y0 = F.lit(38.53) + F.floor(key / 60) * 4e-5 + 5e-9
    w, h = F.col("p_size") * 1e-6, F.col("p_size") * 2e-6
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = F.array(point(x0, y0), point(x0 + w, y0), point(x0 + w, y0 + h), point(x0, y0 + h), point(x0, y0))
    triangle = F.array(point(x0, y0), point(x0 + w, y0), point(x0, y0 + h), point(x0, y0))
    return p.select(
        key.alias("ordinal"), F.col("p_brand").alias("plot"), F.col("p_type").alias("accession"),
        F.when(key % 2 == 0, box).otherwise(triangle).alias("ring"))


@work.query("point_in_polygon", f"""
WITH {TRACK_SQL}, {PLOTS_SQL}
SELECT event_id, ordinal, plot FROM track, plots WHERE {INSIDE_SQL}
""")
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = track(spark, sf_dir).select("event_id", "lon", "lat")
    return pip_join(points, plots(spark, sf_dir).select("ordinal", "plot", "ring")).select(
        "event_id", "ordinal", "plot")


@work.query("first_containing_polygon", f"""
WITH {TRACK_SQL}, {PLOTS_SQL}, f AS (
  SELECT event_id, min(ordinal) AS ordinal FROM track, plots WHERE {INSIDE_SQL} GROUP BY event_id)
SELECT event_id, coalesce(ordinal, -1) AS ordinal, p_brand AS plot
FROM events LEFT JOIN f USING (event_id) LEFT JOIN part ON p_partkey = ordinal
""")
def first_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = track(spark, sf_dir).select("event_id", "lon", "lat")
    out = pip_first(points, plots(spark, sf_dir).select("ordinal", "plot", "ring"),
                    ["event_id"], "ordinal")
    return out.select("event_id", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), "plot")


@work.query("middle_image_per_plot", f"""
WITH {TRACK_SQL}, {PLOTS_SQL}, hit AS (
  SELECT event_id, stamp, plot, accession FROM track, plots WHERE {INSIDE_SQL}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY plot ORDER BY stamp, event_id, accession) - 1 AS k,
         count(*) OVER (PARTITION BY plot) AS n FROM hit)
SELECT 'top/rgb-' || stamp || '.jpg' AS image_name, accession AS label, plot
FROM ranked WHERE k = n // 2
""")
def middle_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = track(spark, sf_dir).select(
        "event_id", "stamp", "lon", "lat",
        F.concat(F.lit("top/rgb-"), F.col("stamp").cast("string"), F.lit(".jpg")).alias("image_name"))
    areas = plots(spark, sf_dir).select(F.col("accession").alias("label"), "plot", "ring")
    return image_query(images, areas, middle_by=["stamp", "event_id", "label"])


@work.query("images_in_plots", f"""
WITH {TRACK_SQL}, {PLOTS_SQL}
SELECT 'top/rgb-' || stamp || '.jpg' AS image_name, accession AS label, plot
FROM track, plots WHERE {INSIDE_SQL}
""")
def images_in_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = track(spark, sf_dir).select(
        "lon", "lat",
        F.concat(F.lit("top/rgb-"), F.col("stamp").cast("string"), F.lit(".jpg")).alias("image_name"))
    areas = plots(spark, sf_dir).select(F.col("accession").alias("label"), "plot", "ring")
    return image_query(images, areas)


# integral of a height held between 0 and {top}, over a side on which it falls from {v} to 0
HELD_SQL = ("(CASE WHEN {v} <= 0 THEN 0 WHEN {v} < {top} THEN {v} * {v} / 2 "
            "ELSE {top} * {top} / 2 + {top} * ({v} - {top}) END)")


# Footprints from events; under a triangle's long side the height falls along x.
@work.query("max_overlap_plot", f"""
WITH {TRACK_SQL}, {PLOTS_SQL}, near AS (
  SELECT event_id, ordinal, is_box, w * 1e6 AS w, h * 1e6 AS h,
         (greatest(lon, x0) - x0) * 1e6 AS a, (least(lon + 3e-6, x0 + w) - x0) * 1e6 AS b,
         (greatest(lat, y0) - y0) * 1e6 AS c, (least(lat + 5e-6, y0 + h) - y0) * 1e6 AS d
  FROM track, plots
  WHERE lon < x0 + w AND lon + CAST(3e-6 AS DOUBLE) > x0
    AND lat < y0 + h AND lat + CAST(5e-6 AS DOUBLE) > y0
), o AS (
  SELECT event_id, ordinal, CASE WHEN is_box THEN (b - a) * (d - c)
         ELSE w / h * ({HELD_SQL.format(v="(h - h / w * a - c)", top="(d - c)")}
                       - {HELD_SQL.format(v="(h - h / w * b - c)", top="(d - c)")}) END AS area FROM near
), best AS (SELECT event_id, max(area) AS area FROM o GROUP BY event_id)
SELECT event_id, round(coalesce(area, 0), 5) AS overlap FROM events LEFT JOIN best USING (event_id)
""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = track(spark, sf_dir).select(
        "event_id", F.col("lon").alias("x0"), F.col("lat").alias("y0"),
        (F.col("lon") + 3e-6).alias("x1"), (F.col("lat") + 5e-6).alias("y1"))
    areas = plots(spark, sf_dir).select("ordinal", "ring")
    out = max_overlap_join(images, areas, ["event_id"], "ordinal")
    return out.select("event_id", F.round(F.coalesce(F.col("overlap") * 1e12, F.lit(0.0)), 5).alias("overlap"))


GCP_SQL = """
gcps AS (
  SELECT s_suppkey AS ordinal, s_name AS label,
         CAST(38.53 AS DOUBLE) + s_suppkey * CAST(2e-6 AS DOUBLE) + s_acctbal * CAST(1e-10 AS DOUBLE) AS lat,
         CAST(-121.76 AS DOUBLE) + s_nationkey * CAST(2e-5 AS DOUBLE) AS lon
  FROM supplier
)"""
# metres by the radii of curvature at the mean latitude; exact to micrometres at field size
METRES_SQL = """
sqrt(pow(radians({lon2} - {lon1}) * cos(radians(({lat1} + {lat2}) / 2)) * 6378137.0
       / sqrt(1 - 0.0066943799901413165 * pow(sin(radians(({lat1} + {lat2}) / 2)), 2)), 2)
   + pow(radians({lat2} - {lat1}) * 6378137.0 * (1 - 0.0066943799901413165)
       / pow(1 - 0.0066943799901413165 * pow(sin(radians(({lat1} + {lat2}) / 2)), 2), 1.5), 2))"""


def gcps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("label"),
        (F.lit(38.53) + F.col("s_suppkey") * 2e-6 + F.col("s_acctbal") * 1e-10).alias("lat"),
        (F.lit(-121.76) + F.col("s_nationkey") * 2e-5).alias("lon"))


_GAP = METRES_SQL.format(lat1="t.lat", lon1="t.lon", lat2="g.lat", lon2="g.lon")


@work.query("nearest_gcp_within_radius", f"""
WITH {TRACK_SQL}, {GCP_SQL}, d AS (
  SELECT event_id, g.ordinal, g.label, {_GAP} AS m FROM track t, gcps g
)
SELECT event_id, round(min(m), 4) AS distance, arg_min(label, m) AS label FROM d WHERE m <= 2.0 GROUP BY event_id
""")
def nearest_gcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = track(spark, sf_dir).select("event_id", "lat", "lon")
    out = nearest_within(images, gcps(spark, sf_dir), 2.0, ["event_id"], ["ordinal"])
    return out.select("event_id", F.round("r_distance", 4).alias("distance"), F.col("r_label").alias("label"))


@work.query("gcp_image_selection", f"""
WITH {TRACK_SQL}, {GCP_SQL}, d AS (
  SELECT event_id, g.label, {_GAP} AS m FROM track t, gcps g WHERE t.value >= 2
), hit AS (
  SELECT event_id, arg_min(label, m) AS gcp_label FROM d WHERE m <= 1.0 GROUP BY event_id
)
SELECT * FROM hit UNION ALL SELECT event_id, 'N/A' FROM track WHERE value < 2
""")
def gcp_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = track(spark, sf_dir).select(
        "event_id", F.when(F.col("value") >= 2, F.col("lat")).alias("lat"), "lon")
    return select_gcp_images(images, gcps(spark, sf_dir), 1.0, ["event_id"], ["ordinal"]).select(
        "event_id", "gcp_label")


# Borders run from one order's position to the position of its priority's line.
BORDER_SQL = f"""
borders AS (
  SELECT o_orderkey AS plot_index,
         CAST(38.53 AS DOUBLE) + (o_orderkey % 40000) * CAST(1e-8 AS DOUBLE) AS start_lat,
         CAST(-121.76 AS DOUBLE) + (o_custkey % 600) * CAST(1e-6 AS DOUBLE) AS start_lon,
         CAST(38.53 AS DOUBLE) + (o_custkey % 30000) * CAST(1e-8 AS DOUBLE) AS end_lat,
         CAST(-121.76 AS DOUBLE) + (o_orderkey % 590) * CAST(1e-6 AS DOUBLE) AS end_lon
  FROM orders
)"""


def borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("plot_index"),
        (F.lit(38.53) + (key % 40000) * 1e-8).alias("start_lat"),
        (F.lit(-121.76) + (cust % 600) * 1e-6).alias("start_lon"),
        (F.lit(38.53) + (cust % 30000) * 1e-8).alias("end_lat"),
        (F.lit(-121.76) + (key % 590) * 1e-6).alias("end_lon"))


def _nearest_end(end: str) -> str:
    metres = METRES_SQL.format(lat1=f"{end}_lat", lon1=f"{end}_lon", lat2="s.lat", lon2="s.lon")
    degrees = f"pow(s.lat - {end}_lat, 2) + pow(s.lon - {end}_lon, 2)"
    return f"""
{end}_hit AS (
  SELECT plot_index, arg_min(s.event_id, ({degrees}, s.event_id)) AS {end}_event_id,
         arg_min({metres}, ({degrees}, s.event_id)) AS m
  FROM borders JOIN spots s ON s.lat BETWEEN {end}_lat - 2e-5 AND {end}_lat + 2e-5
    AND s.lon BETWEEN {end}_lon - 2e-5 AND {end}_lon + 2e-5
  GROUP BY plot_index
)"""


@work.query("borders_to_images", f"""
WITH {TRACK_SQL}, {BORDER_SQL},
spots AS (SELECT lat, lon, min(event_id) AS event_id FROM track GROUP BY lat, lon),
{_nearest_end('start')}, {_nearest_end('end')}
SELECT plot_index, start_event_id, end_event_id
FROM start_hit a JOIN end_hit b USING (plot_index) WHERE a.m <= 0.25 AND b.m <= 0.25
""")
def borders_to_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = track(spark, sf_dir).select("event_id", "lat", "lon")
    return match_borders(borders(spark, sf_dir), images, "event_id").select(
        "plot_index", "start_event_id", "end_event_id")


# One boundary per brand and box column, laid side by side: at most one holds a centre.
@work.query("associate_plots_one_to_one", f"""
WITH {TRACK_SQL}, centers AS (
  SELECT user_id AS plot_index, min(event_id) AS seen, avg(lon) AS lon, avg(lat) AS lat
  FROM track GROUP BY user_id
), cells AS (
  SELECT n_nationkey AS ordinal, n_name AS plot,
         CAST(-121.76 AS DOUBLE) + n_nationkey * CAST(4e-5 AS DOUBLE) AS x0 FROM nation
), hit AS (
  SELECT c.plot_index, c.seen, b.plot, b.plot || '_None' AS boundary_key
  FROM centers c JOIN cells b ON c.lon > b.x0 AND c.lon < b.x0 + CAST(4e-5 AS DOUBLE)
   AND c.lat > CAST(38.529 AS DOUBLE) AND c.lat < CAST(38.531 AS DOUBLE)
)
SELECT arg_min(plot_index, seen) AS plot_index, boundary_key, plot FROM hit GROUP BY boundary_key, plot
""")
def associate(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = track(spark, sf_dir).groupBy(F.col("user_id").alias("plot_index")).agg(
        F.min("event_id").alias("seen"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    x0 = F.lit(-121.76) + F.col("n_nationkey") * 4e-5
    point = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    cells = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("plot"),
        F.lit(None).cast("string").alias("accession"),
        F.array(point(x0, 38.529), point(x0 + 4e-5, 38.529), point(x0 + 4e-5, 38.531),
                point(x0, 38.531), point(x0, 38.529)).alias("ring"))
    return associate_plots(centers, cells).select("plot_index", "boundary_key", "plot")


# Boundaries three columns wide that overlap their neighbours: plots compete for them.
@work.query("associate_plots_overlapping", f"""
WITH {TRACK_SQL}, centers AS (
  SELECT user_id AS plot_index, min(event_id) AS seen, avg(lon) AS lon, avg(lat) AS lat
  FROM track GROUP BY user_id
), cells AS (
  SELECT c_custkey AS ordinal, 'c' || c_custkey // 2 AS plot,
         CAST(-121.76 AS DOUBLE) + c_custkey % 400 * CAST(3e-6 AS DOUBLE) AS x0 FROM customer
), hit AS (
  SELECT c.plot_index, min(c.seen) AS seen, b.plot || '_None' AS k, min(b.ordinal) AS ordinal
  FROM centers c JOIN cells b ON c.lon > b.x0 AND c.lon < b.x0 + CAST(9e-6 AS DOUBLE)
   AND c.lat > CAST(38.529 AS DOUBLE) AND c.lat < CAST(38.531 AS DOUBLE) GROUP BY c.plot_index, k
), turns AS (
  SELECT seen, plot_index AS p, list(k ORDER BY ordinal, k) AS ks FROM hit GROUP BY ALL
), settled AS (
  SELECT list_reduce(list({{p: p, ks: ks}} ORDER BY seen, p), lambda done, turn: list_append(done, {{p: turn.p,
      ks: list_filter(turn.ks, lambda k: NOT list_contains(list_transform(done, lambda d: d.ks[1]), k))[1:1]}}),
    list({{p: p, ks: ks}} ORDER BY seen, p)[1:0]) AS done FROM turns
)
SELECT d.p AS plot_index, d.ks[1] AS boundary_key FROM (SELECT unnest(done) AS d FROM settled) WHERE len(d.ks) > 0
""")
def associate_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = track(spark, sf_dir).groupBy(F.col("user_id").alias("plot_index")).agg(
        F.min("event_id").alias("seen"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    x0 = F.lit(-121.76) + F.col("c_custkey") % 400 * 3e-6
    point = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    cells = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ordinal"), F.concat(F.lit("c"), F.expr("c_custkey div 2")).alias("plot"),
        F.lit(None).cast("string").alias("accession"),
        F.array(point(x0, 38.529), point(x0 + 9e-6, 38.529), point(x0 + 9e-6, 38.531),
                point(x0, 38.531), point(x0, 38.529)).alias("ring"))
    return associate_plots(centers, cells).select("plot_index", "boundary_key")


@work.query("geodesic_distance", f"""
WITH {TRACK_SQL}
SELECT event_id, round({METRES_SQL.format(lat1='38.53', lon1='-121.7598', lat2='lat', lon2='lon')}, 4) AS metres
FROM track
""")
def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir)
    return t.select("event_id", F.round(
        geodesic_m(F.lit(38.53), F.lit(-121.7598), F.col("lat"), F.col("lon")), 4).alias("metres"))


@work.query("utm_round_trip", f"""
WITH {TRACK_SQL}
SELECT event_id, 32600 + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS epsg,
       round(lon, 8) AS lon, round(lat, 8) AS lat FROM track
""")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir).withColumn("epsg", utm_epsg(F.col("lon"), F.col("lat")))
    t = t.withColumn("u", to_utm(F.col("lon"), F.col("lat"), F.col("epsg")))
    t = t.withColumn("b", from_utm(F.col("u.x"), F.col("u.y"), F.col("epsg")))
    return t.select("event_id", "epsg", F.round("b.lon", 8).alias("lon"), F.round("b.lat", 8).alias("lat"))


@work.query("web_mercator", f"""
WITH {TRACK_SQL}
SELECT event_id, round(6378137.0 * radians(lon), 4) AS x,
       round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y FROM track
""")
def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir).withColumn("m", to_web_mercator(F.col("lon"), F.col("lat")))
    return t.select("event_id", F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"))


@work.query("heading_to_direction", """
WITH h AS (SELECT event_id, (degrees(value / 50.0 - 4) % 360 + 360) % 360 AS d FROM events)
SELECT event_id, CASE WHEN d > 315 OR d <= 45 THEN 'North' WHEN d <= 135 THEN 'East'
                      WHEN d <= 225 THEN 'South' ELSE 'West' END AS direction FROM h
""")
def heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", heading_direction(F.col("value") / 50.0 - 4).alias("direction"))


@work.query("border_line_to_quad", f"""
WITH {BORDER_SQL}
SELECT plot_index,
       round(start_lon - CAST(1e-5 AS DOUBLE), 9) AS x1, round(start_lat - CAST(1e-5 AS DOUBLE), 9) AS y1,
       round(start_lon + CAST(1e-5 AS DOUBLE), 9) AS x2, round(start_lat + CAST(1e-5 AS DOUBLE), 9) AS y2,
       round(end_lon + CAST(1e-5 AS DOUBLE), 9) AS x3, round(end_lat + CAST(1e-5 AS DOUBLE), 9) AS y3,
       round(end_lon - CAST(1e-5 AS DOUBLE), 9) AS x4, round(end_lat - CAST(1e-5 AS DOUBLE), 9) AS y4
FROM borders
""")
def quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = borders(spark, sf_dir).withColumn("q", line_to_quad(
        F.col("start_lon"), F.col("start_lat"), F.col("end_lon"), F.col("end_lat")))
    at = lambda i, axis: F.round(F.get("q", F.lit(i))[axis], 9)
    return b.select("plot_index", *[at(i, c).alias(f"{c}{i + 1}") for i in range(4) for c in ("x", "y")])
