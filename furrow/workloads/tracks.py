"""Track geometry: one track per user over events, in a local plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.georef import (
    apply_affine, axis_extents, corrected_length, cross_track, fit_affine, georeference_plots,
    to_plane, track_direction, track_heading, track_length)
from furrow.workloads import Workload
from furrow.workloads.tables import DAY, TRACK_SQL, table, track, utm_sql

work = Workload()

# x, y in a plane that needs no projection, so that SQL can follow
PLANE_SQL = f"""{TRACK_SQL}, plane AS (
  SELECT user_id, event_id, stamp, lat, lon, CAST(event_id % 97 AS DOUBLE) AS x, value / 5 AS y FROM track
), shape AS (
  SELECT user_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, arg_min(x, stamp) AS fx, arg_min(y, stamp) AS fy,
         arg_max(x, stamp) AS lx, arg_max(y, stamp) AS ly,
         var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy FROM plane GROUP BY user_id
), ang AS (
  SELECT *, 0.5 * atan2(2 * vxy, vx - vy) AS axis, atan2(ly - fy, lx - fx) AS simple FROM shape
), pca AS (
  SELECT *, CASE WHEN cos(axis) * (lx - fx) + sin(axis) * (ly - fy) < 0 THEN axis + pi() ELSE axis END AS p FROM ang
), off AS (
  SELECT *, (degrees(p - simple) % 180 + 180) % 180 AS o FROM pca
), head AS (
  SELECT *, CASE WHEN least(o, 180 - o) > 30 THEN simple ELSE p END AS theta FROM off
)"""


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir)
    return t.select("user_id", "event_id", "stamp", "lat", "lon",
                    (F.col("event_id") % 97).cast("double").alias("x"), (F.col("value") / 5).alias("y"))


@work.query("track_heading", f"""
WITH {PLANE_SQL}
SELECT user_id, n AS points, round(cos(p), 6) AS pca_cos, round(sin(p), 6) AS pca_sin,
       round(cos(theta), 6) AS cos, round(sin(theta), 6) AS sin FROM head
""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = track_heading(plane(spark, sf_dir), ["user_id"], "stamp")
    return h.select("user_id", "points", F.round(F.cos("pca_theta"), 6).alias("pca_cos"),
                    F.round(F.sin("pca_theta"), 6).alias("pca_sin"),
                    F.round(F.cos("theta"), 6).alias("cos"), F.round(F.sin("theta"), 6).alias("sin"))


_EXTENT_SQL = f"""{PLANE_SQL}, uv AS (
  SELECT user_id, (x - cx) * cos(theta) + (y - cy) * sin(theta) AS u,
         (y - cy) * cos(theta) - (x - cx) * sin(theta) AS v FROM plane JOIN head USING (user_id)
), ext AS (
  SELECT user_id, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, stddev_pop(v) AS vs
  FROM uv GROUP BY user_id
)"""


@work.query("track_extents", f"""
WITH {_EXTENT_SQL}
SELECT user_id, round(u0 - (u1 - u0) * 0.025, 5) AS u_min, round(u1 + (u1 - u0) * 0.025, 5) AS u_max,
       round(v0 - (v1 - v0) * 0.025, 5) AS v_min, round(v1 + (v1 - v0) * 0.025, 5) AS v_max FROM ext
""")
def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plane(spark, sf_dir)
    e = axis_extents(p, track_heading(p, ["user_id"], "stamp"), ["user_id"], 0.05)
    return e.select("user_id", *[F.round(c, 5).alias(c) for c in ("u_min", "u_max", "v_min", "v_max")])


_LENGTH_SQL = f"""{PLANE_SQL}, s AS (
  SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step
  FROM plane WINDOW w AS (PARTITION BY user_id ORDER BY stamp)
), len AS (
  SELECT user_id, sqrt(pow(arg_max(x, stamp) - arg_min(x, stamp), 2)
                       + pow(arg_max(y, stamp) - arg_min(y, stamp), 2)) AS direct,
         coalesce(sum(step), 0) AS path, avg(step) AS mean_spacing, stddev_pop(step) AS std_spacing
  FROM s GROUP BY user_id
)"""


@work.query("track_length", f"""
WITH {_LENGTH_SQL}
SELECT user_id, round(direct, 5) AS direct, round(path, 5) AS path,
       round(mean_spacing, 5) AS mean_spacing, round(std_spacing, 5) AS std_spacing FROM len
""")
def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = track_length(plane(spark, sf_dir), ["user_id"], "stamp")
    return out.select("user_id", *[F.round(c, 5).alias(c) for c in (
        "direct", "path", "mean_spacing", "std_spacing")])


@work.query("track_direction", f"""
WITH {PLANE_SQL}, d AS (
  SELECT user_id, arg_max(lat, stamp) - arg_min(lat, stamp) AS dlat, arg_max(lon, stamp) - arg_min(lon, stamp) AS dlon,
         arg_max(x, stamp) - arg_min(x, stamp) AS dx, arg_max(y, stamp) - arg_min(y, stamp) AS dy
  FROM plane GROUP BY user_id
)
SELECT user_id,
       CASE WHEN abs(dlat) > abs(dlon) THEN CASE WHEN dlat > 0 THEN 'NORTH' ELSE 'SOUTH' END
            WHEN dlon > 0 THEN 'EAST' ELSE 'WEST' END AS rover_direction,
       CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN dx > 0 THEN 'RIGHT' ELSE 'LEFT' END
            WHEN dy > 0 THEN 'UP' ELSE 'DOWN' END AS stitch_direction
FROM d
""")
def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_direction(plane(spark, sf_dir), ["user_id"], "stamp")


@work.query("cross_track_height", f"""
WITH {_EXTENT_SQL}
SELECT user_id, round(greatest(v1 - v0, 40), 5) AS fixed, round(greatest(v1 - v0, 5 * vs), 5) AS std,
       round((v0 + v1) / 2 - greatest(v1 - v0, 40) / 2, 5) AS fixed_min, 0.02 * 1500 AS intrinsics_need,
       round(greatest(v1 - v0, 0.02 * 2500), 5) AS hybrid
FROM ext
""")
def cross_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plane(spark, sf_dir)
    e = axis_extents(p, track_heading(p, ["user_id"], "stamp"), ["user_id"])
    v = (F.col("v_min"), F.col("v_max"))
    size = dict(gsd=F.lit(0.02), img_w=F.lit(2500), img_h=F.lit(1500), direction=F.lit("up"))
    fixed = cross_track(*v, "fixed", fixed_min=40.0)
    return e.select(
        "user_id", F.round(fixed["height"], 5).alias("fixed"),
        F.round(cross_track(*v, "std", v_std=F.col("v_std"))["height"], 5).alias("std"),
        F.round(fixed["v_min"], 5).alias("fixed_min"),
        (F.lit(0.02) * 1500).alias("intrinsics_need"),
        F.round(cross_track(*v, "hybrid", **size)["height"], 5).alias("hybrid"))


@work.query("length_correction", f"""
WITH {_EXTENT_SQL}, s AS ({_LENGTH_SQL.split('), s AS (', 1)[1]}
SELECT user_id, round(direct, 5) AS direct,
       round(CASE WHEN u1 - u0 > direct * 1.3 OR u1 - u0 < direct * 0.7 THEN direct
                  WHEN abs(path - (u1 - u0)) < abs(direct - (u1 - u0)) THEN path ELSE u1 - u0 END, 5) AS by_path,
       round(CASE WHEN u1 - u0 > direct * 1.3 OR u1 - u0 < direct * 0.7 THEN direct ELSE u1 - u0 END, 5) AS by_axis
FROM ext JOIN len USING (user_id)
""")
def length_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plane(spark, sf_dir)
    e = axis_extents(p, track_heading(p, ["user_id"], "stamp"), ["user_id"])
    both = e.join(track_length(p, ["user_id"], "stamp"), "user_id")
    args = (F.col("u_max") - F.col("u_min"), F.col("direct"), F.col("path"))
    return both.select("user_id", F.round(corrected_length(*args), 5).alias("direct"),
                       F.round(corrected_length(*args, "path"), 5).alias("by_path"),
                       F.round(corrected_length(*args, "pca"), 5).alias("by_axis"))


# the steps above over projected positions
_AFTER_PLANE = lambda sql: sql.split(", shape AS (", 1)[1]


@work.query("georeferenced_plots", f"""
WITH {TRACK_SQL}, {utm_sql('flat', 'track')},
plane AS (SELECT user_id, stamp, lat, lon, x, y FROM flat), shape AS ({_AFTER_PLANE(_EXTENT_SQL)},
s AS ({_LENGTH_SQL.split('), s AS (', 1)[1]}, img AS (
  SELECT user_id, count(*) * 40 AS width, 600 AS height, arg_max(lat, stamp) - arg_min(lat, stamp) AS dlat,
         arg_max(lon, stamp) - arg_min(lon, stamp) AS dlon FROM plane GROUP BY user_id
), laid AS (
  SELECT *, (u0 + u1) / 2 - direct / 2 AS u, greatest(v1 - v0, 1) AS tall,
         CASE WHEN v1 - v0 < 1 THEN (v0 + v1) / 2 + CAST(0.5 AS DOUBLE) ELSE v1 END AS top,
         direct / width AS px_, cos(theta + pi()) AS co, sin(theta + pi()) AS si
  FROM head JOIN ext USING (user_id) JOIN len USING (user_id) JOIN img USING (user_id)
)
SELECT user_id, 32610 AS epsg, round(theta, 6) AS theta, round(direct, 5) AS width_m, round(tall, 5) AS height_m,
       round(px_, 8) AS px, round(tall / height, 8) AS py,
       CASE WHEN abs(dlat) > abs(dlon) THEN CASE WHEN dlat > 0 THEN 'NORTH' ELSE 'SOUTH' END
            WHEN dlon > 0 THEN 'EAST' ELSE 'WEST' END AS rover_direction,
       CASE WHEN abs(lx - fx) > abs(ly - fy) THEN CASE WHEN lx > fx THEN 'RIGHT' ELSE 'LEFT' END
            WHEN ly > fy THEN 'UP' ELSE 'DOWN' END AS stitch_direction,
       round(px_ * co, 8) + 0.0 AS a, round(tall / height * si, 8) + 0.0 AS b, round(cx + u * co - top * si, 4) AS c,
       round(px_ * si, 8) + 0.0 AS d, round(-(tall / height) * co, 8) + 0.0 AS e,
       round(cy + u * si + top * co, 4) AS f
FROM laid
""")
def georeferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir)
    images = t.groupBy("user_id").agg(
        (F.count("*") * 40).alias("width"), F.lit(600).alias("height"))
    out = georeference_plots(t, images, ["user_id"], "stamp")
    digits = {"theta": 6, "width_m": 5, "height_m": 5, "c": 4, "f": 4}
    digits |= dict.fromkeys(["px", "py", "a", "b", "d", "e"], 8)
    return out.withColumns({n: F.round(n, k) + 0.0 for n, k in digits.items()})


@work.query("tracks_in_plane_zone", f"""
WITH {TRACK_SQL}, {utm_sql('flat', 'track')}
SELECT event_id, 32610 AS epsg, round(x, 3) AS x, round(y, 3) AS y FROM flat
""")
def plane_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_plane(track(spark, sf_dir), ["user_id"]).select(
        "event_id", "epsg", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


FIT_SQL = """
pairs AS (
  SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice / 1000 AS y,
         l_quantity * 2 + l_tax AS tx, l_extendedprice / 500 - l_discount * 3 AS ty FROM lineitem
), m AS (
  SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(tx) AS mtx, avg(ty) AS mty,
         var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, tx) AS xtx,
         covar_pop(y, tx) AS ytx, covar_pop(x, ty) AS xty, covar_pop(y, ty) AS yty FROM pairs GROUP BY k
), fit AS (
  SELECT *, (xtx * yy - ytx * xy) / (xx * yy - xy * xy) AS a, (ytx * xx - xtx * xy) / (xx * yy - xy * xy) AS b,
         (xty * yy - yty * xy) / (xx * yy - xy * xy) AS d, (yty * xx - xty * xy) / (xx * yy - xy * xy) AS e FROM m
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("tx"),
        (F.col("l_extendedprice") / 500 - F.col("l_discount") * 3).alias("ty"))


@work.query("affine_fit", f"""
WITH {FIT_SQL}
SELECT k, n AS pairs, round(a, 6) AS a, round(b, 6) AS b, round(mtx - a * mx - b * my, 5) AS c,
       round(d, 6) AS d, round(e, 6) AS e, round(mty - d * mx - e * my, 5) AS f FROM fit
""")
def affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_affine(pairs(spark, sf_dir), ["k"]).drop("kind")
    digits = {"a": 6, "b": 6, "c": 5, "d": 6, "e": 6, "f": 5}
    return fit.select("k", "pairs", *[F.round(c, n).alias(c) for c, n in digits.items()])


@work.query("affine_applied", f"""
WITH {FIT_SQL}
SELECT p.k, round(sum(a * x + b * y + mtx - a * mx - b * my), 3) AS sum_lon,
       round(sum(d * x + e * y + mty - d * mx - e * my), 3) AS sum_lat
FROM pairs p JOIN fit f ON f.k = p.k GROUP BY p.k
""")
def affine_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    moved = apply_affine(p.select("k", F.col("x").alias("lon"), F.col("y").alias("lat")), fit_affine(p, ["k"]), ["k"])
    return moved.groupBy("k").agg(
        F.round(F.sum("lon"), 3).alias("sum_lon"), F.round(F.sum("lat"), 3).alias("sum_lat"))
