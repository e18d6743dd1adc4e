"""Detections derived from line items: every line is a box on its supplier's image."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.boxes import (
    box_hits_region, box_to_utm, class_name, file_stamp, iou_corners, iou_xywh)
from furrow.operators.detection import (
    boxes_to_utm, clean_detections, count_in_regions, detect, first_candidate, label_summary,
    lift_boxes, nms, nms_batches, nms_xywh, plot_overlay, run_catalog, tile_grid,
    trait_count_maps, trait_counts)
from furrow.workloads import Workload
from furrow.workloads.tables import table

work = Workload()

IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]

BOXES_SQL = """
boxes AS (
  SELECT *, CAST(l_partkey * 37 % 600 AS DOUBLE) AS x, CAST(l_orderkey * 13 % 400 AS DOUBLE) AS y,
         20 + l_quantity AS width, 24 + l_quantity AS height,
         l_discount * 5 + l_tax AS confidence, l_returnflag AS class
  FROM lineitem
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "*",
        (F.col("l_partkey") * 37 % 600).cast("double").alias("x"),
        (F.col("l_orderkey") * 13 % 400).cast("double").alias("y"),
        (20 + F.col("l_quantity")).alias("width"), (24 + F.col("l_quantity")).alias("height"),
        (F.col("l_discount") * 5 + F.col("l_tax")).alias("confidence"),
        F.col("l_returnflag").alias("class"))


# greedy suppression as a fold over the sorted boxes of a group
CENTRE = "'x1': x - width / 2, 'y1': y - height / 2, 'x2': x + width / 2, 'y2': y + height / 2"


def _greedy(by: str, threshold: float, corners: str = CENTRE) -> str:
    return f"""
sorted AS (
  SELECT {by}, list({{{corners},
                      'k': [l_orderkey, l_linenumber, l_partkey], 'p': l_extendedprice}}
              ORDER BY -confidence, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS all_boxes
  FROM boxes GROUP BY {by}
), kept AS (
  SELECT {by}, list_reduce(all_boxes, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k:
      (least(k.x2, b.x2) > greatest(k.x1, b.x1)) AND (least(k.y2, b.y2) > greatest(k.y1, b.y1))
      AND (least(k.x2, b.x2) - greatest(k.x1, b.x1)) * (least(k.y2, b.y2) - greatest(k.y1, b.y1))
        / ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
           - (least(k.x2, b.x2) - greatest(k.x1, b.x1)) * (least(k.y2, b.y2) - greatest(k.y1, b.y1)))
        >= {threshold})) = 0 THEN list_append(kept, b) ELSE kept END, all_boxes[1:0]) AS kept
  FROM sorted
)"""


@work.query("suppress_per_image_and_class", f"""
WITH {BOXES_SQL}, {_greedy('l_suppkey, class', 0.3)}, e AS (SELECT l_suppkey, class, unnest(kept) AS b FROM kept)
SELECT l_suppkey, class, b.k[1] AS l_orderkey, b.k[3] AS l_partkey, b.p AS l_extendedprice FROM e
""")
def suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nms_xywh(boxes(spark, sf_dir), ["l_suppkey", "class"], IDS, 0.3)
    return out.select("l_suppkey", "class", "l_orderkey", "l_partkey", "l_extendedprice")


@work.query("suppress_large_groups", f"""
WITH base AS (SELECT l.*, p_brand FROM lineitem l JOIN part ON p_partkey = l_partkey),
{BOXES_SQL.replace('FROM lineitem', 'FROM base').replace('% 400 AS DOUBLE)', '% 400 + l_suppkey * 400 AS DOUBLE)')}, {_greedy('p_brand', 0.5)},
e AS (SELECT p_brand, unnest(kept) AS b FROM kept)
SELECT p_brand, b.k[1] AS l_orderkey, b.k[3] AS l_partkey, b.p AS l_extendedprice FROM e
""")
def suppress_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # the suppliers' images end to end: one long strip per brand
    strip = boxes(spark, sf_dir).withColumn("y", F.col("y") + F.col("l_suppkey") * 400)
    out = nms_xywh(strip.join(brands, "l_partkey"), ["p_brand"], IDS, 0.5)
    return out.select("p_brand", "l_orderkey", "l_partkey", "l_extendedprice")


@work.query("suppress_in_batches", f"""
WITH {BOXES_SQL.replace('boxes AS', 'plain AS')}, boxes AS (SELECT *, (row_number() OVER (
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) // 1000 AS batch FROM plain),
{_greedy('batch', 0.7, "'x1': x / 10, 'y1': y / 10, 'x2': (x + width) / 10 + 1, 'y2': (y + height) / 10 + 1, 'line': l_linenumber")},
e AS (SELECT unnest(kept) AS b FROM kept)
SELECT b.k[1] AS l_orderkey, b.line AS l_linenumber, b.k[3] AS l_partkey, b.p AS l_extendedprice FROM e
"""
)
def suppress_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select(
        *IDS, F.col("confidence").alias("score"), (F.col("x") / 10).alias("x1"), (F.col("y") / 10).alias("y1"),
        ((F.col("x") + F.col("width")) / 10).alias("x2"), ((F.col("y") + F.col("height")) / 10).alias("y2"))
    return nms_batches(b, IDS, IDS, batch_rows=1000).select(*IDS)


@work.query("box_overlap_ratio", f"""
WITH {BOXES_SQL}, o AS (
  SELECT *, least(x + width / 2, 320) - greatest(x - width / 2, 280) AS w,
         least(y + height / 2, 230) - greatest(y - height / 2, 170) AS h FROM boxes
)
SELECT l_orderkey, l_linenumber, l_extendedprice,
       round(CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE w * h / (width * height + 40 * 60 - w * h) END, 6) AS iou,
       round(greatest(0, w + 1) * greatest(0, h + 1)
         / ((width + 1) * (height + 1) + 41 * 61 - greatest(0, w + 1) * greatest(0, h + 1)), 6) AS iou_wide,
       (x - width / 2 <= 320 AND x + width / 2 >= 280 AND y - height / 2 <= 230 AND y + height / 2 >= 170) AS hits
FROM o
""")
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    c = [F.col(n) for n in ("x", "y", "width", "height")]
    box = (c[0] - c[2] / 2, c[1] - c[3] / 2, c[0] + c[2] / 2, c[1] + c[3] / 2)
    other = tuple(F.lit(float(v)) for v in (300, 200, 40, 60))
    region = tuple(F.lit(float(v)) for v in (280, 170, 320, 230))
    return b.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.round(iou_xywh(tuple(c), other), 6).alias("iou"),
        F.round(iou_corners(box, region), 6).alias("iou_wide"),
        box_hits_region(box, region).alias("hits"))


# Pages are images whose sizes come from their text lengths.
IMAGES_SQL = """
images AS (
  SELECT page_id, CAST(length(html) % 2300 + 100 AS INTEGER) AS width,
         CAST(length(url) * 53 % 1900 + 100 AS INTEGER) AS height FROM pages
)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", (F.length("html") % 2300 + 100).cast("int").alias("width"),
        (F.length("url") * 53 % 1900 + 100).cast("int").alias("height"))


def _axis(length: str) -> str:
    return (f"CASE WHEN {length} <= 640 THEN [0] ELSE list_distinct(list_append("
            f"range(0, {length} - 639, 608), {length} - 640)) END")


@work.query("tile_grid", f"""
WITH {IMAGES_SQL}, xs AS (
  SELECT page_id, width, height, unnest({_axis('width')}) AS x_offset FROM images
), xy AS (SELECT *, unnest({_axis('height')}) AS y_offset FROM xs)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y_offset, x_offset) - 1 AS INTEGER) AS crop_id,
       CAST(x_offset AS INTEGER) AS x_offset, CAST(y_offset AS INTEGER) AS y_offset,
       CAST(least(640, width - x_offset) AS INTEGER) AS tile_width,
       CAST(least(640, height - y_offset) AS INTEGER) AS tile_height
FROM xy
""")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_grid(images(spark, sf_dir)).select(
        "page_id", "crop_id", "x_offset", "y_offset", "tile_width", "tile_height")


class _PageDetector:
    """Stand-in model: one box per tile whose confidence follows from the tile."""

    def __call__(self, batch: pd.DataFrame) -> list[list[dict]]:
        confidence = (batch["page_id"] * 7 + batch["crop_id"] * 3) % 10 / 10
        return [[{"class": "leaf", "confidence": float(c), "x": 100.0, "y": 50.0, "width": 20.0,
                  "height": 10.0}] for c in confidence]


@work.query("detect_and_lift", f"""
WITH {IMAGES_SQL}, xs AS (
  SELECT page_id, width, height, unnest({_axis('width')}) AS x_offset FROM images
), xy AS (SELECT *, unnest({_axis('height')}) AS y_offset FROM xs),
t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y_offset, x_offset) - 1 AS crop_id FROM xy)
SELECT page_id, CAST(crop_id AS INTEGER) AS crop_id, CAST((page_id * 7 + crop_id * 3) % 10 AS DOUBLE) / 10 AS confidence,
       CAST(x_offset + 100 AS DOUBLE) AS x, CAST(y_offset + 50 AS DOUBLE) AS y
FROM t WHERE (page_id * 7 + crop_id * 3) % 10 >= 5
""")
def detect_and_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tile_grid(images(spark, sf_dir))
    found = detect(grid, _PageDetector, ["page_id", "crop_id", "x_offset", "y_offset"])
    return lift_boxes(found).select("page_id", "crop_id", "confidence", "x", "y")


class _MaskDetector:
    """Stand-in model with a mask per box: points on even pages, segments on odd ones."""

    def __call__(self, batch: pd.DataFrame) -> list[list[dict]]:
        out = []
        for page, crop in zip(batch["page_id"], batch["crop_id"]):
            box = {"class": "leaf", "confidence": float((page * 7 + crop * 3) % 10) / 10, "x": 100.0, "y": 50.0,
                   "width": 20.0, "height": 10.0, "model_version": int(page % 3) or None}
            mask = [{"x": float(page % 50), "y": 1.5}, {"x": 3.0, "y": float(crop)}]
            segments = [[p["x"] + 1, p["y"]] for p in mask]
            out.append([box | ({"points": mask, "segments": segments} if page % 2 == 0 else {"segments": segments})])
        return out


@work.query("detect_masks_and_model", f"""
WITH {IMAGES_SQL}, xs AS (
  SELECT page_id, width, height, unnest({_axis('width')}) AS x_offset FROM images
), xy AS (SELECT *, unnest({_axis('height')}) AS y_offset FROM xs),
t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y_offset, x_offset) - 1 AS crop_id FROM xy)
SELECT page_id, CAST(crop_id AS INTEGER) AS crop_id, 'leaves' AS model_id, CAST(nullif(page_id % 3, 0) AS VARCHAR) AS model_version,
       CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 50 + x_offset AS DOUBLE) END AS first_point_x,
       CASE WHEN page_id % 2 = 0 THEN CAST(crop_id + y_offset AS DOUBLE) END AS last_point_y,
       CASE WHEN page_id % 2 = 1 THEN CAST(page_id % 50 + 1 + x_offset AS DOUBLE) END AS first_segment_x, 2 AS vertices
FROM t WHERE (page_id * 7 + crop_id * 3) % 10 >= 5
""")
def detect_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tile_grid(images(spark, sf_dir))
    found = lift_boxes(detect(grid, _MaskDetector, ["page_id", "crop_id", "x_offset", "y_offset"], model_id="leaves"))
    return found.select(
        "page_id", "crop_id", "model_id", "model_version", F.get("points", F.lit(0))["x"].alias("first_point_x"),
        F.get("points", F.lit(1))["y"].alias("last_point_y"),
        F.get(F.get("segments", F.lit(0)), F.lit(0)).alias("first_segment_x"),
        F.coalesce(F.size("points"), F.size("segments")).alias("vertices"))


@work.query("mask_points_lifted", """
SELECT event_id, round(value + user_id, 6) AS first_x, round(value * 2 + 7, 6) AS first_y,
       round(value * 3 + user_id, 6) AS segment_x
FROM events
""")
def lifted_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    e = table(spark, sf_dir, "events").select(
        "event_id", v.alias("x"), v.alias("y"),
        F.array(F.struct(v.alias("x"), (v * 2).alias("y"))).alias("points"),
        F.array(F.array(v * 3, v)).alias("segments"),
        F.col("user_id").alias("x_offset"), F.lit(7).alias("y_offset"))
    out = lift_boxes(e)
    return out.select(
        "event_id", F.round(F.get("points", F.lit(0))["x"], 6).alias("first_x"),
        F.round(F.get("points", F.lit(0))["y"], 6).alias("first_y"),
        F.round(F.get(F.get("segments", F.lit(0)), F.lit(0)), 6).alias("segment_x"))


@work.query("clean_plant_detections", """
SELECT event_id, 'plant' AS label, epoch_us(ts) AS timestamp FROM events WHERE user_id % 2 = 0
""")
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 2).cast("int").alias("labels"),
        F.concat(F.lit("rgb-"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"),
                 F.lit(".jpg")).alias("filename"))
    return clean_detections(e).select("event_id", "label", "timestamp")


@work.query("boxes_to_utm", """
WITH d AS (
  SELECT event_id, user_id, CAST(floor(value * 3) AS INTEGER) + 100 AS bx, CAST(event_id % 1500 AS INTEGER) AS by_,
         40 AS bw, CAST(user_id % 200 AS INTEGER) AS bh FROM events
), c AS (
  SELECT user_id, min(value) * 100 AS xmin, max(value) * 100 AS xmax,
         CAST(min(event_id) AS DOUBLE) AS ymin, CAST(max(event_id) AS DOUBLE) AS ymax FROM events GROUP BY user_id
)
SELECT event_id,
       round((xmin + (bx - 90) * (xmax - xmin) / 2591) / 100, 6) AS x1,
       round((ymax - by_ * (ymax - ymin) / 2047) / 100, 6) AS y1,
       round((xmin + least(bx - 90 + bw, 2591) * (xmax - xmin) / 2591) / 100, 6) AS x2,
       round((ymax - (by_ + bh) * (ymax - ymin) / 2047) / 100, 6) AS y2
FROM d JOIN c USING (user_id) WHERE by_ >= 512 AND by_ + bh <= 1536
""")
def utm_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    frames = e.groupBy(F.col("user_id").alias("timestamp")).agg(
        (F.min("value") * 100).alias("xmin"), (F.max("value") * 100).alias("xmax"),
        F.min("event_id").cast("double").alias("ymin"), F.max("event_id").cast("double").alias("ymax"))
    cloud = frames.select("timestamp", F.explode(F.array(
        F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("xmin").alias("x"), F.col("ymin").alias("y")),
        F.struct(F.lit(2047).alias("row"), F.lit(2591).alias("col"), F.col("xmax").alias("x"),
                 F.col("ymax").alias("y")))).alias("p")).select("timestamp", "p.*")
    d = e.select(
        F.col("user_id").alias("timestamp"), F.col("event_id").alias("score"),
        F.array((F.floor(F.col("value") * 3) + 100).cast("double"), (F.col("event_id") % 1500).cast("double"),
                F.lit(40.0), (F.col("user_id") % 200).cast("double")).alias("bbox"))
    out = boxes_to_utm(d, cloud)
    return out.select(F.col("score").alias("event_id"), *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@work.query("boxes_per_region", f"""
WITH {BOXES_SQL}, regions AS (
  SELECT s_suppkey, b, b * 100.0 AS y1, b * 100.0 + 100 AS y2 FROM supplier, range(0, 4) r(b)
)
SELECT s_suppkey, CAST(b AS INTEGER) AS region, count(l_orderkey) AS count
FROM regions LEFT JOIN boxes ON l_suppkey = s_suppkey AND x - width / 2 <= 300 AND x + width / 2 >= 0
  AND y - height / 2 <= y2 AND y + height / 2 >= y1
GROUP BY ALL
""")
def per_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    corners = b.select(
        F.col("l_suppkey").alias("s_suppkey"),
        (F.col("x") - F.col("width") / 2).alias("x1"), (F.col("y") - F.col("height") / 2).alias("y1"),
        (F.col("x") + F.col("width") / 2).alias("x2"), (F.col("y") + F.col("height") / 2).alias("y2"))
    regions = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("region")).select(
        "s_suppkey", "region", F.lit(0.0).alias("x1"), (F.col("region") * 100.0).alias("y1"),
        F.lit(300.0).alias("x2"), (F.col("region") * 100.0 + 100).alias("y2"))
    return count_in_regions(corners, regions, "s_suppkey", "region").select("s_suppkey", "region", "count")


# Events are detections of class event_type; customers are plots, some unlabelled.
def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id"),
        F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".0")).alias("plot_label"),
        F.when(F.col("value") > 1, "a").alias("accession"), F.col("event_type").alias("class"),
        F.concat(F.lit("plot_"), F.col("user_id").cast("string"), F.lit(".png")).alias("image_file"),
        F.concat(F.lit("m/"), (F.col("event_id") % 3).cast("string")).alias("model_id"),
        F.lit("1").alias("model_version"),
        F.when(F.col("value") > 100, F.lit("[]")).when(F.col("value") > 50, F.lit("[[1, 2]]")).when(
            F.col("value") > 20, F.lit("broken")).alias("points"))


@work.query("counts_per_plot_and_class", """
SELECT c_custkey AS plot, c_mktsegment AS accession,
       count(*) FILTER (event_type = 'click') AS "m/click", count(*) FILTER (event_type = 'error') AS "m/error",
       count(*) FILTER (event_type = 'purchase') AS "m/purchase", count(*) FILTER (event_type = 'signup') AS "m/signup",
       count(*) FILTER (event_type = 'view') AS "m/view"
FROM customer LEFT JOIN events ON user_id = c_custkey AND value > 1
WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL
""")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plots = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("plot"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Unknown").otherwise(F.col("c_mktsegment")).alias("accession"))
    return trait_counts(detections(spark, sf_dir), plots, "m")


@work.query("class_counts_as_map", """
SELECT plot, accession, coalesce(string_agg('m/' || class || '=' || n, ',' ORDER BY class) FILTER (n > 0), '') AS counts FROM (
  SELECT c_custkey AS plot, c_mktsegment AS accession, event_type AS class, count(event_id) AS n
  FROM customer LEFT JOIN events ON user_id = c_custkey AND value > 1 WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL)
GROUP BY plot, accession
""")
def count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    plots = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("plot"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Unknown").otherwise(F.col("c_mktsegment")).alias("accession"))
    return trait_count_maps(detections(spark, sf_dir), plots, "m").withColumn("counts", F.array_join(F.transform(
        F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@work.query("detections_per_class", "SELECT event_type AS class, count(*) AS count FROM events GROUP BY 1")
def per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_summary(detections(spark, sf_dir))


@work.query("overlay_of_one_image", """
SELECT event_type AS class, count(*) AS count FROM events WHERE user_id = 7 GROUP BY 1
""")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plot_overlay(detections(spark, sf_dir), "plot_7.png")[1]


@work.query("run_catalog", """
WITH d AS (
  SELECT *, CASE WHEN value > 100 THEN '[]' WHEN value > 50 THEN '[[1, 2]]' WHEN value > 20 THEN 'broken' END AS points
  FROM events
), h AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS classes
         FROM (SELECT user_id, event_type, count(*) AS n FROM d GROUP BY ALL) GROUP BY user_id)
SELECT 'plot_' || user_id || '.png' AS file, count(*) AS total_predictions, any_value(classes) AS classes,
       'm/' || min(event_id) % 3 AS model_id, bool_or(points IS NOT NULL) AS has_segmentation,
       count(*) FILTER (points = '[[1, 2]]') AS mask_count
FROM d JOIN h USING (user_id) GROUP BY user_id
""")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumnRenamed("image_file", "file").withColumn(
        "modified", F.col("user_id"))
    runs = run_catalog(d, "event_id")
    classes = F.concat_ws(",", F.transform(F.map_entries("classes_detected"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))))
    return runs.select("file", "total_predictions", classes.alias("classes"), "model_id",
                       "has_segmentation", "mask_count")


@work.query("result_file_for_task", """
WITH f AS (
  SELECT source AS folder, 'd_' || doc_id || '_predictions' ||
         CASE WHEN doc_id % 3 = 0 THEN '_segmentation.csv' WHEN doc_id % 3 = 1 THEN '.csv' ELSE '_old.csv' END AS name
  FROM documents
)
SELECT folder, arg_min(name, (CASE WHEN name LIKE '%\\_predictions\\_segmentation.csv' ESCAPE '\\' THEN 0
  WHEN name LIKE '%\\_predictions.csv' ESCAPE '\\' THEN 1 ELSE 3 END, name)) AS name
FROM f GROUP BY folder
""")
def result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    suffix = F.when(F.col("doc_id") % 3 == 0, "_segmentation.csv").when(
        F.col("doc_id") % 3 == 1, ".csv").otherwise("_old.csv")
    files = d.select(F.col("source").alias("folder"), F.concat(
        F.lit("d_"), F.col("doc_id").cast("string"), F.lit("_predictions"), suffix).alias("name"))
    return first_candidate(files, "_predictions", "segmentation").select("folder", "name")
