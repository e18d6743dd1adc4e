"""Plots: orders as a drive, customers as plots, conversations as row sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import plots as P
from furrow.operators.intervals import assign_intervals
from furrow.plans.skew import ordinal
from furrow.plans.storage import anti_new
from furrow.workloads import Workload
from furrow.workloads.tables import TRACK_SQL, table, track

work = Workload()

# the drive: one row per order by key; every 40 rows a new plot, the first of each five unmarked
DRIVE_SQL = """
drive AS (
  SELECT o_orderkey AS row, 'top/' || o_orderkey || '.jpg' AS image,
         CASE WHEN o_orderkey // 40 % 5 = 0 THEN -1 ELSE CAST(o_orderkey // 40 AS INTEGER) END AS plot_index,
         CASE WHEN o_orderkey // 40 % 5 <> 0 THEN o_orderstatus END AS stitch_direction,
         o_totalprice / 7e5 AS lat, o_custkey / 1e4 AS lon
  FROM orders
)"""


def drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, block = table(spark, sf_dir, "orders"), F.floor(F.col("o_orderkey") / 40)
    marked = block % 5 != 0
    return o.select(
        F.col("o_orderkey").alias("row"),
        F.concat(F.lit("top/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("image"),
        F.when(marked, block.cast("int")).otherwise(-1).alias("plot_index"),
        F.when(marked, F.col("o_orderstatus")).alias("stitch_direction"),
        (F.col("o_totalprice") / 7e5).alias("lat"), (F.col("o_custkey") / 1e4).alias("lon"))


@work.query("row_positions_in_order", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position,
       row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS in_type FROM events
""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    out = ordinal(ordinal(e, ["ts", "event_id"], name="position"), ["ts", "event_id"], ["event_type"], "in_type")
    return out.select("event_id", "position", "in_type")


@work.query("middle_row_per_group", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS k,
                  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, o_orderkey FROM r WHERE k = n // 2
""")
def middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey")
    return P.middle_per_group(o, ["o_orderpriority"], ["o_orderdate", "o_orderkey"]).select(
        "o_orderpriority", "o_orderkey")


@work.query("first_image_per_plot", f"""
WITH {DRIVE_SQL}
SELECT plot_index, arg_min(image, row) AS image_name, arg_min(stitch_direction, row) FILTER (stitch_direction <> 'O') AS direction
FROM drive WHERE plot_index > -1 GROUP BY plot_index
""")
def first_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drive(spark, sf_dir).withColumn("direction", F.nullif("stitch_direction", F.lit("O")))
    return P.first_per_plot(d, "row", ["image", "direction"]).withColumnRenamed("image", "image_name")


@work.query("plot_data_with_names", f"""
WITH {DRIVE_SQL}
SELECT plot_index, arg_min(image, row) AS image_name, true AS has_plot_metadata, any_value(c_mktsegment) AS "Accession"
FROM drive LEFT JOIN customer ON c_custkey = plot_index WHERE plot_index > -1 GROUP BY plot_index
""")
def plot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.plot_data(drive(spark, sf_dir), named(spark, sf_dir), "image", "row").drop("Plot")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("plot_index"), F.col("c_name").alias("Plot"),
        F.col("c_mktsegment").alias("Accession"))


@work.query("plot_centres_and_labels", f"""
WITH {DRIVE_SQL}, t AS (SELECT count(DISTINCT plot_index) AS total_plots FROM drive WHERE plot_index > 0)
SELECT plot_index, 'Plot_' || any_value(c_name) || '_Acc_' || any_value(c_mktsegment) AS plot_label,
       round(avg(lat), 8) AS center_lat, round(avg(lon), 8) AS center_lon, any_value(total_plots) AS total_plots
FROM drive JOIN customer ON c_custkey = plot_index, t WHERE plot_index > 0 GROUP BY plot_index
""")
def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.association_summary(drive(spark, sf_dir), named(spark, sf_dir))
    return out.withColumn("center_lat", F.round("center_lat", 8)).withColumn("center_lon", F.round("center_lon", 8))


@work.query("largest_plot_index", f"WITH {DRIVE_SQL} SELECT max(plot_index) AS max_plot_index FROM drive")
def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.max_plot_index(drive(spark, sf_dir))


@work.query("marked_plots", f"WITH {DRIVE_SQL} SELECT DISTINCT plot_index FROM drive WHERE plot_index > 0")
def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.plots(drive(spark, sf_dir))


@work.query("rows_around_match", f"""
WITH {DRIVE_SQL}
SELECT DISTINCT d.row FROM drive d JOIN drive m ON abs(d.row - m.row) <= 2 WHERE m.image LIKE '%77.jpg'
""")
def around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.context_rows(drive(spark, sf_dir), "row", F.col("image").endswith("77.jpg")).select("row")


@work.query("row_slice", f"WITH {DRIVE_SQL} SELECT row, image FROM drive WHERE row >= 100 AND row < 250")
def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.row_slice(drive(spark, sf_dir), "row", 100, 250).select("row", "image")


@work.query("every_third_image", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events) WHERE k % 3 = 0
""")
def every_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.decimate(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id")


@work.query("numbered_plants", """
SELECT l_orderkey, l_linenumber, l_partkey, "Bed", "Tier", row_number() OVER (
  ORDER BY "Bed", "Tier", l_orderkey, l_linenumber, l_partkey) AS "Plant ID"
FROM (SELECT *, l_suppkey AS "Bed", l_linenumber AS "Tier" FROM lineitem WHERE l_returnflag <> 'A')
""")
def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag") != "A", F.col("l_suppkey")).alias("Bed"), F.col("l_linenumber").alias("Tier"))
    return P.number_plants(li, ["l_orderkey", "l_linenumber", "l_partkey"])


@work.query("train_validation_split", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k < CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM r
""")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return P.split_ordered(d, ["source", "doc_id"]).select("doc_id", "split")


@work.query("intervals_assigned", """
WITH spans AS (
  SELECT o_custkey AS ord, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + o_custkey % 9 AS b
  FROM orders
), days AS (
  SELECT epoch_us(l_shipdate) // 86400000000 AS day, count(*) AS n FROM lineitem GROUP BY 1
), won AS (SELECT day, max(ord) AS plot_index FROM days JOIN spans ON day BETWEEN a AND b GROUP BY day)
SELECT coalesce(plot_index, -1) AS plot_index, CAST(sum(n) AS BIGINT) AS lines FROM days LEFT JOIN won USING (day) GROUP BY ALL
""")
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.unix_date(F.col(c).cast("timestamp").cast("date"))
    rows = table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("day"), F.lit(-1).cast("long").alias("plot_index"))
    spans = table(spark, sf_dir, "orders").select(
        day("o_orderdate").alias("a"), (day("o_orderdate") + F.col("o_custkey") % 9).alias("b"),
        F.col("o_custkey").alias("ord"), F.col("o_custkey").alias("plot_index"))
    out = assign_intervals(rows, spans, "day", "a", "b", "ord", ["plot_index"], base=8)
    return out.groupBy("plot_index").agg(F.count("*").alias("lines"))


@work.query("mark_plot", f"""
WITH {DRIVE_SQL}
SELECT row, CASE WHEN row BETWEEN 30 AND 95 THEN 7 WHEN plot_index = 7 THEN -1 ELSE plot_index END AS plot_index,
       CASE WHEN row BETWEEN 30 AND 95 THEN 'down' WHEN plot_index = 7 THEN NULL ELSE stitch_direction END AS stitch_direction
FROM drive
""")
def mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    borders = spark.createDataFrame([], "plot_index int, start_lat double, start_lon double, end_lat double, end_lon double, stitch_direction string")
    out, _ = P.mark_plot(drive(spark, sf_dir), borders, 7, "top/30.jpg", "top/95.jpg", "row", "image", "down")
    return out.select("row", "plot_index", "stitch_direction")


@work.query("delete_plot", f"""
WITH {DRIVE_SQL}
SELECT row, CASE WHEN plot_index = 8 THEN -1 ELSE plot_index END AS plot_index FROM drive
""")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.delete_plot(drive(spark, sf_dir), 8).select("row", "plot_index")


@work.query("shift_later_plots", f"""
WITH {DRIVE_SQL}, dir AS (SELECT plot_index, arg_min(stitch_direction, row) AS d FROM drive WHERE plot_index > 3 GROUP BY 1),
moved AS (SELECT row - 13 AS row, plot_index, d FROM drive JOIN dir USING (plot_index) WHERE row - 13 >= 0)
SELECT drive.row, coalesce(moved.plot_index, CASE WHEN drive.plot_index > 3 THEN -1 ELSE drive.plot_index END) AS plot_index,
       CASE WHEN moved.row IS NOT NULL THEN d WHEN drive.plot_index > 3 THEN NULL ELSE stitch_direction END AS stitch_direction
FROM drive LEFT JOIN moved ON moved.row = drive.row
""")
def shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shift_plots(drive(spark, sf_dir), "row", 3, 13).select("row", "plot_index", "stitch_direction")


@work.query("gps_shift", f"""
WITH {TRACK_SQL}
SELECT event_id, round(lat + (38.6::DOUBLE - 38.5::DOUBLE), 7) AS lat, round(lon + (-121.7::DOUBLE - -121.8::DOUBLE), 7) AS lon,
       round(lat, 7) AS back_lat FROM track
""")
def gps_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = P.shift_gps(track(spark, sf_dir), 38.6, -121.7, 38.5, -121.8)
    return moved.select("event_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"),
                        F.round("original_lat", 7).alias("back_lat"))


@work.query("gps_shift_undone", f"WITH {TRACK_SQL} SELECT event_id, round(lat, 8) AS lat, round(lon, 8) AS lon FROM track")
def gps_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = P.shift_gps(P.shift_gps(track(spark, sf_dir), 38.6, -121.7, 38.5, -121.8), 1.0, 1.0, 0.5, 0.5)
    return P.undo_shift(moved).select("event_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@work.query("gps_shift_status", "SELECT true AS shifted, 0.1::DOUBLE AS lat_shift, 0.2::DOUBLE AS lon_shift")
def gps_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = P.shift_gps(track(spark, sf_dir), 38.6, -121.6, 38.5, -121.8)
    return P.shift_status(moved).select(
        "shifted", F.round("lat_shift", 6).alias("lat_shift"), F.round("lon_shift", 6).alias("lon_shift"))


@work.query("bands_between_plants", """
WITH c AS (
  SELECT conv_id AS image, CAST(length(text) % 1000 AS INTEGER) AS x, CAST(turn * 90 + length(role) AS INTEGER) AS y FROM conversations
), s AS (SELECT *, CASE WHEN x < 500 THEN 1 WHEN x > 500 THEN 2 END AS side FROM c WHERE x <> 500),
l AS (
  SELECT image, side, CAST(trunc((lead(y) OVER w - y) / 2.0 + y) AS INTEGER) AS line FROM s WINDOW w AS (PARTITION BY image, side ORDER BY y)
), a AS (
  SELECT image, side, line FROM l WHERE line IS NOT NULL
  UNION ALL SELECT DISTINCT image, side, unnest([0, 2000]) FROM s
), b AS (SELECT image, side, line AS y1, lead(line) OVER (PARTITION BY image, side ORDER BY line) AS y2 FROM a)
SELECT image, side, CASE side WHEN 1 THEN 0 ELSE 500 END AS x1, y1, CASE side WHEN 1 THEN 500 ELSE 1000 END AS x2, y2 FROM b WHERE y2 IS NOT NULL
""")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("image"), (F.length("text") % 1000).alias("cx"),
        (F.col("turn") * 90 + F.length("role")).alias("cy"), F.lit(1000).alias("width"), F.lit(2000).alias("height"))
    return P.partition_bands(c)


@work.query("images_with_labels", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda folder, ext: F.concat(F.lit(folder), F.col("doc_id").cast("string"), F.lit(ext)).alias("path")
    images = table(spark, sf_dir, "documents").select("doc_id", name("a.b/img", ".jpg"))
    return P.labeled_images(images, table(spark, sf_dir, "labels").select(name("labels/img", ".txt"))).select("doc_id")


@work.query("new_files_only", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return anti_new(c, o, ["c_custkey"])


@work.query("rows_with_plot_labels", """
SELECT event_id, c_name AS plot_label, c_mktsegment AS accession
FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey > 0
""")
def plot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("int").alias("plot_index"))
    return P.with_plot_labels(e, named(spark, sf_dir)).drop("plot_index")


@work.query("gcp_pairs_by_file", """
SELECT p_partkey, l_quantity AS x, l_extendedprice AS y FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_tax > 0.01
""")
def gcp_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c, folder: F.concat(F.lit(folder), F.col(c).cast("string"), F.lit(".jpg"))
    picked = table(spark, sf_dir, "part").select("p_partkey", name("p_partkey", "").alias("image"))
    images = table(spark, sf_dir, "lineitem").select(
        name("l_partkey", "Raw/x/").alias("image_path"), F.col("l_quantity").alias("lon"),
        F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).alias("lat"))
    return P.gcp_pairs(picked, images).select("p_partkey", "x", "y")


@work.query("image_in_any_camera", f"""
WITH {DRIVE_SQL}
SELECT row, '/top/rgb_file' AS camera_column FROM drive WHERE row % 11 = 0
UNION ALL SELECT row, '/left/rgb_file' FROM drive WHERE row % 11 = 0 AND row % 2 = 0
""")
def any_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drive(spark, sf_dir).select(
        "row", F.col("image").alias("/top/rgb_file"),
        F.when(F.col("row") % 2 == 0, F.concat(F.lit("l"), "image")).alias("/left/rgb_file"))
    wanted = drive(spark, sf_dir).where(F.col("row") % 11 == 0)
    names = wanted.select(F.col("image").alias("image_name")).unionByName(
        wanted.select(F.concat(F.lit("l"), "image").alias("image_name")))
    return P.find_images(d, names).select("row", "camera_column")


@work.query("union_keeping_first", """
SELECT o_custkey AS k, 'orders' AS origin FROM orders
UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("origin"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"))
    return P.union_first(a, b, "k")


@work.query("traits_attached_to_boundaries", """
SELECT CAST(s_suppkey AS INTEGER) AS "Bed", CAST(k AS INTEGER) AS "Tier", coalesce(flag, 'None') AS flag, coalesce(height, 0) AS height
FROM supplier, range(1, 12) r(k) LEFT JOIN (
  SELECT l_suppkey, l_linenumber, max(l_returnflag) AS flag, round(avg(l_quantity), 4) AS height FROM lineitem GROUP BY ALL
) t ON t.l_suppkey = s_suppkey AND t.l_linenumber = k
""")
def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("Bed"), F.explode(F.sequence(F.lit(1), F.lit(11))).alias("Tier"))
    traits = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").cast("int").alias("Bed"), F.col("l_linenumber").alias("Tier")).agg(
        F.max("l_returnflag").alias("flag"), F.round(F.avg("l_quantity"), 4).alias("height"))
    return P.attach_traits(areas, traits, "left")


@work.query("traits_merged_outer", """
SELECT coalesce(o.k, c.k) AS k, o.spent, c.balance FROM (SELECT o_custkey AS k, max(o_totalprice) AS spent FROM orders GROUP BY 1) o
FULL JOIN (SELECT c_custkey AS k, c_acctbal AS balance FROM customer) c ON o.k = c.k
""")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("spent"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return P.merge_traits_outer(a, b)


@work.query("detections_merged_into_traits", """
SELECT c_custkey AS plot, CASE WHEN n IS NOT NULL THEN n ELSE CAST(c_nationkey AS BIGINT) END AS "m/leaf", c_acctbal AS height
FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON user_id = c_custkey
""")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("plot"), F.col("c_acctbal").alias("height"), F.col("c_nationkey").cast("long").alias("m/leaf"))
    new = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("plot")).agg(F.count("*").alias("m/leaf"))
    return P.merge_detections(existing, new)


@work.query("traits_in_order", """
SELECT c_nationkey AS "column", c_custkey AS plot, c_acctbal AS "m/a", c_name AS other FROM customer
""")
def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("other"), F.col("c_acctbal").alias("m/a"), F.col("c_custkey").alias("plot"),
        F.lit(1).alias("plot_label"), F.col("c_nationkey").alias("column"))
    return P.order_traits(c)


@work.query("gcp_points_upserted", """
SELECT 'i' || p_partkey AS image, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS "pointX", 1.0::DOUBLE AS "pointY"
FROM part WHERE p_partkey % 3 <> 1
""")
def gcp_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    image = F.concat(F.lit("i"), k.cast("string")).alias("image")
    old = p.select(image, F.col("p_retailprice").alias("pointX"), F.lit(1.0).alias("pointY")).where(k % 2 == 0)
    new = p.where((k % 3 != 2) | (k % 2 == 1)).select(
        image, F.when(k % 3 == 0, F.col("p_retailprice") * 2).when(k % 3 == 2, F.col("p_retailprice")).alias("pointX"),
        F.lit(1.0).alias("pointY"))
    return P.upsert_gcp(old, new)


@work.query("duplicate_images_removed", """
SELECT min(event_id) AS event_id, 'img' || user_id AS image_path FROM events GROUP BY user_id
""")
def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("img"), F.col("user_id").cast("string")).alias("image_path"))
    return P.dedupe_images(e, ["event_id"])[0]


@work.query("duplicate_image_count", "SELECT count(*) - count(DISTINCT user_id) AS removed FROM events")
def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("image_path"))
    return P.dedupe_images(e, ["event_id"])[1]


@work.query("image_size_consistency", """
SELECT p_brand AS folder, count(DISTINCT p_size) AS sizes, count(DISTINCT p_size) <= 1 AS consistent FROM part GROUP BY 1
""")
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.size_consistency(table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("folder"), F.col("p_size").alias("naturalWidth"), F.lit(1).alias("naturalHeight")))


@work.query("files_sorted_by_stamp", "SELECT event_id FROM events")
def sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("rgb-"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string")).alias("name"))
    return P.sort_files(e, "name", r"\d+").select("event_id")
