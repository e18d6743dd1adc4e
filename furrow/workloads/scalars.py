"""Column functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import clock, text
from furrow.functions.geo import (
    gsd_from_intrinsics, gsd_from_matrix, pixel_to_world, rotated_affine, world_to_pixel)
from furrow.operators.plots import labeled_plots
from furrow.operators.traits import choose_altitude
from furrow.workloads import Workload
from furrow.workloads.tables import table

work = Workload()


@work.query("parse_stamp_texts", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN round(epoch_us(ts) / 1e6, 6) WHEN 1 THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE)
  WHEN 2 THEN epoch_us(ts) // 1000000 - 19800.0 WHEN 3 THEN value ELSE NULL END AS epoch
FROM events
""")
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 5
    fmt = lambda p: F.date_format("at", p)
    written = F.when(kind == 0, fmt("yyyy:MM:dd HH:mm:ss.SSSSSS")).when(
        kind == 1, fmt("yyyy/MM/dd HH:mm:ss")).when(
        kind == 2, F.concat(fmt("yyyy-MM-dd HH:mm:ss"), F.lit(" +0530"))).when(
        kind == 3, F.col("value").cast("string")).otherwise(F.lit("not a time"))
    return e.select("event_id", F.round(clock.parse_epoch(written), 6).alias("epoch"))


@work.query("stamps_from_parts", """
SELECT event_id, epoch_us(ts) AS from_parts, epoch_us(ts) AS from_name,
       epoch_us(ts) + CAST(user_id * 500000 AS BIGINT) AS absolute, epoch_us(ts) // 1000000 * 1000000 AS no_nanos
FROM events
""")
def stamp_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("at") % 1_000_000
    parts = [F.year("at"), F.month("at"), F.dayofmonth("at"), F.hour("at"), F.minute("at"), F.second("at")]
    name = F.concat(F.lit("logs/"), F.date_format("at", "yyyy_MM_dd_HH_mm_ss_SSSSSS"), F.lit("_robot.bin"))
    return e.select(
        "event_id", clock.utc_parts_to_micros(*parts, micros * 1000 + 7).alias("from_parts"),
        clock.base_stamp(name).alias("from_name"),
        clock.abs_stamp(clock.base_stamp(name), F.col("user_id") * 0.5).alias("absolute"),
        clock.utc_parts_to_micros(*parts, F.lit(-5)).alias("no_nanos"))


@work.query("degrees_minutes_seconds", """
WITH c AS (SELECT c_custkey, c_acctbal / 100 AS v FROM customer),
d AS (SELECT *, CAST(floor(abs(v)) AS INTEGER) AS deg, (abs(v) - floor(abs(v))) * 60 AS m FROM c)
SELECT c_custkey, deg, CAST(floor(m) AS INTEGER) AS min, round((m - floor(m)) * 60, 4) AS sec,
       CASE WHEN v < 0 THEN 'S' WHEN v > 0 THEN 'N' ELSE '' END AS ref, round(v, 5) AS back
FROM d
""")
def dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("d", text.to_dms(F.col("c_acctbal") / 100, "S", "N"))
    written = F.format_string("%d deg %d' %.5f\" %s", "d.deg", "d.min", "d.sec", "d.ref")
    return c.select("c_custkey", "d.deg", "d.min", F.round("d.sec", 4).alias("sec"), "d.ref",
                    F.round(text.dms_to_decimal(written), 5).alias("back"))


@work.query("first_number_in_text", """
SELECT event_id, CAST(regexp_extract(props, '([-+]?\\d*\\.\\d+|\\d+)', 1) AS DOUBLE) AS number, value AS signed
FROM events
""")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.extract_float(F.col("props")).alias("number"),
                    text.extract_float(F.concat(F.lit("T: "), F.format_string("%.2f", "value"), F.lit(" C"))).alias("signed"))


@work.query("gps_status_names", """
SELECT event_id, CASE user_id % 9 WHEN 0 THEN 'No GPS' WHEN 1 THEN 'No Fix' WHEN 2 THEN '2D Fix' WHEN 3 THEN '3D Fix'
  WHEN 4 THEN 'DGPS' WHEN 5 THEN 'RTK Float' WHEN 6 THEN 'RTK Fixed' ELSE 'Unknown (' || user_id % 9 || ')' END AS status
FROM events
""")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.gps_status((F.col("user_id") % 9).cast("int")).alias("status"))


@work.query("natural_sort_key", """
WITH p AS (SELECT p_partkey, p_brand || '-' || p_name || lpad(CAST(p_size AS VARCHAR), 4, '0') AS s FROM part)
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(s, '(\\d+|[^0-9]+)'), lambda r:
  CASE WHEN regexp_matches(r, '^\\d') THEN lpad(CAST(length(CAST(CAST(r AS BIGINT) AS VARCHAR)) AS VARCHAR), 6, '0') || CAST(r AS BIGINT)
       ELSE lower(r) END), '|') AS key FROM p
""")
def natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = F.concat("p_brand", F.lit("-"), "p_name", F.lpad(F.col("p_size").cast("string"), 4, "0"))
    return p.select("p_partkey", F.array_join(text.natural_key(s), "|").alias("key"))


@work.query("normalised_plot_labels", """
SELECT event_id, CASE user_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE user_id || '.5' END AS label
FROM events
""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events"), F.col("user_id").cast("string")
    raw = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" "), u, F.lit(".0 "))).when(
        F.col("user_id") % 3 == 1, u).otherwise(F.concat(u, F.lit(".5")))
    return e.select("event_id", text.norm_label(raw).alias("label"))


@work.query("labelled_plots", """
SELECT c_custkey FROM customer WHERE c_mktsegment IN ('FURNITURE', 'AUTOMOBILE')
""")
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    c = table(spark, sf_dir, "customer").withColumn("accession", F.when(seg == "MACHINERY", "Unknown").when(
        seg == "HOUSEHOLD", "  ").when(seg.isin("FURNITURE", "AUTOMOBILE"), seg))
    return labeled_plots(c).select("c_custkey")


@work.query("plot_names", """
WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN CAST(c_nationkey AS VARCHAR) END AS plot,
                  CASE WHEN c_acctbal > 1000 THEN c_mktsegment END AS acc FROM customer)
SELECT c_custkey, 'Plot_' || coalesce(plot, 'Unknown') || coalesce('_Acc_' || acc, '') AS label,
       CASE WHEN plot IS NOT NULL AND acc IS NOT NULL THEN 'plot_' || plot || '_accession_' || acc
            WHEN plot IS NOT NULL THEN 'plot_' || plot ELSE 'plot_' || c_custkey END AS export
FROM c
""")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    plot = F.when(F.col("c_nationkey") > 5, F.col("c_nationkey").cast("string"))
    acc = F.when(F.col("c_acctbal") > 1000, F.col("c_mktsegment"))
    return c.select("c_custkey", text.plot_label(plot, acc).alias("label"),
                    text.export_name(plot, acc, F.col("c_custkey")).alias("export"))


@work.query("clean_paths", """
SELECT doc_id, trim(regexp_replace(strip_accents(text), '[^\\x20-\\x7e]', '', 'g')) AS path FROM documents
""")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.clean_path(F.col("text")).alias("path"))


@work.query("ids_in_paths", """
SELECT event_id, 'u' || user_id AS locate, strftime(ts, '%Y-%m-%d') AS date, CAST(user_id AS INTEGER) AS plot,
       CAST(event_id % 7 AS INTEGER) AS version, 'x' || user_id AS run, 'a' || event_id AS stem
FROM events
""")
def path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events"), F.col("user_id").cast("string")
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    path = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return e.select(
        "event_id", text.locate_id(path("r/", day, "/Locate-u", u, "/locate.csv")).alias("locate"),
        text.iso_date(path("Raw/", day, "/top")).alias("date"),
        F.when(F.col("event_id") % 2 == 0, text.plot_number(path("a/temp_plot_", u, ".png"))).otherwise(
            text.plot_number(path("plot_", u, "_accession_q.png"))).alias("plot"),
        text.version_number(path("Stitch_v", (F.col("event_id") % 7).cast("string")), "Stitch").alias("version"),
        text.run_suffix(path("Plant-x", u)).alias("run"),
        text.stem(path("a.b/a", F.col("event_id").cast("string"), ".txt")).alias("stem"))


@work.query("mask_present", """
SELECT doc_id, CAST(doc_id % 4 = 0 AS INTEGER) AS masks FROM documents
""")
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    j = F.when(k == 0, F.to_json(F.array("text"))).when(k == 1, F.lit("[]")).when(k == 2, F.col("text"))
    return d.select("doc_id", text.mask_count(j).alias("masks"))


@work.query("altitude_choice", """
SELECT event_id, round(CASE WHEN user_id % 4 > 0 THEN user_id % 4 / 3.0::DOUBLE ELSE value END, 2) AS alt,
       CASE WHEN user_id % 4 > 0 THEN 'rangefinder' ELSE 'gps' END AS alt_source FROM events
""")
def altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("user_id") % 4
    return e.select("event_id", choose_altitude(F.col("value"), F.when(k != 2, k / 3.0).otherwise(k / 3.0)).alias("a")
                    ).select("event_id", "a.alt", "a.alt_source")


@work.query("pixel_to_world_and_back", """
SELECT event_id, round(10 + value * 2 + user_id * 0.5::DOUBLE, 6) AS x, round(20 + value * 0.25 - user_id * 3, 6) AS y,
       round(value, 6) AS col, round(user_id::DOUBLE, 6) AS row FROM events
""")
def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = F.array(*[F.lit(float(v)) for v in (10, 2, 0.5, 20, 0.25, -3)])
    e = table(spark, sf_dir, "events").withColumn("w", pixel_to_world(F.col("value"), F.col("user_id"), gt))
    e = e.withColumn("p", world_to_pixel(F.col("w.x"), F.col("w.y"), gt))
    return e.select("event_id", *[F.round(f"{s}.{c}", 6).alias(c) for s, c in (
        ("w", "x"), ("w", "y"), ("p", "col"), ("p", "row"))])


@work.query("ground_sample_distance", """
SELECT event_id, round(CASE WHEN user_id % 3 = 0 THEN (value / 800 + value / 810) / 2 ELSE (value / 1400 + value / 1350) / 2 END, 8) AS gsd
FROM events
""")
def gsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    cam = lambda fx, fy, w, h: F.struct(
        F.array(*[F.lit(float(v)) for v in (fx, 0, 4, 0, fy, 3, 0, 0, 1)]).alias("intrinsicMatrix"),
        F.lit(w).alias("width"), F.lit(h).alias("height"))
    cameras = F.array(cam(1400, 1350, 1920, 1080), cam(800, 810, 640, 480))
    e = table(spark, sf_dir, "events")
    width = F.when(F.col("user_id") % 3 == 0, 640).when(F.col("user_id") % 3 == 1, 1920).otherwise(7)
    return e.select("event_id", F.round(gsd_from_intrinsics(cameras, F.col("value"), width, F.lit(9)), 8).alias("gsd"))


@work.query("ground_sample_distance_of_a_matrix", """
SELECT event_id, round(CASE user_id % 3 WHEN 0 THEN value / 1000 WHEN 1 THEN (value / (800 + user_id) + value / 810) / 2 END, 8) AS gsd
FROM events
""")
def gsd_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    row = lambda *v: F.array(*[(x if not isinstance(x, int) else F.lit(x)).cast("double") for x in v])
    matrix = F.when(u % 3 == 1, F.array(row(800 + u, 0, 960), row(0, 810, 540), row(0, 0, 1))).when(
        u % 3 == 2, F.array(row(0, 0, 1)))
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(gsd_from_matrix(matrix, F.col("value")), 8).alias("gsd"))


@work.query("rotated_affine_terms", """
WITH t AS (SELECT event_id, value / 100 + pi() AS q, user_id / 10.0 AS u FROM events)
SELECT event_id, round(0.02 * cos(q), 8) AS a, round(0.03 * sin(q), 8) AS b, round(500 - u * cos(q) - 2 * sin(q), 6) AS c,
       round(0.02 * sin(q), 8) AS d, round(-0.03 * cos(q), 8) AS e, round(900 - u * sin(q) + 2 * cos(q), 6) AS f FROM t
""")
def affine_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = rotated_affine(-F.col("user_id") / 10.0, F.lit(2.0), F.col("value") / 100, F.lit(0.02), F.lit(0.03),
                       F.lit(500.0), F.lit(900.0))
    digits = {"a": 8, "b": 8, "c": 6, "d": 8, "e": 8, "f": 6}
    return e.select("event_id", t.alias("t")).select(
        "event_id", *[F.round(f"t.{c}", n).alias(c) for c, n in digits.items()])
