"""Aggregates: events as telemetry, line items as plants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import traits as T
from furrow.plans.skew import exact_quantiles
from furrow.workloads import Workload
from furrow.workloads.tables import table

work = Workload()


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("user_id")
    return e.select(
        "event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        F.col("value").alias("alt"), (k % 13).cast("int").alias("satellites"), (F.col("value") / 7).alias("hdop"),
        (F.col("value") / 3).alias("ground_speed"), (k % 9).cast("int").alias("status"),
        F.when(k % 5 > 0, F.col("value") - 20).alias("rangefinder_distance"),
        F.when(k % 3 > 0, F.col("value") / 11).alias("roll"), (F.col("value") / 13).alias("pitch"),
        F.when(k % 4 > 0, F.col("value") / 17).alias("yaw"))


@work.query("gps_quality_means", """
SELECT l_suppkey, round(avg(l_quantity), 9) AS avg_heading_accuracy, round(avg(l_tax), 9) AS avg_speed_accuracy,
       round(avg(l_discount), 9) AS avg_horizontal_accuracy, round(avg(l_linenumber), 9) AS avg_vertical_accuracy
FROM lineitem GROUP BY 1
""")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_quantity").alias("heading_accuracy"), F.col("l_tax").alias("speed_accuracy"),
        F.col("l_discount").alias("horizontal_accuracy"), F.col("l_linenumber").alias("vertical_accuracy"))
    out = T.gps_quality(li, "pvt", ["l_suppkey"])
    return out.select("l_suppkey", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@work.query("altitude_source_summary", """
WITH a AS (SELECT *, CASE WHEN user_id % 5 > 0 AND value - 20 > 0 THEN round(value - 20, 2) ELSE round(value, 2) END AS alt,
                  CASE WHEN user_id % 5 > 0 AND value - 20 > 0 THEN 'rangefinder' ELSE 'gps' END AS alt_source FROM events)
SELECT alt_source, count(*) AS records, min(alt) AS min_alt, max(alt) AS max_alt, round(avg(alt), 6) AS avg_alt,
       round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events), 6) AS percent FROM a GROUP BY 1
""")
def alt_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).select(T.choose_altitude(F.col("alt"), F.col("rangefinder_distance")).alias("a")).select("a.*")
    return T.alt_source_summary(t).withColumn("avg_alt", F.round("avg_alt", 6)).withColumn("percent", F.round("percent", 6))


@work.query("attitude_summary", """
SELECT count(*) FILTER (user_id % 3 > 0 AND user_id % 4 > 0) AS complete, count(*) AS records,
       round(min(value / 11) FILTER (user_id % 3 > 0 AND user_id % 4 > 0), 6) AS min_roll, round(max(value / 11) FILTER (user_id % 3 > 0 AND user_id % 4 > 0), 6) AS max_roll, round(avg(value / 11) FILTER (user_id % 3 > 0 AND user_id % 4 > 0), 6) AS avg_roll,
       round(min(value / 13) FILTER (user_id % 3 > 0 AND user_id % 4 > 0), 6) AS min_pitch, round(max(value / 13) FILTER (user_id % 3 > 0 AND user_id % 4 > 0), 6) AS max_pitch, round(avg(value / 13) FILTER (user_id % 3 > 0 AND user_id % 4 > 0), 6) AS avg_pitch,
       round(min(value / 17) FILTER (user_id % 3 > 0 AND user_id % 4 > 0), 6) AS min_yaw, round(max(value / 17) FILTER (user_id % 3 > 0 AND user_id % 4 > 0), 6) AS max_yaw, round(avg(value / 17) FILTER (user_id % 3 > 0 AND user_id % 4 > 0), 6) AS avg_yaw FROM events
""")
def attitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.attitude_summary(telemetry(spark, sf_dir))
    return s.select("complete", "records", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


@work.query("flight_summary", """
SELECT user_id, count(*) AS samples, max(value) AS max_alt, min(value) AS min_alt, avg(user_id % 13) AS avg_satellites,
       round(avg(value / 7), 6) AS avg_hdop, round(avg(value / 3), 6) AS avg_ground_speed FROM events GROUP BY 1
""")
def flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.flight_summary(telemetry(spark, sf_dir), ["user_id"])
    return s.withColumn("avg_hdop", F.round("avg_hdop", 6)).withColumn("avg_ground_speed", F.round("avg_ground_speed", 6))


@work.query("rangefinder_coverage", """
SELECT count(*) FILTER (user_id % 5 > 0 AND value > 20) AS covered, count(*) AS records,
       round(min(value - 20) FILTER (user_id % 5 > 0 AND value > 20), 6) AS min_distance,
       round(max(value - 20) FILTER (user_id % 5 > 0), 6) AS max_distance,
       round(avg(value - 20) FILTER (user_id % 5 > 0 AND value > 20), 6) AS avg_distance FROM events
""")
def rangefinder(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.rangefinder_summary(telemetry(spark, sf_dir))
    return s.select("covered", "records", *[F.round(f"{m}_distance", 6).alias(f"{m}_distance") for m in ("min", "max", "avg")])


@work.query("fix_status_histogram", """
SELECT CAST(user_id % 9 AS INTEGER) AS status, CASE user_id % 9 WHEN 0 THEN 'No GPS' WHEN 1 THEN 'No Fix' WHEN 2 THEN '2D Fix'
  WHEN 3 THEN '3D Fix' WHEN 4 THEN 'DGPS' WHEN 5 THEN 'RTK Float' WHEN 6 THEN 'RTK Fixed' ELSE 'Unknown (' || user_id % 9 || ')' END AS label,
  count(*) AS count FROM events GROUP BY ALL
""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.status_histogram(telemetry(spark, sf_dir))


@work.query("drone_messages", """
SELECT event_id, strftime(ts, '%Y:%m:%d %H:%M:%S.%f') || ' +0000' AS time, round(epoch_us(ts) / 1e6, 6) AS timestamp,
       CASE WHEN user_id % 5 > 0 AND value - 20 > 0 THEN 'rangefinder' ELSE 'gps' END AS alt_source, round(value, 2) AS gps_alt
FROM events
""")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).select(
        F.col("event_id").alias("image_path"), "timestamp", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), "alt",
        F.col("rangefinder_distance").alias("distance"), "roll", "pitch", "yaw")
    return T.drone_messages(t).select(F.col("image_path").alias("event_id"), "time", "timestamp", "alt_source", "gps_alt")


@work.query("plant_means_of_batch_means", """
WITH b AS (SELECT l_suppkey, l_linenumber, l_returnflag, avg(l_quantity) AS h, avg(l_extendedprice) AS a FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_linenumber, ceil(avg(h)) AS "Height (cm)", ceil(avg(a)) AS "Area (cm2)" FROM b GROUP BY ALL
""")
def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_quantity", "Height (cm)").withColumnRenamed(
        "l_extendedprice", "Area (cm2)")
    return T.plant_means(li, ["l_suppkey", "l_linenumber"], "l_returnflag", ["Height (cm)", "Area (cm2)"])


@work.query("plot_trait_rollup", """
SELECT CAST(s_suppkey AS INTEGER) AS "Bed", CAST(k AS INTEGER) AS "Tier", s_name AS plot, 'acc' || s_nationkey AS accession,
       CAST(count(*) AS INTEGER) AS stand, round_even(coalesce(avg(l_quantity), 0), 1) AS height, CAST(coalesce(sum(l_linenumber), 0) AS INTEGER) AS pods
FROM supplier, range(1, 12) r(k) LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linenumber = k
GROUP BY ALL
""")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("Bed"), F.explode(F.sequence(F.lit(1), F.lit(11))).alias("Tier"),
        F.col("s_name").alias("plot"), F.concat(F.lit("acc"), F.col("s_nationkey").cast("string")).alias("accession"),
        F.lit("p").alias("population"))
    plants = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("Bed"), F.col("l_linenumber").alias("Tier"), "l_orderkey",
        F.col("l_quantity").alias("Height (cm)"), F.col("l_tax").alias("Area (cm2)"),
        F.col("l_linenumber").cast("double").alias("Pod Count"))
    out = T.plot_traits(plants, areas, "pod", "l_orderkey")
    return out.select("Bed", "Tier", "plot", "accession", F.col("`Stand Count`").alias("stand"),
                      F.col("`Average Height (cm)`").alias("height"), F.col("`Total Pod Count`").alias("pods"))


@work.query("exact_quantile_spread", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS low, round(quantile_cont(l_extendedprice, 0.95), 4) AS high
FROM lineitem GROUP BY 1
""")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], {"low": 0.05, "high": 0.95})
    return out.select("l_returnflag", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))
