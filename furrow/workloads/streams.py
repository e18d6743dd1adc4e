"""Streaming jobs, run to the end over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.plans.session import shared_folder
from furrow.plans.storage import read_snapshot
from furrow.streaming import jobs
from furrow.workloads import Workload
from furrow.workloads.tables import TRACK_SQL, table

work = Workload()


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/furrow-streams/{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(spark: SparkSession, result: DataFrame) -> DataFrame:
    """Last snapshot of an aggregating stream that has read everything."""
    path = folder(spark)
    jobs.start_snapshots(result, f"{path}/out", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return read_snapshot(spark, f"{path}/out")


@work.query("stream_ingest_once", "SELECT event_id, user_id FROM events")
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts")
    for run in ("a", "b"):
        jobs.start_ingest(rows, f"{path}/out", f"{path}/{run}", "ts", ["event_id"]).trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "user_id")


@work.query("stream_asof_nearest", f"""
WITH {TRACK_SQL}, n AS (
  SELECT l.event_id, l.stamp, arg_min(r.event_id, (abs(r.stamp - l.stamp), r.stamp, r.event_id)) AS matched_id
  FROM track l LEFT JOIN (SELECT * FROM track WHERE event_type = 'click') r
    ON l.user_id = r.user_id AND abs(r.stamp - l.stamp) <= 3600000000
  WHERE l.event_type = 'view' GROUP BY ALL
)
SELECT event_id, coalesce(matched_id, -1) AS matched_id FROM n
""")
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    # one closing row per side, a day after the last, lets the watermark pass all the others
    close = e.groupBy("event_type").agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "event_type", "ts")
    e.unionByName(close).write.parquet(f"{path}/in")
    rows = spark.readStream.schema(e.schema).parquet(f"{path}/in")
    side = lambda k: rows.where(F.col("event_type") == k).drop("event_type")
    out = jobs.stream_asof(side("view"), side("click"), ["user_id"], "ts", "event_id", "event_id", "1 hour", "1 minute")
    job = out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(
        availableNow=True).format("parquet").start(f"{path}/out")
    job.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").where(F.col("event_id") >= 0).select(
        "event_id", F.coalesce("r_event_id", F.lit(-1).cast("long")).alias("matched_id"))


def log_lines(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    markers = F.array(*[F.lit(m) for m in jobs.ORTHO_STAGES])
    return lines.select(
        (F.col("event_id") % 100).alias("job"), F.col("event_id").alias("line_no"),
        F.concat(F.lit("[INFO] "), F.when(F.col("user_id") % 2 == 0, F.get(markers, (F.col("user_id") % 21).cast("int"))).otherwise(
            F.lit("working")), F.lit(" 1.5s")).alias("value"))


_PROGRESS = """
WITH m AS (SELECT event_id % 100 AS job, arg_max(user_id % 21, event_id) FILTER (user_id % 2 = 0) AS stage FROM events GROUP BY 1)
SELECT job, CAST(coalesce(stage, -1) AS INTEGER) AS stage, CAST(coalesce(round_even((stage + 1) / 21.0::DOUBLE * 100, 0), 0) AS INTEGER) AS progress FROM m
"""


@work.query("log_progress", _PROGRESS)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.log_progress(log_lines(spark, sf_dir, table(spark, sf_dir, "events")), ["job"], "line_no").withColumn(
        "stage", F.coalesce("stage", F.lit(-1)))


@work.query("stream_log_progress", _PROGRESS)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir, stream(spark, sf_dir, "events"))
    return finished(spark, jobs.log_progress(lines, ["job"], "line_no")).withColumn(
        "stage", F.coalesce("stage", F.lit(-1)))


@work.query("plots_finished_share", """
WITH d AS (SELECT conv_id, bool_or(turn >= 3) AS done FROM conversations GROUP BY 1)
SELECT CAST(floor(count(*) FILTER (done) * 95 / count(*)) AS INTEGER) AS progress FROM d
""")
def plots_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id", F.when(F.col("turn") >= 3, "Process completed").otherwise("step").alias("value"))
    return jobs.plots_progress(jobs.plots_done(lines, ["conv_id"]))


_STITCH = """
WITH f AS (
  SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN user_id END AS total, max(CASE WHEN event_type = 'click' THEN event_id % 40 END) AS matched,
         max(CASE WHEN event_type = 'view' AND event_id % 50 < 9 THEN event_id % 50 END) AS step FROM events GROUP BY 1
)
SELECT user_id, CAST(coalesce(greatest(90 + floor(step * 1.0 / 10 * 10), CASE WHEN matched IS NOT NULL AND total > 0 THEN least(90, floor(matched / CAST(total AS DOUBLE) * 90)) END), 0) AS INTEGER) AS progress FROM f
"""


def stitch_lines(rows: DataFrame) -> DataFrame:
    steps = F.array(*[F.lit(s) for s in jobs.STITCH_STEPS])
    k = F.col("event_id")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("Found "), F.col("user_id").cast("string"), F.lit(" images"))).when(
        F.col("event_type") == "click", F.concat(F.lit("Succesfully matched image 1 and "), (k % 40).cast("string"))).when(
        (F.col("event_type") == "view") & (k % 50 < 9), F.get(steps, (k % 50).cast("int"))).otherwise(F.lit("."))
    return rows.select("user_id", k.alias("line_no"), text.alias("value"))


@work.query("stream_stitch_progress", _STITCH)
def stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, jobs.stitch_progress(stitch_lines(stream(spark, sf_dir, "events")), ["user_id"], "line_no"))


@work.query("stream_latest_metrics", "SELECT user_id, max(event_id) AS epoch, arg_max(value, event_id) AS map FROM events GROUP BY 1")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("epoch"), F.col("value").alias("metric"))
    return finished(spark, jobs.latest_metrics(rows, ["user_id"], "metric"))


@work.query("stream_upload_status", """
SELECT l_orderkey AS file_identifier, CAST(count(DISTINCT l_linenumber) AS INTEGER) AS received, 7 AS total,
       count(DISTINCT l_linenumber) = 7 AS complete FROM lineitem GROUP BY 1
""")
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = stream(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_identifier"), (F.col("l_linenumber") - 1).alias("chunk_index"), F.lit(7).alias("total_chunks"))
    return finished(spark, jobs.upload_status(chunks))


@work.query("known_files", """
SELECT 'f' || user_id AS path, epoch_us(max(ts)) >= epoch_us(TIMESTAMP '2024-01-31 00:00:00') - 3600000000 AS current FROM events GROUP BY 1
""")
def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("modified"))
    return jobs.known_files(e, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("path", "current")


# the first run sees the requests up to a stamp, the second the rest: timers span both
@work.query("catalog_refreshes_in_two_runs", """
WITH requests AS (SELECT user_id AS path, epoch_us(ts) AS stamp, (SELECT quantile_disc(epoch_us(ts), 0.6) FROM events) AS cut,
    (SELECT max(epoch_us(ts)) FROM events) AS last FROM events),
asked AS (SELECT path, cut, last, list(DISTINCT stamp ORDER BY stamp) AS stamps FROM requests GROUP BY ALL),
done AS (SELECT path, cut, last, list_reduce(stamps, lambda kept, s: CASE
    WHEN len(kept) = 0 OR s - kept[-1] >= 6 * 3600000000 THEN list_append(kept, s) ELSE kept END, stamps[1:0]) AS kept FROM asked),
ends AS (SELECT path, list_max(list_filter(kept, lambda s: s <= cut)) + 86400000000 AS stamp, cut AS passed FROM done
  UNION ALL SELECT path, list_max(kept) + 86400000000, last FROM done)
SELECT path, unnest(kept) AS stamp, 'refreshed' AS event FROM done
UNION ALL SELECT DISTINCT path, stamp, 'expired' FROM ends WHERE stamp // 1000 < passed // 1000
""")
def refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    limit = F.lit(int(e.select(F.expr("percentile_disc(0.6) WITHIN GROUP (ORDER BY unix_micros(ts))")).first()[0]))
    for part in (F.unix_micros("ts") <= limit, F.unix_micros("ts") > limit):
        e.where(part).write.mode("append").parquet(f"{path}/requests")
        requests = spark.readStream.schema(e.schema).parquet(f"{path}/requests")
        jobs.start_refreshes(requests, f"{path}/out", f"{path}/state", stale=6 * 3600, retention=86400).trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema(jobs.REFRESHED).parquet(f"{path}/out").select(F.col("path").cast("long").alias("path"), "stamp", "event")
