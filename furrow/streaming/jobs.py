"""Streaming jobs.

The functions take and return DataFrames, streaming or not, so a batch run over
the same rows gives the same answer; the ``start_*`` functions attach sinks.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from furrow.plans.storage import append_new, write_snapshot

# Log lines that mark the stages of an orthomosaic job, in order.
ORTHO_STAGES = [
    "Running dataset stage",
    "Finished dataset stage",
    "Computing pair matching",
    "Merging features onto tracks",
    "Export reconstruction stats",
    "Finished opensfm stage",
    "Densifying point-cloud completed",
    "Finished openmvs stage",
    "Finished odm_filterpoints stage",
    "Finished mvs_texturing stage",
    "Finished odm_georeferencing stage",
    "Finished odm_dem stage",
    "Finished odm_orthophoto stage",
    "Finished odm_report stage",
    "Finished odm_postprocess stage",
    "ODM app finished",
    "Copied RGB.tif",
    "Generated RGB-Pyramid.tif",
    "Copied DEM.tif",
    "Generated DEM-Pyramid.tif",
    "Orthomosaic Generation Completed",
]

# Lines that show a plot's stitching has ended.
PLOT_DONE = ["Done", "Saving mosaic at full resolution", "Process completed", "Finished"]

# Last steps of a stitching job, in order, and its counting lines.
STITCH_STEPS = [
    "Retrieving batches",
    "Straightening batches",
    "Extracting batch features",
    "Matching batch features",
    "Stitching batches",
    "Straightening final mosaic",
    "Saving mosaic at full resolution",
    "Saving mosaic at resized resolution",
    "Deleting intermediate images",
    "Done",
]
FOUND_IMAGES = r"Found (\d+) images"
MATCHED_IMAGES = r"Succesfully matched image (\d+) and (\d+)"

# Seconds after which a folder is listed again, and is forgotten.
STALE_SECONDS, RETENTION_SECONDS = 300, 3600


def _first_marker(line: Column, markers: Sequence[str]) -> Column:
    """Index of the first marker, in list order, that the line contains."""
    return F.coalesce(*[F.when(line.contains(m), F.lit(i)) for i, m in enumerate(markers)])


def log_progress(
    lines: DataFrame, by: Sequence[str], order: str, stages: Sequence[str] = ORTHO_STAGES,
) -> DataFrame:
    """Percent done per job: the stage its last matching line marks."""
    stage = _first_marker(F.col("value"), stages)
    last = lines.withColumn("stage", stage).groupBy(*by).agg(
        F.max_by("stage", F.when(F.col("stage").isNotNull(), F.col(order))).alias("stage"))
    percent = F.bround((F.col("stage") + 1) / float(len(stages)) * 100, 0).cast("int")
    return last.select(*by, "stage", F.coalesce(percent, F.lit(0)).alias("progress"))


def plots_done(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Whether each plot's log shows its end."""
    hit = F.lit(False)
    for marker in PLOT_DONE:
        hit = hit | F.col("value").contains(marker)
    return lines.groupBy(*by).agg(F.max(hit).alias("done"))


def plots_progress(done: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percent of plots that have ended, up to 95."""
    return done.groupBy(*by).agg(
        F.floor(F.count_if("done") * 95 / F.count("*")).cast("int").alias("progress"))


def stitch_progress(lines: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Percent done per stitching job: matched images up to 90, then ten last steps."""
    value = F.col("value")
    found = F.regexp_extract(value, FOUND_IMAGES, 1).try_cast("int")
    matched = F.regexp_extract(value, MATCHED_IMAGES, 2).try_cast("int")
    facts = lines.select(*by, order, found.alias("f"), matched.alias("m"),
                         _first_marker(value, STITCH_STEPS).alias("s"))
    sums = facts.groupBy(*by).agg(
        F.min_by("f", F.when(F.col("f").isNotNull(), F.col(order))).alias("total"),
        F.max("m").alias("matched"), F.max("s").alias("step"))
    steps = len(STITCH_STEPS)
    # least() and greatest() pass over nulls: without both numbers there is no share
    share = F.when(F.col("matched").isNotNull() & (F.col("total") > 0),
                   F.least(F.lit(90), F.floor(F.col("matched") / F.col("total") * 90)))
    final = F.when(F.col("step") == steps - 1, 100).when(
        F.col("step").isNotNull(), 90 + F.floor(F.col("step") / steps * 10))
    return sums.select(*by, F.coalesce(F.greatest(final, share), F.lit(0)).cast("int").alias("progress"))


def latest_metrics(metrics: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Latest epoch per run with its metric."""
    return metrics.groupBy(*by).agg(
        F.max("epoch").alias("epoch"), F.max_by(F.col(f"`{metric}`"), "epoch").alias("map"))


def upload_status(chunks: DataFrame) -> DataFrame:
    """Parts received per file, and whether all of them are there.

    A file has a bounded number of parts, so their set is small.
    """
    valid = F.when((F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("total_chunks")),
                   F.col("chunk_index"))
    return chunks.groupBy("file_identifier").agg(
        F.size(F.collect_set(valid)).alias("received"), F.max("total_chunks").alias("total")
    ).withColumn("complete", F.col("received") == F.col("total"))


# --- matching


def stream_asof(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, left_id: str, order: str,
    tolerance: str = "1 second", watermark: str = "10 seconds", prefix: str = "r_",
) -> DataFrame:
    """Nearest right row within a tolerance for rows of two streams.

    ``on`` is a timestamp on both sides.  An interval join with watermarks keeps
    only rows that can still match; the nearest is picked when the watermark has
    passed the left row.  Ties go to the earlier row, rows later than the
    watermark are dropped, and left rows without a match come back with nulls.
    """
    renamed = right.withWatermark(on, watermark).select(
        *[F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    interval = F.expr(f"interval {tolerance}")
    near = left.withWatermark(on, watermark).join(
        renamed,
        (F.col(f"{prefix}{on}") >= F.col(on) - interval) & (F.col(f"{prefix}{on}") <= F.col(on) + interval)
        & _same_keys(by, prefix), "left")
    gap = F.abs(F.unix_micros(on) - F.unix_micros(f"{prefix}{on}"))
    found = [c for c in renamed.columns if c not in [f"{prefix}{k}" for k in by]]
    best = near.groupBy(*by, left_id, on).agg(F.min_by(
        F.struct(*found), F.struct(gap, F.col(f"{prefix}{on}"), F.col(f"{prefix}{order}"))).alias("_best"))
    return best.select(*by, left_id, on, "_best.*")


def _same_keys(by: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in by:
        out = out & (F.col(k) == F.col(f"{prefix}{k}"))
    return out


# --- sinks


def fresh_rows(stream: DataFrame, on: str, keys: Sequence[str], watermark: str) -> DataFrame:
    """Rows without repeats of their keys inside the watermark."""
    return stream.withWatermark(on, watermark).dropDuplicatesWithinWatermark(list(keys))


def start_ingest(
    stream: DataFrame, target: str, checkpoint: str, on: str, keys: Sequence[str],
    watermark: str = "1 hour", partition_by: Sequence[str] = (),
) -> DataStreamWriter:
    """Append a stream to a Parquet table, each key once; repeated batches add nothing.

    With ``partition_by``, columns that follow from the key such as its day, a
    batch reads the keys of the partitions it touches only.
    """
    deduped = fresh_rows(stream, on, keys, watermark)
    return deduped.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: append_new(target, batch, keys, partition_by))


def start_snapshots(stream: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """Write every full result of an aggregating stream as the next snapshot."""
    return stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: write_snapshot(batch, target) and None)


def stream_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """New files below a folder as a stream, without their content."""
    found = (spark.readStream.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(root))
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def start_catalog(
    spark: SparkSession, root: str, target: str, checkpoint: str, pattern: str = "*",
) -> DataStreamWriter:
    """Keep a table of the files below a folder, looked at again when stale."""
    return stream_files(spark, root, pattern).writeStream.option(
        "checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: append_new(target, batch, ["path", "modified"])).trigger(
        processingTime=f"{STALE_SECONDS} seconds")


REFRESHED = "path string, stamp long, event string"


def catalog_refreshes(
    requests: DataFrame, stale: int = STALE_SECONDS, retention: int = RETENTION_SECONDS,
) -> DataFrame:
    """What a catalogue does with requests to refresh a path (``path, ts``), a stream with a watermark on ``ts``.

    A request counts as ``refreshed`` unless the path was refreshed less than
    ``stale`` seconds before; a path is forgotten, ``expired``, when the watermark
    has passed its last refresh by ``retention`` seconds.  ``stamp`` is the time
    of the event in microseconds.  The state is one number per path, and timers
    take it away, so it does not grow with the stream.
    """
    second = 1_000_000

    def follow(key, batches, state):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "stamp": [last + retention * second], "event": ["expired"]})
            return
        last = state.get[0] if state.exists else None
        done = []
        for stamp in sorted({int(s) for rows in batches for s in rows["stamp"]}):
            if last is None or stamp - last >= stale * second:
                last = stamp
                done.append(stamp)
        state.update((last,))
        state.setTimeoutTimestamp((last + retention * second) // 1000)
        yield pd.DataFrame({"path": [key[0]] * len(done), "stamp": done, "event": ["refreshed"] * len(done)})

    known = requests.where(F.col("path").isNotNull() & F.col("ts").isNotNull())
    return known.withColumn("stamp", F.unix_micros("ts")).groupBy("path").applyInPandasWithState(
        follow, REFRESHED, "last long", "append", "EventTimeTimeout")


def start_refreshes(
    requests: DataFrame, target: str, checkpoint: str, watermark: str = "0 seconds", **limits: int,
) -> DataStreamWriter:
    """Refreshes and expiries of a stream of requests, appended to a Parquet table exactly once."""
    told = catalog_refreshes(requests.withWatermark("ts", watermark), **limits)
    return told.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)


def known_files(listed: DataFrame, now: Column, retention: int = RETENTION_SECONDS) -> DataFrame:
    """Latest row per file, and whether its listing is still within retention."""
    newest = listed.groupBy("path").agg(F.max("modified").alias("modified"))
    age = F.unix_timestamp(now) - F.unix_timestamp("modified")
    return newest.select("path", "modified", (age <= retention).alias("current"))
