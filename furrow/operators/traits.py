"""Aggregates over telemetry, detections and trait tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.text import gps_status
from furrow.operators.plots import q

# Quality columns of the two GPS topics.
GPS_QUALITY = {
    "pvt": ["heading_accuracy", "speed_accuracy", "horizontal_accuracy", "vertical_accuracy"],
    "relposned": ["accuracy_north", "accuracy_east", "accuracy_down", "accuracy_length", "accuracy_heading"],
}


def gps_quality(gps: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each quality column of a GPS topic."""
    return gps.groupBy(*by).agg(*[F.avg(c).alias(f"avg_{c}") for c in GPS_QUALITY[kind]])


def alt_source_summary(msgs: DataFrame) -> DataFrame:
    """Rows, share and altitude range per altitude source."""
    sourced = msgs.where(F.col("alt_source").isNotNull())
    total = msgs.select(F.count("*")).scalar()
    return sourced.groupBy("alt_source").agg(
        F.count("*").alias("records"), F.min("alt").alias("min_alt"), F.max("alt").alias("max_alt"),
        F.avg("alt").alias("avg_alt")).withColumn("percent", F.col("records") * 100.0 / total)


def attitude_summary(msgs: DataFrame) -> DataFrame:
    """Range of roll, pitch and yaw over complete rows, and how many rows are complete."""
    angles = ("roll", "pitch", "yaw")
    complete = F.col("roll").isNotNull() & F.col("pitch").isNotNull() & F.col("yaw").isNotNull()
    over = lambda fn, c: fn(F.when(complete, F.col(c)))
    return msgs.agg(
        F.count_if(complete).alias("complete"), F.count("*").alias("records"),
        *[over(fn, c).alias(f"{name}_{c}") for c in angles
          for name, fn in (("min", F.min), ("max", F.max), ("avg", F.avg))])


def flight_summary(gps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples, altitude range and mean reception and speed of a flight."""
    return gps.groupBy(*by).agg(
        F.count("*").alias("samples"), F.max("alt").alias("max_alt"), F.min("alt").alias("min_alt"),
        F.avg("satellites").alias("avg_satellites"), F.avg("hdop").alias("avg_hdop"),
        F.avg("ground_speed").alias("avg_ground_speed"))


def rangefinder_summary(msgs: DataFrame, distance: str = "rangefinder_distance") -> DataFrame:
    """Range and coverage of positive rangefinder distances."""
    valid = F.when(F.col(distance) > 0, F.col(distance))
    return msgs.agg(
        F.count(valid).alias("covered"), F.count("*").alias("records"), F.min(valid).alias("min_distance"),
        F.max(valid).alias("max_distance"), F.avg(valid).alias("avg_distance"))


def status_histogram(gps: DataFrame) -> DataFrame:
    """Rows per fix status with its name, in code order."""
    return gps.where(F.col("status").isNotNull()).groupBy("status").agg(F.count("*").alias("count")).select(
        "status", gps_status(F.col("status")).alias("label"), "count").orderBy("status")


def choose_altitude(gps_alt: Column, distance: Column) -> Column:
    """Positive rangefinder distance, else GPS altitude, with its source; 2 decimals."""
    use = distance > 0
    return F.struct(
        F.when(use, F.round(distance, 2)).otherwise(F.round(gps_alt, 2)).alias("alt"),
        F.when(use, "rangefinder").when(gps_alt.isNotNull(), "gps").alias("alt_source"))


def drone_messages(gps: DataFrame) -> DataFrame:
    """Position rows of a flight joined to distance and attitude, in stored precision."""
    kept = gps.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    chosen = kept.withColumn("_a", choose_altitude(F.col("alt"), F.col("distance")))
    two = lambda c, name: F.round(c, 2).alias(name)
    stamp = F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("long"))
    return chosen.select(
        "image_path", F.date_format(stamp, "yyyy:MM:dd HH:mm:ss.SSSSSS xx").alias("time"),
        F.round("timestamp", 6).alias("timestamp"), F.round("lat", 8).alias("lat"),
        F.round("lon", 8).alias("lon"), F.col("_a.alt").alias("alt"), F.col("_a.alt_source").alias("alt_source"),
        two("alt", "gps_alt"), two("distance", "rangefinder_distance"), two("roll", "roll"),
        two("pitch", "pitch"), two("yaw", "yaw"))


def plant_means(rows: DataFrame, keys: Sequence[str], batch: str, cols: Sequence[str]) -> DataFrame:
    """Mean per plant of its means per batch, rounded up."""
    per_batch = rows.groupBy(*keys, batch).agg(*[F.avg(q(c)).alias(c) for c in cols])
    return per_batch.groupBy(*keys).agg(*[F.ceil(F.avg(q(c))).cast("double").alias(c) for c in cols])


def plot_traits(
    plants: DataFrame, boundaries: DataFrame, trait: str, order: str, count_padded: bool = True,
) -> DataFrame:
    """Traits per (Bed, Tier) of every boundary.

    Names are the first non-null ones in ``order``; height and area are means,
    the trait a sum, the stand count the number of rows.  A plot without plants
    counts one row unless ``count_padded`` is off.
    """
    column = f"{trait.capitalize()} Count"
    joined = plants.withColumn("_plant", F.lit(True)).join(boundaries, ["Bed", "Tier"], "right")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(order)))).alias(c)
    stand = F.count("*") if count_padded else F.count("_plant")
    out = joined.groupBy("Bed", "Tier").agg(
        first("plot"), first("accession"), first("population"), stand.cast("int").alias("Stand Count"),
        F.bround(F.avg(q("Height (cm)")), 1).alias("Average Height (cm)"),
        F.bround(F.avg(q("Area (cm2)")), 1).alias("Average Leaf Area (cm2)"),
        F.sum(q(column)).cast("int").alias(f"Total {column}"))
    return out.na.fill("0").na.fill(0)
