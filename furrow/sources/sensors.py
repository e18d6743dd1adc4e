"""Decoded sensor rows brought to their fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.geo import heading_direction
from furrow.operators.plots import q

# Columns of the GPS topics, in order.
GPS_COLUMNS = {
    "pvt": ["stamp", "gps_time", "longitude", "latitude", "altitude", "heading_motion",
            "heading_accuracy", "speed_accuracy", "horizontal_accuracy", "vertical_accuracy",
            "p_dop", "height"],
    "relposned": ["stamp", "relative_pose_north", "relative_pose_east", "relative_pose_down",
                  "relative_pose_heading", "relative_pose_length", "rel_pos_valid",
                  "rel_heading_valid", "accuracy_north", "accuracy_east", "accuracy_down",
                  "accuracy_length", "accuracy_heading"],
}

# EXIF tags of a time, in order of preference.
TIME_TAGS = [36867, 36868, 306]

# Message fields of the flight controller and their column names.
GPS_FIELDS = {
    "TimeUS": "time_usec", "I": "gps_instance", "Status": "status", "GWk": "gps_week", "GMS": "gps_ms",
    "Lat": "lat", "Lng": "lon", "Alt": "alt", "HDop": "hdop", "NSats": "satellites", "Spd": "ground_speed",
    "GCrs": "ground_course", "VZ": "vertical_velocity", "Yaw": "yaw", "U": "usage_flags",
}


def _field(df: DataFrame, name: str) -> Column:
    return q(name) if name in df.columns else F.lit(None).cast("double")


def telemetry_gps(msgs: DataFrame, missing: float = 0.0) -> DataFrame:
    """GPS messages; a position of exactly ``missing`` is none, the instance defaults to 0.

    The flight controller writes 0 for a position it does not have; a recorder
    that marks it otherwise keeps positions of 0.
    """
    cols = []
    for field, name in GPS_FIELDS.items():
        value = _field(msgs, field)
        if name in ("lat", "lon", "alt"):
            value = F.when(value != missing, value)
        if name == "gps_instance" and field not in msgs.columns:
            value = F.lit(0)
        cols.append(value.alias(name))
    return msgs.select("timestamp", *cols)


def telemetry_att(msgs: DataFrame) -> DataFrame:
    """Attitude messages in degrees."""
    return msgs.select("timestamp", _field(msgs, "TimeUS").alias("time_boot_ms"), F.col("Roll").alias("roll"),
                       F.col("Pitch").alias("pitch"), F.col("Yaw").alias("yaw"))


def telemetry_bat(msgs: DataFrame) -> DataFrame:
    """Battery messages; -1 is missing, the remaining charge a share."""
    known = lambda c: F.when(F.col(c) != -1, F.col(c))
    return msgs.select("timestamp", known("VoltR").alias("voltage"), known("Curr").alias("current"),
                       (F.col("RemPct") / 100.0).alias("battery_remaining"))


def telemetry_rfnd(msgs: DataFrame) -> DataFrame:
    """Rangefinder messages."""
    return msgs.select("timestamp", F.col("Dist").alias("distance"))


def conform_gps(rows: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """GPS rows with the topic's columns: booleans 1/0, other text null, one row per stamp.

    Missing columns become null.  The stamp is a whole number of microseconds.
    With ``by``, columns that come along in front, stamps are told apart by them,
    too: receivers or recordings may share one.
    """

    def number(name: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast("double")
        text = q(name).cast("string")
        return F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0).otherwise(
            text.try_cast("double"))

    cols = [number(c).cast("long").alias(c) if c in ("stamp", "gps_time") else number(c).alias(c)
            for c in GPS_COLUMNS[kind]]
    rest = [c for c in GPS_COLUMNS[kind] if c != "stamp"]
    # the smallest row of equal stamps: independent of the order files are read in
    return rows.select(*by, *cols).groupBy(*by, "stamp").agg(F.min(F.struct(*rest)).alias("_r")).select(
        *by, "stamp", "_r.*").orderBy("stamp", *by)


def camera_timestamps(events: DataFrame, topics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per frame number, one column per camera topic; incomplete frames dropped."""
    wide = events.groupBy(*by, "sequence_num").pivot("topic", list(topics)).agg(F.max("stamp"))
    return wide.na.drop(subset=[*by, *[f"`{t}`" if "." in t else t for t in topics]])


def topic_report(events: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Which wanted topics occur, and how many stamps each has."""
    listed = events.sparkSession.createDataFrame([(t,) for t in wanted], "topic string")
    found = events.groupBy("topic").agg(F.count("*").alias("stamps"))
    return listed.join(found, "topic", "left").select(
        "topic", F.coalesce("stamps", F.lit(0)).alias("stamps"), F.col("stamps").isNotNull().alias("existing"))


def derive_files(synced: DataFrame, image_columns: Sequence[str]) -> DataFrame:
    """File names, direction and short position names of a synced table."""
    out = synced
    for c in image_columns:
        ending = ".npy" if "disparity" in c else ".jpg"
        out = out.withColumn(c, q(c).cast("long")).withColumn(
            f"{c}_file", F.concat(F.lit(f"{c}-"), q(c).cast("string"), F.lit(ending)))
    if "heading_motion" in out.columns:
        out = out.withColumn("direction", heading_direction(F.col("heading_motion")))
    return out.withColumnRenamed("longitude", "lon").withColumnRenamed("latitude", "lat")


def normalize_exif(raw: DataFrame) -> DataFrame:
    """Image rows from decoded EXIF: first time tag, GPS time in UTC, signed position.

    GPS date and time replace the tag time and give the stamp.  Portrait images
    are stored turned, so their sides are exchanged.
    """
    tag = lambda i: F.nullif(F.try_element_at("tags", F.lit(i)), F.lit(""))
    at = F.try_to_timestamp(F.concat_ws(" ", "gps_date", "gps_time"), F.lit("yyyy:MM:dd HH:mm:ss"))
    at = F.when(F.col("gps_date").isNotNull() & F.col("gps_time").isNotNull(), at)
    part = lambda c, i: F.get(F.col(c), F.lit(i))
    degrees = lambda c: part(c, 0) + part(c, 1) / 60 + part(c, 2) / 3600
    signed = lambda c, ref, minus: F.when(F.col(ref) == minus, -degrees(c)).otherwise(degrees(c))
    portrait = F.col("height") > F.col("width")
    return raw.select(
        "image_path",
        F.coalesce(F.date_format(at, "yyyy:MM:dd HH:mm:ss.SSSSSS xx"), *[tag(i) for i in TIME_TAGS]).alias("time"),
        (F.unix_micros(at) / 1e6).alias("timestamp"),
        signed("gps_lat", "gps_lat_ref", "S").alias("lat"), signed("gps_lon", "gps_lon_ref", "W").alias("lon"),
        F.col("gps_alt").alias("alt"),
        F.when(portrait, F.col("height")).otherwise(F.col("width")).alias("naturalWidth"),
        F.when(portrait, F.col("width")).otherwise(F.col("height")).alias("naturalHeight"))
