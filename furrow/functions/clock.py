"""Stamps: microseconds since epoch, seconds since epoch, and the texts they come in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000

# Date separators ':', '-', '/'; only ':' dates carry fractions.
_STAMP = (
    r"^(\d{4})([:/-])(\d{1,2})\2(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})"
    r"(\.\d{1,6})?(?: (Z|[+-]\d{2}:?\d{2}))?$"
)


def abs_stamp(base_micros: Column, stamp_seconds: Column) -> Column:
    """Absolute stamp of an event given in seconds after a base."""
    return (base_micros + stamp_seconds * MICROS).cast("long")


def base_stamp(name: Column) -> Column:
    """Start of a recording from ``YYYY_MM_DD_hh_mm_ss_micros_…``; null with fewer parts."""
    parts = F.split(F.regexp_replace(name, r"^.*/", ""), "_")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    second = part(5) + F.rpad(F.regexp_extract(F.get(parts, F.lit(6)), r"^(\d{1,6})", 1), 6, "0"
                              ).try_cast("decimal(16,6)") / MICROS
    return F.when(
        F.size(parts) >= 7,
        F.unix_micros(F.try_make_timestamp(
            part(0), part(1), part(2), part(3), part(4), second.cast("decimal(16,6)"),
            F.lit("UTC"))),
    )


def utc_parts_to_micros(
    year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column,
    nanos: Column,
) -> Column:
    """UTC calendar parts to microseconds; negative nanos count as zero."""
    whole = F.unix_micros(F.try_make_timestamp(
        year, month, day, hour, minute, second.cast("decimal(16,6)"), F.lit("UTC")))
    return whole + F.floor(F.greatest(nanos, F.lit(0)) / 1000).cast("long")


def parse_epoch(text: Column) -> Column:
    """Seconds since epoch from the stamp texts cameras and loggers write.

    Texts without a zone are UTC; a plain number is already an epoch; anything
    else is null.
    """
    group = lambda i: F.regexp_extract(text, _STAMP, i)
    number = lambda i: group(i).try_cast("int")
    fraction = F.nullif(group(8), F.lit(""))
    usable = fraction.isNull() | (group(2) == ":")
    whole = F.unix_micros(F.try_make_timestamp(
        number(1), number(3), number(4), number(5), number(6),
        group(7).try_cast("decimal(16,6)"), F.lit("UTC")))
    micros = F.coalesce(
        (fraction.try_cast("decimal(16,6)") * MICROS).cast("long"), F.lit(0).cast("long"))
    zone = F.regexp_replace(group(9), ":", "")
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    offset = F.when(zone.isin("", "Z"), 0).otherwise(
        F.when(F.substring(zone, 1, 1) == "-", -minutes).otherwise(minutes))
    stamped = (whole + micros - offset.cast("long") * 60 * MICROS) / float(MICROS)
    return F.coalesce(F.when(usable, stamped), text.try_cast("double"))


def to_micros(ts: Column) -> Column:
    """Timestamp (zoned or not, read as UTC) to microseconds since epoch."""
    return F.unix_micros(ts.cast("timestamp"))
