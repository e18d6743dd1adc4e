"""Names, labels, paths and free text."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fix codes of the flight controller and their names.
GPS_STATUS = {
    0: "No GPS",
    1: "No Fix",
    2: "2D Fix",
    3: "3D Fix",
    4: "DGPS",
    5: "RTK Float",
    6: "RTK Fixed",
}

# Accession texts that mean "not labelled".
EMPTY_ACCESSIONS = ["Unknown", "", "NaN", "nan"]


def dms_to_decimal(text: Column) -> Column:
    """``38 deg 32' 1.5" N`` to signed decimal degrees."""
    part = lambda i: F.try_element_at(F.split(F.trim(text), r"\s+"), F.lit(i))
    number = lambda c: F.regexp_replace(c, "['\"]", "").try_cast("double")
    value = number(part(1)) + number(part(3)) / 60.0 + number(part(4)) / 3600.0
    return F.when(part(-1).isin("S", "W"), -value).otherwise(value)


def to_dms(value: Column, negative: str, positive: str) -> Column:
    """Decimal degrees to (deg, min, sec, ref); the reference is '' at zero."""
    size = F.abs(value)
    degrees = F.floor(size)
    minutes_full = (size - degrees) * 60
    minutes = F.floor(minutes_full)
    ref = F.when(value < 0, negative).when(value > 0, positive).otherwise("")
    return F.struct(
        degrees.cast("int").alias("deg"),
        minutes.cast("int").alias("min"),
        F.round((minutes_full - minutes) * 60, 5).alias("sec"),
        ref.alias("ref"),
    )


def extract_float(text: Column) -> Column:
    """First number in dirty text: a signed decimal or an unsigned integer."""
    return F.regexp_extract(text, r"([-+]?\d*\.\d+|\d+)", 1).try_cast("double")


def gps_status(code: Column) -> Column:
    """Name of a GPS fix code."""
    names = F.create_map(*[F.lit(v) for pair in GPS_STATUS.items() for v in pair])
    unknown = F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")"))
    return F.coalesce(F.try_element_at(names, code.cast("int")), unknown)


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs compare as numbers and text ignores case.

    A number becomes its digit count followed by its digits, so string order is
    number order for runs of any length.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)

    def encode(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(
            run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        ).otherwise(F.lower(run))

    lead = F.when(text.rlike(r"^\d"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(lead, F.transform(runs, encode))


def norm_label(label: Column) -> Column:
    """Trimmed plot label without a trailing ``.0``."""
    return F.regexp_replace(F.trim(label.cast("string")), r"\.0$", "")


def is_labeled(accession: Column) -> Column:
    """True where an accession is a real name."""
    text = accession.cast("string")
    return F.coalesce(~text.isin(*EMPTY_ACCESSIONS) & (F.trim(text) != ""), F.lit(False))


def plot_label(plot: Column, accession: Column) -> Column:
    """``Plot_{plot|Unknown}[_Acc_{accession}]``."""
    head = F.concat(F.lit("Plot_"), F.coalesce(plot.cast("string"), F.lit("Unknown")))
    tail = F.coalesce(F.concat(F.lit("_Acc_"), accession.cast("string")), F.lit(""))
    return F.concat(head, tail)


def export_name(plot: Column, accession: Column, plot_index: Column) -> Column:
    """File stem of an exported plot; empty text counts as missing."""
    p, a = plot.cast("string"), accession.cast("string")
    has_plot = p.isNotNull() & (p != "")
    return (
        F.when(has_plot & a.isNotNull() & (a != ""),
               F.concat(F.lit("plot_"), p, F.lit("_accession_"), a))
        .when(has_plot, F.concat(F.lit("plot_"), p))
        .otherwise(F.concat(F.lit("plot_"), plot_index.cast("string")))
    )


# on Arrow text, so a batch of long texts never stands as Python objects
@F.arrow_udf(StringType())
def _decompose(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, "NFKD")


def clean_path(path: Column) -> Column:
    """Printable-ASCII form of a path: compatibility-decomposed, then stripped."""
    return F.trim(F.regexp_replace(_decompose(path), r"[^\x20-\x7e]", ""))


def run_suffix(name: Column) -> Column:
    """Id after the last dash of a run folder, null when there is none."""
    return F.nullif(F.regexp_extract(name, r"-([A-Za-z0-9]+)$", 1), F.lit(""))


def locate_id(path: Column) -> Column:
    """Id of a locate run from its result path."""
    return F.nullif(F.regexp_extract(path, r"Locate-([^/]+)/locate\.csv", 1), F.lit(""))


def iso_date(path: Column) -> Column:
    """First ``YYYY-MM-DD`` in a path."""
    return F.nullif(F.regexp_extract(path, r"\d{4}-\d{2}-\d{2}", 0), F.lit(""))


def plot_number(path: Column) -> Column:
    """Plot index from an exported plot or a stitched plot file name."""
    exported = F.regexp_extract(path, r"plot_(\d+)_accession_", 1).try_cast("int")
    stitched = F.regexp_extract(path, r"temp_plot_(\d+)", 1).try_cast("int")
    return F.coalesce(exported, stitched)


def version_number(name: Column, base: str) -> Column:
    """``n`` of a ``{base}_v{n}`` folder name, null for other names."""
    return F.regexp_extract(name, rf"^\Q{base}\E_v(\d+)", 1).try_cast("int")


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def basename(path: Column) -> Column:
    """Last part of a slash-separated path."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def mask_count(mask_json: Column) -> Column:
    """1 where the text is a non-empty JSON array, else 0."""
    return F.when(F.json_array_length(mask_json) > 0, 1).otherwise(0)
