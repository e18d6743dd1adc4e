"""Text, CSV and GeoJSON files of a field trial.

Parsers take a DataFrame of lines, so they run on any source; the ``read_*``
functions put a Spark reader in front of them.  Writers produce lines and leave
the number of files to Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from furrow.functions.geo import oriented, shape_parts
from furrow.operators.detection import first_candidate
from furrow.operators.plots import q
from furrow.plans.skew import ordinal

# Fixed value: columns a full synced table has.
SYNCED_COLUMNS = 33
# Fixed value: first line of a control-point list.
CRS = "EPSG:4326"

# a comma outside double quotes
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def fields(line: Column) -> Column:
    """Number of comma-separated fields of a line."""
    return F.size(F.split(line, _COMMA, -1))


def read_synced(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Synced table from CSV; header names are trimmed, lines with extra fields skipped.

    Short lines are kept with nulls.  ``schema`` is matched to the file by
    position, as the header may carry blanks.
    """
    corrupt = "_corrupt_record"
    wide = StructType(list(schema.fields) + [StructField(corrupt, StringType())])
    rows = (spark.read.schema(wide).option("header", True).option("enforceSchema", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
            .option("columnPruning", False).csv(path))
    fine = F.col(corrupt).isNull() | (fields(F.col(corrupt)) <= len(schema.fields))
    return rows.where(fine).toDF(*[c.strip() for c in rows.columns]).drop(corrupt)


def csv_integrity(lines: DataFrame, header: str, expected: int = SYNCED_COLUMNS) -> DataFrame:
    """Columns found and expected, lines, and lines with more fields than the header."""
    columns = len(header.split(","))
    body = lines.where((F.col("value") != header) & (F.trim("value") != ""))
    return body.agg(
        F.lit(columns).alias("columns"), F.lit(columns == expected).alias("columns_ok"),
        F.count("*").alias("lines"), F.count_if(fields(F.col("value")) > columns).alias("skipped"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Training metrics with padded names and numbers, one row per epoch, run in ``run_id``."""
    rows = (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True).csv(path)
            .withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)))
    return rows.select("run_id", *[
        q(c).try_cast("int" if c.strip() == "epoch" else "double").alias(c.strip())
        for c in rows.columns if c != "run_id"])


def parse_detections(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    """Detections from CSV lines with the given columns."""
    numbers = {"confidence", "x", "y", "width", "height"}
    kind = lambda c: "double" if c in numbers else "int" if c == "plot_index" else "string"
    schema = ", ".join(f"`{c}` {kind(c)}" for c in header)
    return lines.select(F.from_csv("value", schema).alias("_r")).select("_r.*")


# columns of a result file that are not text
_KINDS = {**dict.fromkeys(("confidence", "x", "y", "width", "height"), "double"), "plot_index": "int"}
_MASKS = {"points": "array<struct<x:double,y:double>>", "segments": "array<array<double>>"}


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """Results below a folder: ``path`` and ``name``, of single files as of folders of part files."""
    whole = F.regexp_replace("path", r"/part-[^/]*$", "")
    return scan_files(spark, folder, "*.csv").select(whole.alias("path")).distinct().select(
        "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


def read_detections(spark: SparkSession, folder: str, task: str, stem: str = "_predictions") -> DataFrame:
    """Detections of the result that fits a task, with numbers and masks in their types.

    The folder's results are few, and the one name is looked at on the driver;
    the rows are read once, as the types are fixed.
    """
    chosen = first_candidate(
        result_files(spark, folder).select(F.lit("").alias("folder"), "path", "name"), stem, task).first()
    if chosen is None:
        raise FileNotFoundError(f"no detections under {folder}")
    rows = spark.read.option("header", True).option("escape", '"').csv(chosen["path"])
    typed = lambda c: (F.from_json(q(c), _MASKS[c]) if c in _MASKS
                       else q(c).try_cast(_KINDS[c]) if c in _KINDS else q(c))
    return rows.select(*[typed(c).alias(c) for c in rows.columns])


def write_detections(detections: DataFrame, path: str) -> None:
    """Detections as CSV; mask arrays become JSON text."""
    out = detections
    for c in ("points", "segments"):
        if c in out.columns and out.schema[c].dataType.typeName() == "array":
            out = out.withColumn(c, F.to_json(c))
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# --- boundaries

# Names under which boundary properties are stored.
ALIASES = {
    "Plot": ["Plot", "plot"], "Bed": ["Bed", "column"], "Tier": ["Tier", "row"],
    "Label": ["Label", "accession"],
}

# features of a written file
FEATURES = 10_000

# coordinates stay text until the geometry's type tells their depth
_FEATURE = ("struct<type:string,properties:map<string,string>,"
            "geometry:struct<type:string,coordinates:string>>")
_PART = "array<array<array<double>>>"


def _parts(geometry: Column) -> Column:
    """Rings of points by part, of a Polygon or MultiPolygon; null for others."""
    text = geometry["coordinates"]
    parts = F.when(geometry["type"] == "Polygon", F.array(F.from_json(text, _PART))).when(
        geometry["type"] == "MultiPolygon", F.from_json(text, f"array<{_PART}>"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, point)))


def _boundary(feature: Column) -> list[Column]:
    """``props``, the outer ``ring`` of a Polygon and all ``rings`` of the shape.

    Of ``rings`` the outer ones run counter-clockwise and holes clockwise,
    whichever way the file has them.
    """
    parts = _parts(feature["geometry"])
    outer = F.get(F.get(parts, F.lit(0)), F.lit(0))
    return [feature["properties"].alias("props"),
            F.when(feature["geometry"]["type"] == "Polygon", outer).alias("ring"),
            F.flatten(F.transform(parts, lambda part: F.transform(
                part, lambda ring, i: oriented(ring, i == 0)))).alias("rings")]


def parse_features(lines: DataFrame) -> DataFrame:
    """Boundaries from lines of one GeoJSON feature each: ``props``, ``ring`` and ``rings``.

    A comma behind a feature is fine, and lines that hold none, such as those
    around the features of a collection, are skipped.
    """
    f = F.from_json(F.regexp_replace("value", r",\s*$", ""), _FEATURE)
    return lines.select(f.alias("_f")).where(F.col("_f.geometry").isNotNull()).select(
        *_boundary(F.col("_f")))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Boundaries from FeatureCollection files of any layout, with their file order ``ordinal``.

    A file is one document in UTF-8 and is read by one task; ``read_feature_lines``
    splits files that have a feature per line.
    """
    # a reader of JSON files goes back to the file for every text that is an array
    text = F.ltrim(F.col("value"), F.lit("\ufeff"))
    whole = spark.read.text(path, wholetext=True).select(
        F.from_json(text, f"struct<features:array<{_FEATURE}>>").alias("_d"))
    return whole.select(F.posexplode("_d.features").alias("ordinal", "_f")).select(
        "ordinal", *_boundary(F.col("_f")))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Boundaries from collections written with one feature per line; large files are split."""
    return parse_features(spark.read.text(path))


def normalize_props(boundaries: DataFrame) -> DataFrame:
    """Plot, Bed, Tier and Label from whichever name a file uses."""
    return boundaries.select("*", *[
        F.coalesce(*[F.try_element_at("props", F.lit(n)) for n in names]).alias(out)
        for out, names in ALIASES.items()])


def feature_lines(boundaries: DataFrame) -> DataFrame:
    """One GeoJSON feature per line, from ``rings`` (Polygon or MultiPolygon) or else ``ring``."""
    rings = F.col("rings") if "rings" in boundaries.columns else F.array("ring")
    parts = F.transform(shape_parts(rings) if "rings" in boundaries.columns else F.array(rings),
                        lambda part: F.transform(part, lambda ring: F.transform(
                            ring, lambda p: F.array(p["x"], p["y"]))))
    shape = boundaries.select("props", parts.alias("_parts"))
    kind = F.when(F.size("_parts") == 1, F.concat(
        F.lit('"Polygon","coordinates":'), F.to_json(F.get("_parts", F.lit(0))))).otherwise(
        F.concat(F.lit('"MultiPolygon","coordinates":'), F.to_json("_parts")))
    return shape.select(F.concat(
        F.lit('{"type":"Feature","properties":'), F.coalesce(F.to_json("props"), F.lit("null")),
        F.lit(',"geometry":{"type":'), kind, F.lit("}}")).alias("value"))


def _framed(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    """Lines as documents of up to ``features``: a head, features with commas between, a foot."""
    lines = lambda column: pa.RecordBatch.from_arrays([column], ["value"])
    head, foot = '{"type":"FeatureCollection","features":[', "]}"
    yield lines(pa.array([head]))
    held, count = None, 0
    for batch in batches:
        column = batch.column(0).cast(pa.string())
        while len(column):
            if count == features:
                yield lines(pa.array([held, foot, head]))
                held, count = None, 0
            part = column[:features - count]
            column = column[len(part):]
            count += len(part)
            if held is not None:
                yield lines(pa.array([held + ","]))
            held = part[-1].as_py()
            yield lines(pc.binary_join_element_wise(part[:-1], ",", ""))
    yield lines(pa.array([held, foot] if held is not None else [foot]))


def write_boundaries(boundaries: DataFrame, path: str, features: int = FEATURES) -> None:
    """Boundaries as files that are a FeatureCollection each, one feature per line.

    A file holds up to ``features`` of them, as ``read_boundaries`` reads it as one
    document; that and ``read_feature_lines`` read them back.
    """
    # a document is its features, a head and a foot, and fills a file
    feature_lines(boundaries).mapInArrow(
        lambda batches: _framed(batches, features), "value string").write.mode("overwrite").option(
        "maxRecordsPerFile", features + 2).text(path)


# --- ground control points


def parse_gcp_list(lines: DataFrame) -> DataFrame:
    """Picked points from ``lon lat 0 px py image label width height`` lines."""
    part = F.split(F.trim("value"), r"\s+")
    at = lambda i, kind: F.get(part, F.lit(i)).try_cast(kind)
    return lines.where(F.size(part) >= 9).select(
        at(0, "double").alias("gcp_lon"), at(1, "double").alias("gcp_lat"), at(3, "double").alias("pointX"),
        at(4, "double").alias("pointY"), at(5, "string").alias("image"), at(6, "string").alias("gcp_label"),
        at(7, "int").alias("naturalWidth"), at(8, "int").alias("naturalHeight"))


def read_gcp_list(spark: SparkSession, path: str) -> DataFrame:
    """Picked points of control-point list files; the CRS line is skipped."""
    return parse_gcp_list(spark.read.text(path))


def gcp_lines(points: DataFrame) -> DataFrame:
    """Lines of a control-point list, without the CRS line."""
    return points.select(F.concat_ws(
        " ", *[F.col(c).cast("string") for c in ("gcp_lon", "gcp_lat")], F.lit("0"),
        *[F.col(c).cast("string") for c in ("pointX", "pointY", "image", "gcp_label", "naturalWidth",
                                            "naturalHeight")]).alias("value"))


def geo_lines(images: DataFrame) -> DataFrame:
    """``name lon lat alt 0 0 0 0 0`` of images with a position; altitude 0 when unknown."""
    name = F.regexp_extract("image_path", r"([^/]*)$", 1)
    placed = images.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()
                          & ~F.isnan("lat") & ~F.isnan("lon"))
    alt = F.coalesce(F.col("alt").cast("string"), F.lit("0"))
    return placed.select(F.concat_ws(
        " ", name, F.col("lon").cast("string"), F.col("lat").cast("string"), alt, F.lit("0 0 0 0 0")).alias("value"))


def _write_with_crs(lines: DataFrame, path: str) -> None:
    """Lines in order behind the CRS line: the part files, one after the other, are the list.

    A range sort deals the lines, so a long list is written by many tasks; a short
    one is a single file.
    """
    def headed(batches):
        if TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([CRS])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], ["value"])

    ordered = lines.repartitionByRange("value").sortWithinPartitions("value")
    ordered.mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def write_gcp_list(points: DataFrame, path: str) -> None:
    """Control-point list with its CRS line."""
    _write_with_crs(gcp_lines(points), path)


def write_geo(images: DataFrame, path: str) -> None:
    """Position list with its CRS line."""
    _write_with_crs(geo_lines(images), path)


def gcp_locations(rows: DataFrame) -> DataFrame:
    """Surveyed points with altitude, 0 where the table has none."""
    alt = F.col("Altitude").try_cast("double") if "Altitude" in rows.columns else F.lit(None).cast("double")
    number = lambda c: F.col(c).try_cast("double")
    return rows.select(
        F.col("Label").cast("string").alias("label"), number("Lat_dec").alias("lat"),
        number("Lon_dec").alias("lon"), F.coalesce(alt, F.lit(0.0)).alias("altitude"))


def read_gcp_locations(spark: SparkSession, path: str) -> DataFrame:
    """Surveyed points from ``Label,Lat_dec,Lon_dec[,Altitude]`` CSV."""
    return gcp_locations(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path))


# --- labels, logs, folders


def parse_labels(lines: DataFrame) -> DataFrame:
    """Class, the first token, of each annotation line; ``path`` names the image's file."""
    token = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0))
    return lines.where(F.trim("value") != "").select("path", token.alias("class"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Annotation classes of a folder of label files."""
    return parse_labels(spark.read.text(path, pathGlobFilter="*.txt").select(
        "value", F.col("_metadata.file_path").alias("path")))


def _headed() -> Column:
    """A log's text behind a header with its file name."""
    return F.concat(F.lit("=== "), F.regexp_extract("path", r"([^/]*)$", 1), F.lit(" ===\n"), "text")


def combined_log_rows(logs: DataFrame) -> DataFrame:
    """Logs of each group behind a header each: ``group, position, text``, position from 0 in file order.

    The form of ``combined_logs`` for groups of any size: no group is gathered.
    """
    return ordinal(logs.select("group", "path", _headed().alias("text")), ["path"], ["group"], "position").select(
        "group", "position", "text")


def write_combined_logs(logs: DataFrame, path: str) -> None:
    """Combined logs as text, a folder ``group=...`` each, whose part files in order are the view."""
    told = logs.select("group", "path", _headed().alias("text"))
    told.repartitionByRange("group", "path").sortWithinPartitions("group", "path").select(
        "group", F.col("text").alias("value")).write.mode("overwrite").partitionBy("group").text(path)


def combined_logs(logs: DataFrame) -> DataFrame:
    """One text per group of logs: a header with the file name, then its text, in file order.

    ``logs`` holds ``group, path, text``.  A group is the plots of one run, and its
    text has to fit into a row; ``combined_log_rows`` has no such bound.
    """
    entry = F.struct("path", _headed().alias("text"))
    return logs.groupBy("group").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "\n").alias("text"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Whole log files as ``group`` (the folder), ``path`` and ``text``."""
    at = F.col("_metadata.file_path")
    return spark.read.option("wholetext", True).text(path).select(
        F.regexp_extract(at, r"^(.*)/[^/]*$", 1).alias("group"), at.alias("path"), F.col("value").alias("text"))


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below a folder without their content: path, name, length, modified."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(root))
    return found.select(
        "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length",
        F.col("modificationTime").alias("modified"))


def catalog_rows(files: DataFrame, root: str) -> DataFrame:
    """Catalogue rows of listed files: zone and the seven key columns from the path.

    Dot-names and ``temp`` folders are left out.
    """
    rest = F.regexp_replace(F.col("path"), r"^(file:)?/*" + root.strip("/").replace(".", r"\.") + "/*", "")
    parts = F.split(rest, "/")
    names = ["zone", "year", "experiment", "location", "population", "date", "platform", "sensor"]
    placed = files.withColumn("_p", parts).withColumn("relative", rest)
    # a file's own name is no key
    key = lambda i: F.when(F.size("_p") - 1 > i, F.get("_p", F.lit(i)))
    return placed.where(~F.exists("_p", lambda p: p.startswith(".") | (p == "temp"))).select(
        *[key(i).alias(n) for i, n in enumerate(names)],
        F.array_join(F.slice("_p", len(names) + 1, F.greatest(F.lit(0), F.size("_p") - len(names) - 1)),
                     "/").alias("folder"),
        "name", F.col("relative").alias("path"), "length", "modified")


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue of everything below a data root."""
    return catalog_rows(scan_files(spark, root), root)
