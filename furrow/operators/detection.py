"""Detections: tiling, lifting, suppression, counts."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, StringType, StructField, StructType)

from furrow.functions.boxes import (
    box_to_utm, class_name, file_stamp, lift_points, lift_segments, tile_offsets)
from furrow.functions.text import mask_count, norm_label
from furrow.operators.plots import labeled_plots, q
from furrow.operators.spatial import box_pairs
from furrow.operators.suppression import nms
from furrow.plans.skew import keep_first, ordinal

log = logging.getLogger(__name__)


def tile_grid(images: DataFrame, size: int = 640, overlap: int = 32) -> DataFrame:
    """One row per tile of each image (``width``, ``height`` columns).

    Tiles go row by row; the last of each row and column is flush with the edge.
    A tile of a smaller image has the image's size and is padded when read.
    """
    xs, ys = tile_offsets(F.col("width"), size, overlap), tile_offsets(F.col("height"), size, overlap)
    rows = images.select("*", F.size(xs).alias("_nx"), F.posexplode(ys).alias("_iy", "y_offset"))
    tiles = rows.select("*", F.posexplode(xs).alias("_ix", "x_offset"))
    side = lambda offset, length: F.least(F.lit(size), F.col(length) - F.col(offset)).cast("int")
    return tiles.select(
        *images.columns,
        (F.col("_iy") * F.col("_nx") + F.col("_ix")).alias("crop_id"), "x_offset", "y_offset",
        side("x_offset", "width").alias("tile_width"), side("y_offset", "height").alias("tile_height"))


def lift_boxes(df: DataFrame) -> DataFrame:
    """Tile detections in plot pixels; mask points and segments move along."""
    out = df.withColumn("x", F.col("x") + F.col("x_offset")).withColumn(
        "y", F.col("y") + F.col("y_offset"))
    if "points" in df.columns:
        out = out.withColumn("points", lift_points(F.col("points"), F.col("x_offset"), F.col("y_offset")))
    if "segments" in df.columns:
        out = out.withColumn(
            "segments", lift_segments(F.col("segments"), F.col("x_offset"), F.col("y_offset")))
    return out


# --- inference

PREDICTION = StructType([
    StructField("class", StringType()), StructField("confidence", DoubleType()),
    StructField("x", DoubleType()), StructField("y", DoubleType()),
    StructField("width", DoubleType()), StructField("height", DoubleType()),
    StructField("points", ArrayType(StructType([
        StructField("x", DoubleType()), StructField("y", DoubleType())]))),
    StructField("segments", ArrayType(ArrayType(DoubleType()))),
    StructField("model_id", StringType()), StructField("model_version", StringType()),
    StructField("error", StringType()),
])

Detector = Callable[[pd.DataFrame], list[list[dict]]]


def detect(
    tiles: DataFrame, make_detector: Callable[[], Detector], keys: Sequence[str],
    confidence: float = 0.5, model_id: str | None = None, masks: bool = True,
) -> DataFrame:
    """Run a user-supplied detector over Arrow batches of tiles.

    ``make_detector`` is called once per task and returns a function from a
    batch to one list of predictions per row.  A prediction names class,
    confidence and centre box, and may carry a mask in tile pixels as ``points``
    (dicts of x and y) or else ``segments`` (pairs), and the ``model_version``
    that made it; ``model_id`` goes on every row.  A failing batch is retried row
    by row; a row that still fails comes back with ``error`` set.
    """
    schema = StructType([tiles.schema[k] for k in keys] + PREDICTION.fields)
    names = [f.name for f in schema.fields]
    fields = [f.name for f in PREDICTION.fields if f.name != "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make_detector()

        def attempt(rows: pd.DataFrame) -> list:
            try:
                return detector(rows)
            except Exception as failure:  # noqa: BLE001 - the model is user code
                if len(rows) > 1:
                    return [r for i in range(len(rows)) for r in attempt(rows.iloc[[i]])]
                log.warning("detector failed: %s", failure)
                return [f"{type(failure).__name__}: {failure}"]

        def told(prediction: dict) -> dict:
            row = dict.fromkeys(fields) | {k: v for k, v in prediction.items() if k in fields}
            points = row["points"] if masks else None
            segments = None if points or not masks else row["segments"]
            version = row["model_version"]
            return row | {
                "points": points or None, "segments": [list(map(float, s)) for s in segments] if segments else None,
                "model_id": model_id or row["model_id"], "model_version": None if version is None else str(version)}

        for batch in batches:
            out = []
            for key, found in zip(batch[list(keys)].itertuples(index=False, name=None), attempt(batch)):
                if isinstance(found, str):
                    out.append((*key, *[None] * len(fields), found))
                    continue
                out += [(*key, *[told(p)[f] for f in fields], None)
                        for p in found if p.get("confidence", 0) >= confidence]
            yield pd.DataFrame(out, columns=names)

    return tiles.mapInPandas(run, schema)


# --- non-maximum suppression


def nms_xywh(df: DataFrame, by: Sequence[str], ids: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Suppression of centre-form detections by ``confidence``."""
    half_w, half_h = F.col("width") / 2, F.col("height") / 2
    box = (F.col("x") - half_w, F.col("y") - half_h, F.col("x") + half_w, F.col("y") + half_h)
    return nms(df, by, box, "confidence", ids, threshold)


def nms_batches(
    df: DataFrame, order: Sequence[str], ids: Sequence[str], batch_rows: int | None = None,
    threshold: float = 0.7, offset: float = 1.0,
) -> DataFrame:
    """Suppression of UTM boxes ``x1, y1, x2, y2`` by ``score`` with widened extents.

    With ``batch_rows``, boxes only compete inside consecutive batches of that
    many rows in ``order``; otherwise all of them compete.
    """
    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    if batch_rows is None:
        return nms(df, [], box, "score", ids, threshold, offset)
    batched = ordinal(df, order, name="_k").withColumn("_batch", F.floor(F.col("_k") / batch_rows))
    return nms(batched, ["_batch"], box, "score", ids, threshold, offset).select(*df.columns)


# --- plant boxes


def clean_detections(df: DataFrame) -> DataFrame:
    """Named, stamped detector rows without weeds."""
    return df.withColumn("label", class_name(F.col("labels"))).where(F.col("label") != "weed").withColumn(
        "timestamp", file_stamp(F.col("filename")))


def boxes_to_utm(detections: DataFrame, clouds: DataFrame) -> DataFrame:
    """Pixel boxes in UTM metres by the bounds of each frame's point cloud.

    ``clouds`` are cloud pixels ``timestamp, row, col, x, y`` in centimetres.
    """
    bounds = clouds.groupBy("timestamp").agg(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"),
        F.max("y").alias("ymax"), (F.max("col") + 1).alias("nx"), (F.max("row") + 1).alias("ny"))
    corners = box_to_utm(F.col("bbox"), *[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax", "nx", "ny")])
    return detections.join(bounds, "timestamp").withColumn("_b", corners).where(
        F.col("_b").isNotNull()).select(
        F.col("timestamp").alias("Timestamp"), F.col("_b.e1").alias("x1"), F.col("_b.n1").alias("y1"),
        F.col("_b.e2").alias("x2"), F.col("_b.n2").alias("y2"), "score")


def count_in_regions(
    boxes: DataFrame, regions: DataFrame, image: str, region: str, base: float = 64,
) -> DataFrame:
    """Number of boxes that touch each region; a box may count in several.

    Both sides hold ``x1, y1, x2, y2``; regions without boxes count 0.
    """
    corners = ("x1", "y1", "x2", "y2")
    pairs = box_pairs(
        boxes.select(image, *[F.col(c).alias(f"_b{c}") for c in corners]),
        regions.select(image, region, *[F.col(c).alias(f"_r{c}") for c in corners]),
        [f"_b{c}" for c in corners], [f"_r{c}" for c in corners], [image], base)
    counts = pairs.groupBy(image, region).agg(F.count("*").alias("count"))
    return regions.join(counts, [image, region], "left").na.fill(0, ["count"])


# --- counts


def _matched(detections: DataFrame, plots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled plots (all when none is) and their detections, both with ``_label``."""
    known = labeled_plots(plots).withColumn("_label", norm_label(F.col("plot")))
    usable = detections.where(
        F.col("plot_label").isNotNull() & F.col("accession").isNotNull()).withColumn(
        "_label", norm_label(F.col("plot_label")))
    matched = usable.join(known.select("_label").distinct(), "_label", "left_semi")
    return known, matched


def trait_counts(
    detections: DataFrame, plots: DataFrame, model_id: str | None = None,
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """Detections per plot and class, one ``{model_id}/{class}`` column each.

    Counts go to the labelled plots (all plots when none is labelled), matched
    on the normalised plot label; plots without detections count 0.  Without a
    model id the columns carry the class name alone.  Without ``classes`` Spark's
    pivot lists them first, up to its own limit; ``trait_count_maps`` has none.
    """
    known, matched = _matched(detections, plots)
    pivot = matched.groupBy("_label").pivot("class", list(classes) if classes else None).agg(F.count(F.lit(1)))
    names = [c for c in pivot.columns if c != "_label"]
    head = f"{model_id}/" if model_id else ""
    counts = pivot.select("_label", *[q(c).alias(f"{head}{c}") for c in names])
    joined = known.join(counts, "_label", "left").na.fill(0, [f"{head}{c}" for c in names])
    return joined.drop("_label")


def trait_count_maps(
    detections: DataFrame, plots: DataFrame, model_id: str | None = None,
) -> DataFrame:
    """Detections per plot as a map from ``{model_id}/{class}`` to their number.

    The form of ``trait_counts`` for any number of classes: nothing is listed on
    the driver.  A plot without detections has an empty map; the map of a plot
    holds the classes seen there.
    """
    known, matched = _matched(detections, plots)
    head = f"{model_id}/" if model_id else ""
    per = matched.groupBy("_label", F.concat(F.lit(head), F.col("class")).alias("_class")).agg(
        F.count(F.lit(1)).alias("_n")).where("_class IS NOT NULL")
    maps = per.groupBy("_label").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("_class", "_n")))).alias("counts"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return known.join(maps, "_label", "left").withColumn("counts", F.coalesce("counts", none)).drop("_label")


def label_summary(detections: DataFrame) -> DataFrame:
    """Detections per class."""
    return detections.groupBy("class").agg(F.count("*").alias("count"))


def plot_overlay(detections: DataFrame, image: str) -> tuple[DataFrame, DataFrame]:
    """Detections of one image and their number per class."""
    rows = detections.where(F.col("image_file") == image)
    return rows, label_summary(rows)


def run_catalog(detections: DataFrame, order: str, file: str = "file") -> DataFrame:
    """One row per result file: size, classes, model, masks; newest first.

    ``order`` is the row order within a file; model id and version come from its
    first row.  Classes are counted before they are gathered into a map.
    """
    masks = [c for c in ("points", "segments") if c in detections.columns][:1]
    has_mask = F.max(F.col(masks[0]).isNotNull()) if masks else F.lit(False)
    counted = detections.groupBy(file, "modified", "class").agg(
        F.count("*").alias("_n"),
        F.min(F.struct(order, "model_id", "model_version")).alias("_first"),
        has_mask.alias("_has"),
        (F.sum(mask_count(F.col(masks[0]))) if masks else F.lit(0)).alias("_masks"))
    entry = F.when(F.col("class").isNotNull(), F.struct("class", "_n"))
    runs = counted.groupBy(file, "modified").agg(
        F.sum("_n").alias("total_predictions"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("classes_detected"),
        F.min("_first").alias("_first"),
        F.max("_has").alias("has_segmentation"), F.sum("_masks").alias("mask_count"))
    return runs.select(
        file, "modified", "total_predictions", "classes_detected",
        F.col("_first.model_id").alias("model_id"), F.col("_first.model_version").alias("model_version"),
        "has_segmentation", "mask_count").orderBy(F.desc("modified"), file)


def first_candidate(files: DataFrame, stem: str, task: str) -> DataFrame:
    """Result file for a task: its own file, else the generic one, else any.

    ``files`` holds folder and name; one row per folder comes back.
    """
    wanted = f"_{task}.csv" if task == "segmentation" else "_detection.csv"
    name = F.col("name")
    ours = files.where(name.contains(stem) & name.endswith(".csv"))
    rank = F.when(name.endswith(f"{stem}{wanted}"), 0).when(name.endswith(f"{stem}.csv"), 1).when(
        name.endswith(wanted), 2).otherwise(3)
    return keep_first(ours, ["folder"], [rank, name])
