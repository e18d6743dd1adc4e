"""Dataset catalogue, runs and models.

A catalogue is a table with one row per file: the zone, the seven key columns,
the name and file facts.  Keys are ordinary columns, so selecting a dataset is a
filter and listing a level is a distinct.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.text import iso_date, locate_id, run_suffix, version_number
from furrow.operators.plots import q

KEYS = ["year", "experiment", "location", "population", "date", "platform", "sensor"]
METRIC = "metrics/mAP50(B)"


def _at(keys: Mapping[str, str]) -> Column:
    hit = F.lit(True)
    for k, v in keys.items():
        hit = hit & (F.col(k) == v)
    return hit


def facet(catalog: DataFrame, level: str, **keys: str) -> DataFrame:
    """Sorted values of one key level under the given keys.

    Years are digits only.  Dates come from raw and processed data; the other
    levels from raw data, unless a zone is given.
    """
    zones = [keys["zone"]] if "zone" in keys else (
        ["Raw", "Processed"] if level == "date" else ["Raw"])
    rows = catalog.where(F.col("zone").isin(*zones) & _at({k: v for k, v in keys.items() if k != "zone"}))
    if level == "year":
        rows = rows.where(F.col("year").rlike(r"^\d+$"))
    return rows.where(F.col(level).isNotNull()).select(level).distinct().orderBy(level)


def children(catalog: DataFrame, path: str, column: str = "path") -> DataFrame:
    """Names directly below a folder, and whether each is a folder itself."""
    prefix = path.strip("/") + "/" if path.strip("/") else ""
    rest = F.split(F.call_function("substring", F.col(column), F.lit(len(prefix) + 1)), "/")
    return catalog.where(F.startswith(F.col(column), F.lit(prefix))).select(
        F.get(rest, F.lit(0)).alias("name"), (F.size(rest) > 1).alias("folder")
    ).groupBy("name").agg(F.max("folder").alias("is_directory")).orderBy("name")


def tree(catalog: DataFrame, column: str = "path", depth: int | None = None) -> DataFrame:
    """Every folder, down to ``depth`` if given, with its parent and number of files below."""
    parts = F.split(F.col(column), "/")
    folders = F.size(parts) - 1
    levels = F.sequence(F.lit(1), folders if depth is None else F.least(F.lit(depth), folders))
    inside = catalog.where(F.size(parts) > 1).select(parts.alias("_p"), F.explode(levels).alias("depth"))
    path = lambda n: F.array_join(F.slice("_p", 1, n), "/")
    return inside.groupBy(
        path(F.col("depth")).alias("folder"), path(F.col("depth") - 1).alias("parent"), "depth"
    ).agg(F.count("*").alias("files"))


def rename_key(catalog: DataFrame, level: str, old: str, new: str, **keys: str) -> DataFrame:
    """Catalogue in which one key value under the given keys has a new name."""
    hit = _at({**keys, level: old})
    return catalog.withColumn(level, F.when(hit, F.lit(new)).otherwise(F.col(level)))


def delete_key(catalog: DataFrame, **keys: str) -> DataFrame:
    """Catalogue without the rows under the given keys."""
    return catalog.where(~F.coalesce(_at(keys), F.lit(False)))


def set_removed(catalog: DataFrame, names: DataFrame, removed: bool) -> DataFrame:
    """Catalogue with the named images moved to, or back from, the removed ones."""
    listed = names.select("name").distinct().withColumn("_hit", F.lit(True))
    return catalog.join(listed, "name", "left").withColumn("status", F.when(
        F.col("_hit"), F.lit("Removed" if removed else "Images")).otherwise(F.col("status"))).drop("_hit")


def versions(catalog: DataFrame, base: str, by: Sequence[str], folder: str = "folder") -> DataFrame:
    """Numbered output folders ``{base}_v{n}`` per dataset."""
    numbered = catalog.withColumn("version", version_number(F.col(folder), base))
    return numbered.where(F.col("version").isNotNull()).select(*by, folder, "version").distinct()


def next_version(catalog: DataFrame, base: str, by: Sequence[str], folder: str = "folder") -> DataFrame:
    """Number for the next output folder of each dataset; 0 for the first."""
    number = version_number(F.col(folder), base)
    return catalog.groupBy(*by).agg(F.coalesce(F.max(number) + 1, F.lit(0)).alias("next_version"))


def trait_sources(catalog: DataFrame, suffix: str = "-Traits-WGS84.geojson") -> DataFrame:
    """Trait files per dataset: ``aerial`` at sensor level, ``inference`` per version."""
    head = F.concat_ws("-", "date", "platform", "sensor")
    aerial = F.col("name") == F.concat(head, F.lit(suffix))
    versioned = F.col("name") == F.concat(head, F.lit("-"), F.col("folder"), F.lit(suffix))
    kind = F.when(aerial & (F.coalesce(F.col("folder"), F.lit("")) == ""), "aerial").when(
        versioned, "inference")
    return catalog.withColumn("version_type", kind).where(F.col("version_type").isNotNull()).select(
        *KEYS, "version_type", F.when(F.col("version_type") == "aerial", "main").otherwise(
            F.col("folder")).alias("version"), "name")


def label_classes(labels: DataFrame) -> DataFrame:
    """Distinct annotation classes in numeric order."""
    return labels.where(F.col("class").isNotNull()).select("class").distinct().orderBy(
        F.col("class").try_cast("int"), "class")


def last_metrics(metrics: DataFrame, by: Sequence[str] = ("run_id",), metric: str = METRIC) -> DataFrame:
    """Metric of the last epoch per run, 2 decimals."""
    return metrics.groupBy(*by).agg(
        F.max("epoch").alias("epoch"), F.round(F.max_by(q(metric), "epoch"), 2).alias("map"))


def best_run(runs: DataFrame, metrics: DataFrame, order: str, metric: str = METRIC) -> DataFrame:
    """Id of the run with the best last metric; the first of equals, a single one as is."""
    scored = runs.join(last_metrics(metrics, metric=metric), "run_id", "left")
    return scored.agg(F.min_by("run_id", F.struct(-F.coalesce("map", F.lit(-1.0)), F.col(order))).alias("run_id"))


def run_details(
    runs: DataFrame, args: DataFrame, metrics: DataFrame, stands: DataFrame | None = None,
    metric: str = METRIC,
) -> DataFrame:
    """One row per run: id, dates, platform, sensor, settings, last metric, plants found."""
    out = runs.select("run_id", "path", "dates").withColumn("parts", F.split("path", "/"))
    at = lambda i: F.try_element_at("parts", F.lit(i))
    out = out.select(
        "run_id", run_suffix(at(-1)).alias("id"), F.array_join("dates", ", ").alias("dates"),
        at(-3).alias("platform"), F.get(F.split(at(-2), " "), F.lit(0)).alias("sensor"))
    out = out.join(args.select("run_id", "epochs", "batch", "imgsz"), "run_id", "left").join(
        last_metrics(metrics, metric=metric).drop("epoch"), "run_id", "left")
    if stands is None:
        return out
    counts = stands.groupBy("run_id").agg(F.count("*").alias("stand_count"))
    return out.join(counts, "run_id", "left").na.fill(0, ["stand_count"])


def check_runs(files: DataFrame, path: str = "path") -> DataFrame:
    """Files that matter to a run: kind, id and date by their path."""
    p = F.col(path)
    kind = F.when(p.rlike(r"Plant Detection/Plant-[^/]+/weights/last\.pt$"), "plant_model").when(
        p.rlike(r"Locate-[^/]+/locate\.csv$"), "locate").when(
        p.rlike(r"/Labels(/|$)"), "labels").when(
        p.rlike(r"(Pod|Flower|Leaf).*/weights/best\.pt$"), "trait_model")
    run = F.regexp_extract(p, r"([^/]+)/weights/[^/]+$", 1)
    return files.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        path, "kind", F.when(F.col("kind") == "locate", locate_id(p)).when(
            F.col("kind") != "labels", run_suffix(run)).alias("id"), iso_date(p).alias("date"))


def upsert_run(registry: DataFrame, entries: DataFrame, key: str = "trait") -> DataFrame:
    """Registry in which the entries replace the runs of their key."""
    return registry.join(entries.select(key).distinct(), key, "left_anti").unionByName(entries)
