"""Plots along a drive: queries, marking, shifting, lookups, traits tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.text import basename, export_name, is_labeled, plot_label, stem
from furrow.operators.spatial import pip_join
from furrow.plans.session import cut_lineage
from furrow.plans.skew import keep_first, ordinal

NO_PLOT = -1


def q(name: str) -> Column:
    """Column whose name may hold slashes or dots."""
    return F.col(f"`{name}`")


# --- images and plots


def middle_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row number ``n // 2`` of each group in ``order``.

    Positions come from a range sort, so a hot group is not sorted in one task.
    """
    placed = ordinal(df, order, by, "_k")
    middles = placed.groupBy(*by).agg(F.floor((F.max("_k") + 1) / 2).alias("_k"))
    return placed.join(middles, [*by, "_k"]).select(*df.columns)


def image_query(
    images: DataFrame, areas: DataFrame, middle_by: Sequence[str] | None = None, base: float = 1e-4,
) -> DataFrame:
    """Images inside plots as ``image_name, label, plot``, sorted by label.

    With ``middle_by``, only the middle image of each plot in that order.
    """
    inside = pip_join(images, areas, base=base)
    if middle_by is not None:
        # written once: sorting by range reads its input twice
        inside = middle_per_group(cut_lineage(inside.drop("ring")), ["plot"], middle_by)
    return inside.select("image_name", "label", "plot").orderBy("label")


def first_per_plot(
    synced: DataFrame, order: str, cols: Sequence[str], above: int = NO_PLOT,
) -> DataFrame:
    """First non-null value of each column per marked plot, in row order."""
    marked = synced.where(F.col("plot_index") > above)
    return marked.groupBy("plot_index").agg(
        *[F.min_by(q(c), F.when(q(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def plot_data(synced: DataFrame, borders: DataFrame, image: str, order: str) -> DataFrame:
    """First image per marked plot with the plot's name and accession.

    ``has_plot_metadata`` tells whether the borders carry names at all.
    """
    first = first_per_plot(synced, order, [image])
    named = {"Plot", "Accession"} <= set(borders.columns)
    out = first.withColumnRenamed(image, "image_name").withColumn("has_plot_metadata", F.lit(named))
    if not named:
        return out
    known = keep_first(borders.select("plot_index", "Plot", "Accession"), ["plot_index"], ["Plot", "Accession"])
    return out.join(known, "plot_index", "left")


def max_plot_index(synced: DataFrame) -> DataFrame:
    """Largest plot index, -1 without one."""
    return synced.agg(F.coalesce(F.max("plot_index"), F.lit(NO_PLOT)).alias("max_plot_index"))


def plots(synced: DataFrame, above: int = 0) -> DataFrame:
    """Distinct plot indices above a bound (-1 and 0 both occur as "no plot")."""
    return synced.where(F.col("plot_index") > above).select("plot_index").distinct()


def plot_centers(synced: DataFrame, above: int = 0) -> DataFrame:
    """Mean position per plot."""
    return synced.where(F.col("plot_index") > above).groupBy("plot_index").agg(
        F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"))


def association_summary(synced: DataFrame, borders: DataFrame) -> DataFrame:
    """Label and centre of each associated plot, with the number of plots driven."""
    named = borders.where((F.col("plot_index") > 0)
                          & (F.col("Plot").isNotNull() | F.col("Accession").isNotNull()))
    total = plots(synced).select(F.count("*")).scalar()
    return named.join(plot_centers(synced), "plot_index").select(
        "plot_index", plot_label(F.col("Plot"), F.col("Accession")).alias("plot_label"),
        "center_lat", "center_lon", total.alias("total_plots"))


def with_plot_labels(df: DataFrame, borders: DataFrame) -> DataFrame:
    """Left join to the borders of real plots for ``plot_label`` and ``accession``."""
    known = borders.where(F.col("plot_index") > 0).select(
        "plot_index", F.col("Plot").alias("plot_label"), F.col("Accession").alias("accession"))
    known = keep_first(known, ["plot_index"], ["plot_label", "accession"])
    return df.join(known, "plot_index", "left")


def export_names(borders: DataFrame) -> DataFrame:
    """Export file stem per plot."""
    return borders.withColumn(
        "export_name", export_name(F.col("Plot"), F.col("Accession"), F.col("plot_index")))


def labeled_plots(df: DataFrame, accession: str = "accession") -> DataFrame:
    """Plots with a real accession; all of them when there is none."""
    labeled = is_labeled(F.col(accession))
    none = df.select(F.coalesce(F.count_if(labeled), F.lit(0)) == 0).scalar()
    return df.where(labeled | none)


def find_images(synced: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the synced table that hold an image name in any ``*_file`` column."""
    files = [c for c in synced.columns if c.endswith("_file")]
    keep = [c for c in synced.columns if c not in files]
    long = synced.select(*[q(c) for c in keep], F.explode(F.array(*[
        F.struct(F.lit(c).alias("camera_column"), q(c).alias("image_name")) for c in files])).alias("_f"))
    return long.select(*[q(c) for c in keep], "_f.*").join(
        names.select("image_name").distinct(), "image_name")


def labeled_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images whose stem has a label file."""
    stems = labels.select(stem(F.col("path")).alias("_stem")).distinct()
    return images.withColumn("_stem", stem(F.col("path"))).join(stems, "_stem", "left_semi").drop("_stem")


def gcp_pairs(gcp_list: DataFrame, images: DataFrame) -> DataFrame:
    """Picked control points with the logged position of the same image."""
    logged = images.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        basename(F.col("image_path")).alias("image"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return gcp_list.join(logged, "image")


def union_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first``, then the rows of ``second`` with a key it lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


# --- rows in drive order


def context_rows(df: DataFrame, row: str, match: Column, reach: int = 2) -> DataFrame:
    """Rows within ``reach`` positions of a matching row, in row order."""
    wanted = df.where(match).select(
        F.explode(F.sequence(F.col(row) - reach, F.col(row) + reach)).alias(row)).distinct()
    return df.join(wanted, row, "left_semi").orderBy(row)


def row_slice(df: DataFrame, row: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` (exclusive) by position."""
    return df.where((F.col(row) >= start) & (F.col(row) < stop)).orderBy(row)


def decimate(df: DataFrame, order: Sequence[str], step: int = 3) -> DataFrame:
    """Every ``step``-th row in order, the first included."""
    return ordinal(df, order, name="_k").where(F.col("_k") % step == 0).drop("_k")


def number_plants(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Drop incomplete rows and number the rest from 1 by Bed, Tier, then ``order``."""
    return ordinal(df.na.drop(), ["Bed", "Tier", *order], name="Plant ID").withColumn(
        "Plant ID", F.col("`Plant ID`") + 1)


def split_ordered(pairs: DataFrame, order: Sequence[str], test_size: float = 0.2) -> DataFrame:
    """First ``1 - test_size`` of the pairs in order are ``train``, the rest ``val``."""
    cut = pairs.select((F.count("*") * F.lit(1 - test_size)).cast("long")).scalar()
    return ordinal(pairs, order, name="_k").withColumn(
        "split", F.when(F.col("_k") < cut, "train").otherwise("val")).drop("_k")


def sort_files(df: DataFrame, name: str, stamp_pattern: str | None = None) -> DataFrame:
    """Files by name, or by the number a pattern finds in the name."""
    if stamp_pattern is None:
        return df.orderBy(name)
    return df.orderBy(F.regexp_extract(name, stamp_pattern, 0).try_cast("decimal(38,0)"), name)


# --- marking


def mark_plot(
    synced: DataFrame, borders: DataFrame, plot_index: int, start_image: str, end_image: str,
    row: str, image: str = "/top/rgb_file", direction: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Give the rows from one image to another a plot index.

    Rows that held the index before are cleared.  A border row is added when the
    index is new.  Returns the synced table and the borders.
    """
    at = lambda name: synced.where(q(image) == name).select(F.min(row)).scalar()
    inside = F.col(row).between(at(start_image), at(end_image))
    cleared = F.col("plot_index") == plot_index
    marked = synced.withColumn(
        "stitch_direction", F.when(inside, F.lit(direction).cast("string")).when(
            cleared, F.lit(None).cast("string")).otherwise(F.col("stitch_direction"))
    ).withColumn("plot_index", F.when(inside, F.lit(plot_index)).when(
        cleared, F.lit(NO_PLOT)).otherwise(F.col("plot_index")))
    first = lambda name, c: synced.where(q(image) == name).select(F.min_by(c, row)).scalar()
    border = synced.sparkSession.range(1).select(
        F.lit(plot_index).alias("plot_index"),
        first(start_image, "lat").alias("start_lat"), first(start_image, "lon").alias("start_lon"),
        first(end_image, "lat").alias("end_lat"), first(end_image, "lon").alias("end_lon"),
        F.lit(direction).cast("string").alias("stitch_direction"))
    new = border.join(borders.select("plot_index"), "plot_index", "left_anti")
    return marked, borders.unionByName(new, allowMissingColumns=True)


def delete_plot(synced: DataFrame, plot_index: int) -> DataFrame:
    """Clear index and direction of a plot's rows."""
    hit = F.col("plot_index") == plot_index
    return synced.withColumn(
        "stitch_direction", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("stitch_direction"))
    ).withColumn("plot_index", F.when(hit, F.lit(NO_PLOT)).otherwise(F.col("plot_index")))


def shift_plots(synced: DataFrame, row: str, after: int, amount: int) -> DataFrame:
    """Move every plot after ``after`` by ``amount`` rows towards the start.

    A plot that would leave the table loses those rows.  Moved rows overwrite
    what they land on; a plot keeps the direction of its first row.
    """
    moving = synced.where(F.col("plot_index") > after)
    directions = moving.groupBy("plot_index").agg(
        F.min_by(F.struct("stitch_direction"), F.col(row)).alias("_first"))
    rows = synced.select(F.count("*")).scalar()
    moved = moving.select((F.col(row) - amount).alias(row), F.col("plot_index")).where(
        (F.col(row) >= 0) & (F.col(row) < rows)).join(directions, "plot_index").select(
        row, F.col("plot_index").alias("_new"), F.col("_first.stitch_direction").alias("_dir"))
    cleared = F.col("plot_index") > after
    landed = F.col("_new").isNotNull()
    return synced.join(moved, row, "left").withColumn(
        "stitch_direction", F.when(landed, F.col("_dir")).when(
            cleared, F.lit(None).cast("string")).otherwise(F.col("stitch_direction"))
    ).withColumn("plot_index", F.when(landed, F.col("_new")).when(
        cleared, F.lit(NO_PLOT)).otherwise(F.col("plot_index"))).drop("_new", "_dir")


# --- GPS shift: the position before the first shift stays in two extra columns


def shift_gps(synced: DataFrame, ref_lat: float, ref_lon: float, lat: float, lon: float) -> DataFrame:
    """Move all positions by reference minus current."""
    kept = "original_lat" in synced.columns
    return synced.withColumn("original_lat", F.col("original_lat") if kept else F.col("lat")).withColumn(
        "original_lon", F.col("original_lon") if kept else F.col("lon")).withColumn(
        "lat", F.col("lat") + F.lit(ref_lat - lat)).withColumn("lon", F.col("lon") + F.lit(ref_lon - lon))


def undo_shift(synced: DataFrame) -> DataFrame:
    """Positions as they were before the first shift."""
    if "original_lat" not in synced.columns:
        return synced
    return synced.withColumn("lat", F.col("original_lat")).withColumn(
        "lon", F.col("original_lon")).drop("original_lat", "original_lon")


def shift_status(synced: DataFrame) -> DataFrame:
    """Whether a shift is in place, and by how much."""
    if "original_lat" not in synced.columns:
        return synced.agg(F.lit(False).alias("shifted"), F.lit(0.0).alias("lat_shift"),
                          F.lit(0.0).alias("lon_shift"))
    return synced.agg(
        F.lit(True).alias("shifted"),
        F.avg(F.col("lat") - F.col("original_lat")).alias("lat_shift"),
        F.avg(F.col("lon") - F.col("original_lon")).alias("lon_shift"))


# --- bands between plants


def partition_bands(centers: DataFrame, image: str = "image") -> DataFrame:
    """Horizontal bands between neighbouring plants in each half of an image.

    ``centers`` holds ``image, cx, cy, width, height``.  Separators lie midway
    between neighbouring centres and at both borders; a plant on the middle
    column belongs to neither half.  Equal centres give bands of no height, as
    many as there are copies; copies are counted before the window, which then
    sees at most one row per pixel row.
    """
    half = (F.col("width") / 2).cast("int")
    x, y = F.col("cx").cast("int"), F.col("cy").cast("int")
    sided = centers.withColumn("side", F.when(x < half, 1).when(x > half, 2)).where(
        F.col("side").isNotNull())
    counted = sided.groupBy(image, "side", "width", "height", y.alias("y")).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy(image, "side").orderBy("y")
    gaps = counted.withColumn("_next", F.lead("y").over(ordered))
    keys = [image, "side", "width", "height"]
    mid = ((F.col("_next") - F.col("y")) / 2 + F.col("y")).cast("int")
    lines = gaps.select(*keys, F.explode(F.array(
        F.struct(F.col("y").alias("line"), (F.col("n") - 1).alias("n")),
        F.struct(F.when(F.col("_next").isNotNull(), mid).alias("line"), F.lit(1).cast("long").alias("n")),
    )).alias("_l")).select(*keys, "_l.*").where(F.col("line").isNotNull() & (F.col("n") > 0))
    ends = counted.select(*keys).distinct().select(*keys, F.explode(F.array(
        F.lit(0), F.col("height").cast("int"))).alias("line"), F.lit(1).cast("long").alias("n"))
    merged = lines.unionByName(ends).groupBy(*keys, "line").agg(F.sum("n").alias("n"))
    spans = merged.withColumn("_from", F.lag("line").over(
        Window.partitionBy(image, "side").orderBy("line")))
    bands = spans.select(*keys, F.explode(F.concat(
        F.when(F.col("_from").isNotNull(), F.array(F.struct(
            F.col("_from").alias("y1"), F.col("line").alias("y2")))).otherwise(F.expr(
                "cast(array() as array<struct<y1:int,y2:int>>)")),
        F.array_repeat(F.struct(F.col("line").alias("y1"), F.col("line").alias("y2")),
                       (F.col("n") - 1).cast("int")))).alias("_b"))
    left = F.when(F.col("side") == 1, 0).otherwise(half)
    right = F.when(F.col("side") == 1, half).otherwise(F.col("width").cast("int"))
    return bands.select(image, "side", left.alias("x1"), F.col("_b.y1").alias("y1"),
                        right.alias("x2"), F.col("_b.y2").alias("y2"))


# --- trait tables


def attach_traits(boundaries: DataFrame, traits: DataFrame, how: str = "inner") -> DataFrame:
    """Boundaries with traits by (Bed, Tier); missing text is "None", missing numbers 0."""
    joined = boundaries.join(traits, ["Bed", "Tier"], how)
    return joined.na.fill("None").na.fill(0)


def merge_traits_outer(existing: DataFrame, traits: DataFrame) -> DataFrame:
    """Outer merge on the columns the two tables share."""
    shared = [c for c in existing.columns if c in traits.columns]
    return existing.join(traits, shared, "full")


# Columns that lead a trait table.
STATS_COLUMNS = ["column", "row", "location", "population", "accession", "plot"]


def is_detection(name: str) -> bool:
    return "/" in name or "Total_Detections" in name


def order_traits(traits: DataFrame) -> DataFrame:
    """Stats columns, then detection counts, then the rest; rows by ``column``."""
    dropped = [c for c in traits.columns if c not in ("Plot", "plot_label", "Plot_norm")]
    stats = [c for c in STATS_COLUMNS if c in dropped]
    counts = [c for c in dropped if is_detection(c) and c not in stats]
    rest = [c for c in dropped if c not in stats + counts]
    out = traits.select(*[q(c) for c in stats + counts + rest])
    return out.orderBy("column") if "column" in stats else out


def merge_detections(existing: DataFrame, traits: DataFrame) -> DataFrame:
    """Add or refresh the detection counts of plots the existing table holds."""
    counts = [c for c in traits.columns if "/" in c or "Total_Detections_" in c]
    new = traits.select("plot", *[q(c).alias(f"_new{i}") for i, c in enumerate(counts)],
                        F.lit(True).alias("_hit"))
    new = keep_first(new, ["plot"], [f"_new{i}" for i in range(len(counts))] or [F.lit(0)])
    joined = existing.join(new, "plot", "left")
    out = [q(c) for c in existing.columns if c not in counts]
    for i, c in enumerate(counts):
        old = q(c) if c in existing.columns else F.lit(None)
        out.append(F.when(F.col("_hit"), F.col(f"_new{i}")).otherwise(old).alias(c))
    return joined.select(*out)


def upsert_gcp(existing: DataFrame, points: DataFrame) -> DataFrame:
    """Picked points by image name: new ones replace old ones, null pixels delete."""
    fields = [c for c in existing.columns if c != "image"]
    new = points.select("image", F.struct(*fields).alias("_new"))
    merged = existing.select("image", F.struct(*fields).alias("_old")).join(new, "image", "full")
    row = F.coalesce("_new", "_old")
    return merged.select("image", row.alias("_row")).where(
        F.col("_row.pointX").isNotNull() & F.col("_row.pointY").isNotNull()).select(
        "image", "_row.*").select(*existing.columns)


def dedupe_images(images: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """First row per image path, and how many rows went."""
    kept = keep_first(images, ["image_path"], order)
    removed = images.agg((F.count("*") - F.count_distinct("image_path")).alias("removed"))
    return kept, removed


def size_consistency(images: DataFrame) -> DataFrame:
    """Number of image sizes per folder, and whether there is just one."""
    sizes = images.groupBy("folder").agg(
        F.count_distinct("naturalWidth", "naturalHeight").alias("sizes"))
    return sizes.withColumn("consistent", F.col("sizes") <= 1)
