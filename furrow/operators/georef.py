"""Track geometry per plot: heading, extents, length, and the image affine.

Everything about a track is an aggregate per plot.  The numbers that depend on
row order come from the first and last row by stamp and, for the path length,
from the previous position carried along the track.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.geo import rotated_affine, to_utm, utm_epsg
from furrow.plans.skew import carry, keep_first, same

# Fixed values of the georeferencing.
ANGLE_LIMIT_DEG = 30.0
LENGTH_TOLERANCE = 0.3
MIN_CROSS_TRACK_M = 1.0
SIGMAS = 5


def to_plane(tracks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positions in the UTM zone of each plot's centre, as ``x``, ``y``, ``epsg``."""
    middle = tracks.groupBy(*by).agg(
        ((F.min("lat") + F.max("lat")) / 2).alias("_lat"),
        ((F.min("lon") + F.max("lon")) / 2).alias("_lon"))
    zones = middle.select(*[F.col(k).alias(f"_z_{k}") for k in by],
                          utm_epsg(F.col("_lon"), F.col("_lat")).alias("epsg"))
    on = same([F.col(k) for k in by], [F.col(f"_z_{k}") for k in by])
    placed = tracks.join(zones, on).drop(*[f"_z_{k}" for k in by])
    return placed.withColumn("_p", to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))).select(
        *placed.columns, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def heading_pca(tracks: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Main axis of each track, pointing from its first towards its last row."""
    return track_heading(tracks, by, order).select(*by, "pca_theta")


def _shape(tracks: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    point = F.struct("x", "y")
    return tracks.groupBy(*by).agg(
        F.count("*").alias("points"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.min_by(point, order).alias("_first"), F.max_by(point, order).alias("_last"),
        F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_vxy"))


def track_heading(tracks: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Heading ``theta`` of each track: its main axis, unless that is far off.

    The axis is compared with the line from first to last row as an axis, modulo
    half a turn; beyond the limit the line itself is used.  The heading is
    turned so that the last row lies ahead of the first.
    """
    shape = _shape(tracks, by, order)
    dx = F.col("_last.x") - F.col("_first.x")
    dy = F.col("_last.y") - F.col("_first.y")
    axis = 0.5 * F.atan2(2 * F.col("_vxy"), F.col("_vx") - F.col("_vy"))
    ahead = lambda a: F.when(F.cos(a) * dx + F.sin(a) * dy < 0, a + math.pi).otherwise(a)
    shaped = shape.withColumn("_dx", dx).withColumn("_dy", dy).withColumn(
        "pca_theta", ahead(axis)).withColumn("simple_theta", F.atan2(dy, dx))
    off = F.pmod(F.degrees(F.col("pca_theta") - F.col("simple_theta")), F.lit(180.0))
    off = F.least(off, 180.0 - off)
    theta = F.when(off > ANGLE_LIMIT_DEG, F.col("simple_theta")).otherwise(F.col("pca_theta"))
    return shaped.withColumn("angle_off", off).withColumn("theta", theta)


def axis_extents(
    tracks: DataFrame, headings: DataFrame, by: Sequence[str], buffer: float = 0.0,
) -> DataFrame:
    """Extents along (u) and across (v) the heading, around the track's centroid."""
    keyed = headings.select(*[F.col(k).alias(f"_h_{k}") for k in by], "theta", "cx", "cy")
    on = same([F.col(k) for k in by], [F.col(f"_h_{k}") for k in by])
    x, y = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    cos, sin = F.cos("theta"), F.sin("theta")
    projected = tracks.join(keyed, on).select(
        *by, (x * cos + y * sin).alias("u"), (y * cos - x * sin).alias("v"))
    ends = projected.groupBy(*by).agg(
        F.min("u").alias("u_min"), F.max("u").alias("u_max"), F.min("v").alias("v_min"),
        F.max("v").alias("v_max"), F.stddev_pop("v").alias("v_std"))
    u_pad = (F.col("u_max") - F.col("u_min")) * buffer * 0.5
    v_pad = (F.col("v_max") - F.col("v_min")) * buffer * 0.5
    return ends.select(
        *by, (F.col("u_min") - u_pad).alias("u_min"), (F.col("u_max") + u_pad).alias("u_max"),
        (F.col("v_min") - v_pad).alias("v_min"), (F.col("v_max") + v_pad).alias("v_max"), "v_std")


def track_length(tracks: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Direct and path length, and mean and deviation of the point spacing.

    Rows at one stamp count once.
    """
    points = keep_first(tracks.select(*by, order, "x", "y"), [*by, order], ["x", "y"])
    points = points.withColumn("_here", F.struct("x", "y"))
    stepped = carry(points, by, order, {"_prev": "_here"})
    step = F.sqrt(F.pow(F.col("x") - F.col("_prev.x"), F.lit(2))
                  + F.pow(F.col("y") - F.col("_prev.y"), F.lit(2)))
    sums = stepped.withColumn("_step", step).groupBy(*by).agg(
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"), F.avg("_step").alias("mean_spacing"),
        F.stddev_pop("_step").alias("std_spacing"),
        F.min_by("_here", order).alias("_a"), F.max_by("_here", order).alias("_b"))
    direct = F.sqrt(F.pow(F.col("_b.x") - F.col("_a.x"), F.lit(2))
                    + F.pow(F.col("_b.y") - F.col("_a.y"), F.lit(2)))
    return sums.select(*by, direct.alias("direct"), "path", "mean_spacing", "std_spacing")


def corrected_length(
    width: Column, direct: Column, path: Column, prefer: str = "direct",
    tolerance: float = LENGTH_TOLERANCE,
) -> Column:
    """Along-track length: the direct one when the extent disagrees or it is preferred.

    ``prefer="path"`` takes the path length where that is closer to the extent,
    ``prefer="pca"`` keeps an extent that agrees.
    """
    off = (width > direct * (1 + tolerance)) | (width < direct * (1 - tolerance))
    if prefer == "direct":
        return direct
    if prefer == "path":
        return F.when(off, direct).when(
            F.abs(path - width) < F.abs(direct - width), path).otherwise(width)
    return F.when(off, direct).otherwise(width)


def cross_track(
    v_min: Column, v_max: Column, strategy: str = "fixed", *, v_std: Column | None = None,
    gsd: Column | None = None, img_w: Column | None = None, img_h: Column | None = None,
    direction: Column | None = None, px_along: Column | None = None,
    fixed_min: float = MIN_CROSS_TRACK_M, sigmas: float = SIGMAS,
) -> Column:
    """Height across the track by strategy, as ``struct<height, v_min, v_max>``.

    ``intrinsics`` and ``hybrid`` need the ground sample distance, ``std`` the
    deviation, ``ratio`` the pixel size along the track.  A height beyond the
    track's own is centred on it.
    """
    own = v_max - v_min
    if strategy == "intrinsics" and gsd is not None:
        need = gsd * img_h
    elif strategy == "hybrid" and gsd is not None:
        side = F.when(F.upper(direction).isin("UP", "DOWN"), img_w).otherwise(img_h)
        need = F.greatest(own, gsd * F.coalesce(side, img_h))
    elif strategy == "std":
        need = F.greatest(own, sigmas * v_std)
    elif strategy == "ratio":
        need = F.greatest(own, px_along * (img_h / img_w))
    elif strategy == "fixed":
        need = F.greatest(own, F.lit(fixed_min))
    else:
        need = own
    middle, wider = (v_min + v_max) / 2, need > own
    return F.struct(
        F.greatest(need, own).alias("height"),
        F.when(wider, middle - need / 2).otherwise(v_min).alias("v_min"),
        F.when(wider, middle + need / 2).otherwise(v_max).alias("v_max"))


def rover_direction(dlat: Column, dlon: Column) -> Column:
    """NORTH, SOUTH, EAST or WEST by the larger change."""
    return F.when(F.abs(dlat) > F.abs(dlon), F.when(dlat > 0, "NORTH").otherwise("SOUTH")).otherwise(
        F.when(dlon > 0, "EAST").otherwise("WEST"))


def stitch_direction(dx: Column, dy: Column) -> Column:
    """RIGHT, LEFT, UP or DOWN by the larger move."""
    return F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "RIGHT").otherwise("LEFT")).otherwise(
        F.when(dy > 0, "UP").otherwise("DOWN"))


def track_direction(tracks: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Driving and stitching direction from the first to the last row."""
    point = F.struct("lat", "lon", "x", "y")
    ends = tracks.groupBy(*by).agg(F.min_by(point, order).alias("a"), F.max_by(point, order).alias("b"))
    d = lambda c: F.col(f"b.{c}") - F.col(f"a.{c}")
    return ends.select(*by, rover_direction(d("lat"), d("lon")).alias("rover_direction"),
                       stitch_direction(d("x"), d("y")).alias("stitch_direction"))


def georeference_plots(
    tracks: DataFrame, images: DataFrame, by: Sequence[str], order: str,
    strategy: str = "fixed", prefer: str = "direct", offset_x: float = 0.0, offset_y: float = 0.0,
) -> DataFrame:
    """Affine of each plot's stitched image from its GPS track.

    ``tracks`` holds lat, lon and the order column, ``images`` the pixel size
    ``width``, ``height`` (and ``gsd`` for the intrinsics strategies).
    """
    plane = to_plane(tracks.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), by)
    plane = plane.withColumn("x", F.col("x") + offset_x).withColumn("y", F.col("y") + offset_y)
    headings = track_heading(plane, by, order)
    spans = axis_extents(plane, headings, by)
    lengths = track_length(plane, by, order)
    turns = track_direction(plane, by, order)
    zone = plane.groupBy(*by).agg(F.first("epsg").alias("epsg"))
    per_plot = headings.select(*by, "theta", "cx", "cy")
    for part in (spans, lengths, turns, zone, images):
        per_plot = per_plot.join(part, list(by))
    span = F.col("u_max") - F.col("u_min")
    per_plot = per_plot.withColumn("width_m", corrected_length(span, F.col("direct"), F.col("path"), prefer))
    middle = (F.col("u_min") + F.col("u_max")) / 2
    per_plot = per_plot.withColumn("_u", middle - F.col("width_m") / 2).withColumn(
        "px", F.col("width_m") / F.col("width"))
    gsd = F.col("gsd") if "gsd" in images.columns else None
    per_plot = per_plot.withColumn("_v", cross_track(
        F.col("v_min"), F.col("v_max"), strategy, v_std=F.col("v_std"), gsd=gsd,
        img_w=F.col("width"), img_h=F.col("height"), direction=F.col("stitch_direction"),
        px_along=F.col("px")))
    per_plot = per_plot.withColumn("height_m", F.col("_v.height")).withColumn(
        "py", F.col("height_m") / F.col("height"))
    affine = rotated_affine(F.col("_u"), F.col("_v.v_max"), F.col("theta"), F.col("px"), F.col("py"),
                            F.col("cx"), F.col("cy"))
    return per_plot.withColumn("_t", affine).select(
        *by, "epsg", "theta", "width_m", "height_m", "px", "py", "rover_direction",
        "stitch_direction", "_t.*")


# --- affine fit of picked control points

# Share of the covariance determinant below which the points count as collinear.
SINGULAR = 1e-12


def fit_affine(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares affine from (x, y) to (tx, ty) per key.

    One aggregate: the linear part follows from covariances, the shift from the
    means.  ``kind`` is ``affine``; ``shift`` for collinear points, which only
    move by the mean offset; ``none`` with fewer than three pairs, which stay.
    """
    v = {f"{a}{b}": F.covar_pop(a, b).alias(f"_{a}{b}") for a, b in (
        ("x", "y"), ("x", "tx"), ("x", "ty"), ("y", "tx"), ("y", "ty"))}
    sums = pairs.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"),
        F.avg("tx").alias("_mtx"), F.avg("ty").alias("_mty"),
        F.var_pop("x").alias("_xx"), F.var_pop("y").alias("_yy"), *v.values())
    c = F.col
    det = c("_xx") * c("_yy") - c("_xy") * c("_xy")
    kind = F.when(c("pairs") < 3, "none").when(
        det <= SINGULAR * c("_xx") * c("_yy"), "shift").otherwise("affine")
    part = lambda value, identity: F.when(c("kind") == "affine", value).otherwise(F.lit(identity))
    out = sums.withColumn("kind", kind).withColumn("_det", det)
    out = (
        out.withColumn("a", part((c("_xtx") * c("_yy") - c("_ytx") * c("_xy")) / c("_det"), 1.0))
        .withColumn("b", part((c("_ytx") * c("_xx") - c("_xtx") * c("_xy")) / c("_det"), 0.0))
        .withColumn("d", part((c("_xty") * c("_yy") - c("_yty") * c("_xy")) / c("_det"), 0.0))
        .withColumn("e", part((c("_yty") * c("_xx") - c("_xty") * c("_xy")) / c("_det"), 1.0))
    )
    shift = lambda t, p, q: F.when(c("kind") == "none", 0.0).otherwise(
        c(t) - c(p) * c("_mx") - c(q) * c("_my"))
    return out.withColumn("c", shift("_mtx", "a", "b")).withColumn("f", shift("_mty", "d", "e")).select(
        *by, "pairs", "kind", "a", "b", "c", "d", "e", "f")


def apply_affine(
    df: DataFrame, fit: DataFrame, by: Sequence[str] = (), x: str = "lon", y: str = "lat",
) -> DataFrame:
    """Move positions by the fit of their key; rows without position or fit stay."""
    terms = ("a", "b", "c", "d", "e", "f")
    if by:
        keyed = fit.select(*[F.col(k).alias(f"_f_{k}") for k in by], F.struct(*terms).alias("_fit"))
        on = same([F.col(k) for k in by], [F.col(f"_f_{k}") for k in by])
        moved = df.join(keyed, on, "left").drop(*[f"_f_{k}" for k in by])
    else:
        moved = df.withColumn("_fit", fit.select(F.struct(*terms)).scalar())
    t = lambda n: F.col("_fit")[n]
    new_x = t("a") * F.col(x) + t("b") * F.col(y) + t("c")
    new_y = t("d") * F.col(x) + t("e") * F.col(y) + t("f")
    return moved.withColumn("_x", F.coalesce(new_x, F.col(x))).withColumn(
        "_y", F.coalesce(new_y, F.col(y))).withColumn(x, F.col("_x")).withColumn(
        y, F.col("_y")).select(*df.columns)
