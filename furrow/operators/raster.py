"""Rasters as pixel tables: masks, traits, overviews, mosaics.

A pixel table holds ``raster_id, row, col`` and band columns.  Numbers that
describe a whole raster are aggregates, never windows over the raster, and go
back to the pixels block by block, so one huge raster spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.geo import ring_bounds, to_utm
from furrow.functions.pixels import excess_green, hsv_leaf_mask, low_gain_fix, to_byte
from furrow.operators.morphology import diamond, morph, square
from furrow.operators.spatial import box_pairs
from furrow.plans.session import cut_lineage
from furrow.plans.skew import exact_quantiles, keep_first

RASTER = "raster_id"

# side of the blocks that numbers of a raster are handed out by
BLOCK = 256

# plots whose edges a task projects
PLOTS = 5_000

# Depth below the camera that still counts as canopy, the floor, and
# the area of a pixel.
CANOPY_BELOW, FLOOR, PIXEL_AREA = -60, -170, 0.00667


def with_raster(pixels: DataFrame, per: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Pixels with the columns of ``per``, a table of one row per raster.

    The numbers are first copied to every block of the raster, so the join that
    meets the pixels has a key of at most ``BLOCK`` squared rows; pixels without a
    position are cut by their content instead.
    """
    if row in pixels.columns and col in pixels.columns:
        block = [F.floor(F.col(row) / BLOCK), F.floor(F.col(col) / BLOCK)]
    else:
        block = [F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pixels.columns]), F.lit(BLOCK))]
    names = [f"_block{i}" for i in range(len(block))]
    placed = pixels.withColumns(dict(zip(names, block)))
    handed = placed.select(RASTER, *names).distinct().join(per, RASTER)
    return placed.join(handed, [RASTER, *names]).drop(*names)


def raster_pixels(tiles: DataFrame, size: int, bands: Sequence[str]) -> DataFrame:
    """Pixels of square tiles ``raster_id, tile_row, tile_col`` with row-major band arrays."""
    zipped = F.arrays_zip(*[F.col(b) for b in bands])
    out = tiles.select(RASTER, "tile_row", "tile_col", F.posexplode(zipped).alias("_at", "_px"))
    return out.select(
        RASTER,
        (F.col("tile_row") * size + F.floor(F.col("_at") / size)).cast("int").alias("row"),
        (F.col("tile_col") * size + F.col("_at") % size).cast("int").alias("col"),
        *[F.col(f"_px.{b}").alias(b) for b in bands])


def raster_window(pixels: DataFrame, windows: DataFrame) -> DataFrame:
    """Pixels of each named window ``raster_id, window_id, col1, row1, col2, row2``."""
    px = pixels.withColumn("_x", F.col("col")).withColumn("_y", F.col("row"))
    pairs = box_pairs(px, windows, ["_x", "_y", "_x", "_y"], ["col1", "row1", "col2", "row2"], [RASTER], 64)
    return pairs.select("window_id", *pixels.columns)


def plot_windows(
    boundaries: DataFrame, rasters: DataFrame, on: Sequence[str], steps: int = 21,
) -> DataFrame:
    """Buffered pixel window of each plot's bounding box on its dataset's rasters.

    The box is projected along its edges (``steps`` points each) and grows by a
    tenth per side, at least 0.1 m.  Unknown plots, rings of fewer than four
    points and empty windows are left out.  ``rasters`` holds
    ``raster_id, epsg, geotransform`` and, like the boundaries, the dataset keys ``on``.
    """
    known = boundaries.where(
        F.col("plot").isNotNull() & F.col("accession").isNotNull() & (F.size("ring") >= 4))
    boxed = known.withColumn("_b", ring_bounds(F.col("ring")))
    share = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / float(steps - 1))
    b = F.col("_b")
    along = lambda lo, hi, t: lo + (hi - lo) * t
    edge = F.flatten(F.transform(share, lambda t: F.array(
        F.struct(along(b["x0"], b["x1"], t).alias("lon"), b["y0"].alias("lat")),
        F.struct(along(b["x0"], b["x1"], t).alias("lon"), b["y1"].alias("lat")),
        F.struct(b["x0"].alias("lon"), along(b["y0"], b["y1"], t).alias("lat")),
        F.struct(b["x1"].alias("lon"), along(b["y0"], b["y1"], t).alias("lat")))))
    met = boxed.select(*on, "plot", "accession", "_b").join(
        rasters.select(*on, RASTER, "epsg", "geotransform"), list(on))
    # the work lies in the projection, so tasks are cut by plots, however small their files are
    dealt = met.repartition(max(1, -(-met.count() // PLOTS)))
    # one row per edge point keeps the projection in generated code
    points = dealt.withColumn("_e", F.explode(edge)).drop("_b")
    metres = points.withColumn("_m", to_utm(F.col("_e.lon"), F.col("_e.lat"), F.col("epsg")))
    bounds = metres.groupBy(*on, "plot", "accession", RASTER, "geotransform").agg(
        F.min("_m.x").alias("x0"), F.max("_m.x").alias("x1"), F.min("_m.y").alias("y0"),
        F.max("_m.y").alias("y1"))
    pad = lambda lo, hi: F.greatest(F.lit(0.1), (F.col(hi) - F.col(lo)) * 0.1)
    g = lambda i: F.get("geotransform", F.lit(i))
    return bounds.where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).select(
        *on, "plot", "accession", RASTER,
        ((F.col("x0") - pad("x0", "x1") - g(0)) / g(1)).alias("col_off"),
        ((F.col("y1") + pad("y0", "y1") - g(3)) / g(5)).alias("row_off"),
        ((F.col("x1") - F.col("x0") + 2 * pad("x0", "x1")) / g(1)).alias("width"),
        ((F.col("y0") - F.col("y1") - 2 * pad("y0", "y1")) / g(5)).alias("height"),
    ).where((F.col("width") > 0) & (F.col("height") > 0))


# --- temperature


def apply_calibration(meta: DataFrame, calibration: DataFrame) -> DataFrame:
    """Camera constants PlanckR1 and PlanckO replaced where the serial is calibrated."""
    known = calibration.select(F.col("SN").alias("CameraSerialNumber"), "PR1", "PO")
    known = keep_first(known, ["CameraSerialNumber"], ["PR1", "PO"])
    return meta.join(known, "CameraSerialNumber", "left").withColumn(
        "PlanckR1", F.coalesce("PR1", "PlanckR1")).withColumn(
        "PlanckO", F.coalesce("PO", "PlanckO")).drop("PR1", "PO")


def fix_raw_thermal(pixels: DataFrame, raw: str = "raw") -> DataFrame:
    """Counts rescaled in rasters whose largest count marks them as low gain."""
    top = pixels.groupBy(RASTER).agg(F.max(raw).alias("_max"))
    return with_raster(pixels, top).withColumn(raw, low_gain_fix(F.col(raw), F.col("_max"))).drop("_max")


# --- vegetation mask


def exg(pixels: DataFrame) -> DataFrame:
    """Excess green per pixel, stretched to 0..255 per raster, as ``exg``."""
    index = excess_green(F.col("r"), F.col("g"), F.col("b"))
    ends = pixels.groupBy(RASTER).agg(F.min(index).alias("_lo"), F.max(index).alias("_hi"))
    return with_raster(pixels, ends).withColumn(
        "exg", to_byte(index, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def otsu_threshold(pixels: DataFrame, value: str = "exg", by: Sequence[str] = (RASTER,)) -> DataFrame:
    """Threshold per raster that minimises the weighted variance of both classes.

    Pixels at or above a threshold form the upper class; the first best one
    counts, and a raster of one value gets 0.  The work is on histograms of at
    most 256 values: moving the threshold between two values present changes
    nothing, so the lowest of equal thresholds is one above the value below.
    """
    hist = pixels.groupBy(*by, F.col(value).cast("long").alias("_v")).agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    v, n = F.col("_v"), F.col("_n")
    sums = hist
    for name, term in (("c", n), ("s", n * v), ("q", n * v * v)):
        sums = sums.withColumn(f"_{name}0", F.sum(term).over(below)).withColumn(
            f"_{name}", F.sum(term).over(whole))
    sums = sums.withColumn("_prev", F.max("_v").over(below))
    spread = lambda q, s, c: q - s * s / c
    up = lambda name: F.col(f"_{name}") - F.col(f"_{name}0")
    cost = (spread(F.col("_q0"), F.col("_s0"), F.col("_c0")) + spread(up("q"), up("s"), up("c"))) / F.col("_c")
    scored = sums.withColumn("_cost", F.when(F.col("_prev").isNotNull(), F.struct(cost, F.col("_prev"))))
    return scored.groupBy(*by).agg(
        F.coalesce(F.min_by(F.col("_prev") + 1, "_cost"), F.lit(0)).cast("int").alias("threshold"))


def vegetation_mask(pixels: DataFrame) -> DataFrame:
    """Excess-green pixels above the Otsu threshold, holes closed, as ``mask``.

    The index is written once: threshold, mask and closing all read it.
    """
    green = cut_lineage(exg(pixels))
    marked = with_raster(green, otsu_threshold(green)).withColumn(
        "mask", (F.col("exg") > F.col("threshold")).cast("int"))
    return morph(marked.drop("threshold"), "close", square(2))


def leaf_mask(pixels: DataFrame) -> DataFrame:
    """Leaf-coloured pixels opened by a diamond, as ``mask``."""
    marked = pixels.withColumn("mask", hsv_leaf_mask(F.col("r"), F.col("g"), F.col("b")).cast("int"))
    return morph(marked, "open", diamond(3))


# --- traits


def vegetation_fraction(pixels: DataFrame) -> DataFrame:
    """Share of masked pixels per raster."""
    return pixels.groupBy(RASTER).agg(F.round(F.avg("mask"), 4).alias("Vegetation_Fraction"))


def crop_height(pixels: DataFrame, dem: str = "dem") -> DataFrame:
    """Spread between the 5th and 95th percentile of masked, non-zero heights; 0 without any."""
    used = pixels.where((F.col("mask") != 0) & (F.col(dem) != 0))
    ends = exact_quantiles(used, dem, [RASTER], {"low": 0.05, "high": 0.95})
    return pixels.select(RASTER).distinct().join(ends, RASTER, "left").select(
        RASTER, F.coalesce(F.round(F.col("high") - F.col("low"), 4), F.lit(0.0)).alias("Height_95p_meters"))


def canopy_temp(pixels: DataFrame, celsius: str = "celsius") -> DataFrame:
    """Mean masked, non-zero temperature per raster."""
    used = F.when((F.col("mask") != 0) & (F.col(celsius) != 0), F.col(celsius))
    return pixels.groupBy(RASTER).agg(F.round(F.avg(used), 2).alias("Avg_Temp_C"))


def resample(pixels: DataFrame, onto: DataFrame, bands: Sequence[str], whole: bool = True) -> DataFrame:
    """Rows of the grid ``onto`` with the bands of another grid of the same rasters, bilinear.

    Both grids cover the same ground, ``onto`` with as many rows and columns as it
    has.  Pixel centres are matched, places beyond the outermost centres take the
    border's value, and ``whole`` rounds to integers, halves up.  Each place asks
    for its up to four neighbours: a join on their position, so only the pixels
    that count are met, and the places meet again under their own.  A band is null
    where one of these is missing; rasters without pixels are left out.
    """
    size = lambda df, name: df.groupBy(RASTER).agg(
        *[(F.max(c) + 1).alias(f"_{name}_{c}") for c in ("row", "col")])
    grids = size(pixels, "from").join(size(onto, "to"), RASTER)
    places = with_raster(onto.select(RASTER, "row", "col").distinct(), grids)
    for c in ("row", "col"):
        exact = (F.col(c) + 0.5) * (F.col(f"_from_{c}") / F.col(f"_to_{c}")) - 0.5
        low = F.floor(exact)
        edge = F.col(f"_from_{c}") - 1
        places = places.withColumn(f"_{c}", F.least(F.greatest(low, F.lit(0)), edge).cast("int")).withColumn(
            f"_f{c}", F.when((low < 0) | (low >= edge), 0.0).otherwise(exact - low))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    used = F.filter(corners, lambda k: ((k["i"] == 0) | (F.col("_frow") > 0)) & ((k["j"] == 0) | (F.col("_fcol") > 0)))
    asked = places.withColumn("_k", F.explode(used)).select(
        RASTER, F.col("row").alias("_to_row"), F.col("col").alias("_to_col"), "_frow", "_fcol", "_k",
        (F.col("_row") + F.col("_k.i")).alias("row"), (F.col("_col") + F.col("_k.j")).alias("col"))
    met = asked.join(pixels.select(RASTER, "row", "col", *bands), [RASTER, "row", "col"], "left")
    at = lambda band, i, j: F.max(F.when((F.col("_k.i") == i) & (F.col("_k.j") == j), F.col(band)))

    def blend(band: str) -> Column:
        fx, fy = F.col("_fcol"), F.col("_frow")
        row = lambda i: F.when(fx > 0, at(band, i, 0) * (1 - fx) + at(band, i, 1) * fx).otherwise(at(band, i, 0))
        value = F.when(fy > 0, row(0) * (1 - fy) + row(1) * fy).otherwise(row(0))
        return (F.floor(value + 0.5).cast("int") if whole else value).alias(band)

    return met.groupBy(RASTER, "_to_row", "_to_col", "_frow", "_fcol").agg(
        *[blend(b) for b in bands]).select(
        RASTER, F.col("_to_row").alias("row"), F.col("_to_col").alias("col"), *bands)


def on_grid(pixels: DataFrame, onto: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Pixels of ``onto`` with further bands, resampled from another grid."""
    return onto.join(resample(pixels, onto, bands), [RASTER, "row", "col"])


def drone_traits(
    pixels: DataFrame, plots: DataFrame, thermal: bool | DataFrame = False, dem: DataFrame | None = None,
) -> DataFrame:
    """Trait row per plot: centre of its box, vegetation, height and temperature.

    ``pixels`` carry r, g, b; ``plots`` carry raster_id, ring and the plot's
    properties.  ``dem`` are pixels of a grid of its own with a band ``dem``: the
    colours are brought to that grid before the mask is made, and the mask to the
    grid of ``thermal`` (band ``celsius``).  Without ``dem`` the heights stand
    with the colours, and temperatures, with ``thermal=True``, as well.  The mask
    is written once for all traits.
    """
    if dem is not None:
        pixels = on_grid(pixels, dem, ["r", "g", "b"])
    marked = cut_lineage(vegetation_mask(pixels))
    out = plots.withColumn("_b", ring_bounds(F.col("ring"))).withColumn(
        "lon", (F.col("_b.x0") + F.col("_b.x1")) / 2).withColumn(
        "lat", (F.col("_b.y0") + F.col("_b.y1")) / 2).drop("_b")
    parts = [vegetation_fraction(marked), crop_height(marked)]
    if thermal is not False:
        parts.append(canopy_temp(marked if thermal is True else on_grid(marked, thermal, ["mask"])))
    for part in parts:
        out = out.join(part, RASTER)
    return out


def box_height_area(pixels: DataFrame, boxes: DataFrame, box_id: str) -> DataFrame:
    """Canopy height and leaf area inside pixel boxes ``x1, y1, x2, y2`` (ends exclusive).

    ``pixels`` carry ``z`` and a leaf ``mask``; only depths between the canopy
    bound and the floor count.
    """
    z = F.col("z") * F.col("mask")
    used = pixels.where((z < CANOPY_BELOW) & (z - FLOOR > 0)).select(
        RASTER, F.col("col").alias("_px"), F.col("row").alias("_py"), (z - FLOOR).alias("_h"))
    ends = boxes.select(
        RASTER, box_id, F.col("x1").alias("_x1"), F.col("y1").alias("_y1"),
        (F.col("x2") - 1).alias("_x2"), (F.col("y2") - 1).alias("_y2"))
    pairs = box_pairs(used, ends, ["_px", "_py", "_px", "_py"], ["_x1", "_y1", "_x2", "_y2"], [RASTER], 64)
    sums = pairs.groupBy(RASTER, box_id).agg(
        F.avg("_h").alias("Height (cm)"), (F.count("*") * PIXEL_AREA).alias("Area (cm2)"))
    return boxes.join(sums, [RASTER, box_id], "left")


# --- overviews, resampling, mosaics


def pyramid(
    pixels: DataFrame, bands: Sequence[str], factors: Sequence[int] = (2, 4, 8, 16, 32, 64, 128, 256),
) -> DataFrame:
    """Mean of each ``factor`` x ``factor`` block of pixels, for every factor.

    Each level is summed from the one before, which is a quarter of its size;
    sums and counts travel, so partial blocks at the edges weigh what they hold.
    """
    level = pixels.select(
        RASTER, "row", "col", *[F.col(b).cast("double").alias(f"_s_{b}") for b in bands],
        *[F.col(b).isNotNull().cast("long").alias(f"_n_{b}") for b in bands])
    done, out = 1, None
    for factor in factors:
        if factor % done:
            raise ValueError("every factor must be a multiple of the one before")
        step, done = factor // done, factor
        level = level.groupBy(
            RASTER, F.floor(F.col("row") / step).cast("int").alias("row"),
            F.floor(F.col("col") / step).cast("int").alias("col"),
        ).agg(*[F.sum(f"_{k}_{b}").alias(f"_{k}_{b}") for b in bands for k in ("s", "n")])
        view = level.select(
            RASTER, F.lit(factor).alias("factor"), "row", "col",
            *[F.try_divide(f"_s_{b}", f"_n_{b}").alias(b) for b in bands])
        out = view if out is None else out.unionByName(view)
    return out


Projection = Callable[[Column, Column], Column]


def _same_plane(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def scatter(
    pixels: DataFrame, bands: Sequence[str], grid: Column, forward: Projection = _same_plane,
    inverse: Projection = _same_plane,
) -> DataFrame:
    """Bilinear samples of rasters on a common output grid.

    ``pixels`` carry their raster's affine and size as a struct ``_raster``;
    ``grid`` is a struct ``x0, y1, xres, yres, width, height``.  Every source pixel adds its weight to
    the few output cells it reaches, so the result is one aggregate: nothing is
    joined and no cell list is generated.  ``forward`` and ``inverse`` project
    between the source plane and the plane of the grid.
    """
    g = lambda n: F.col("_grid")[n]
    c = F.col
    t = lambda n: c("_raster")[n]
    world = lambda col, row: forward(t("a") * col + t("b") * row + t("c"), t("d") * col + t("e") * row + t("f"))
    x, y = c("col") + 0.5, c("row") + 0.5
    out = pixels.withColumn("_grid", grid).withColumn("_p", world(x, y)).withColumn(
        "_px", world(x + 1, y)).withColumn("_py", world(x, y + 1))
    # how far one source pixel reaches on the output grid, with some room for curvature
    reach = lambda axis, res: (F.abs(c(f"_px.{axis}") - c(f"_p.{axis}"))
                               + F.abs(c(f"_py.{axis}") - c(f"_p.{axis}"))) * 1.01 / g(res)
    at_x, at_y = (c("_p.x") - g("x0")) / g("xres"), (g("y1") - c("_p.y")) / g("yres")

    def span(at: Column, far: Column, size: str) -> Column:
        low = F.greatest(F.lit(0), F.ceil(at - far - 0.5))
        high = F.least(g(size) - 1, F.floor(at + far - 0.5))
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    out = out.withColumn("_at_x", at_x).withColumn("_at_y", at_y).withColumn(
        "_rx", reach("x", "xres")).withColumn("_ry", reach("y", "yres"))
    out = out.withColumn("out_col", span(c("_at_x"), c("_rx"), "width")).withColumn(
        "out_row", span(c("_at_y"), c("_ry"), "height"))
    back = inverse(g("x0") + (c("out_col") + 0.5) * g("xres"), g("y1") - (c("out_row") + 0.5) * g("yres"))
    out = out.withColumn("_w", back)
    det = t("a") * t("e") - t("b") * t("d")
    dx, dy = c("_w.x") - t("c"), c("_w.y") - t("f")
    out = out.withColumn("_sc", (dx * t("e") - dy * t("b")) / det).withColumn(
        "_sr", (dy * t("a") - dx * t("d")) / det)
    weight = F.greatest(F.lit(0.0), 1 - F.abs(c("_sc") - x)) * F.greatest(F.lit(0.0), 1 - F.abs(c("_sr") - y))
    weighed = out.withColumn("_weight", weight).where(
        (c("_weight") > 0) & c("_sc").between(0, t("width")) & c("_sr").between(0, t("height")))
    return weighed.groupBy(RASTER, "out_row", "out_col").agg(
        *[F.try_divide(F.sum(c("_weight") * c(b)), F.sum("_weight")).alias(b) for b in bands])


def _corners(rasters: DataFrame) -> DataFrame:
    corner = lambda col, row: F.struct(
        (F.col("a") * col + F.col("b") * row + F.col("c")).alias("x"),
        (F.col("d") * col + F.col("e") * row + F.col("f")).alias("y"))
    w, h = F.col("width"), F.col("height")
    return rasters.select("*", F.explode(F.array(
        corner(F.lit(0), F.lit(0)), corner(w, F.lit(0)), corner(w, h), corner(F.lit(0), h))).alias("_p"))


def mosaic_grid(rasters: DataFrame, max_dimension: int | None = None) -> DataFrame:
    """Common grid: union of all bounds at the finest pixel size, one row.

    With ``max_dimension``, a wider or higher grid gets coarser pixels instead.
    """
    tiny = 1e-10
    size = lambda n: F.col(f"_hi_{n}") - F.col(f"_lo_{n}")
    per = _corners(rasters).groupBy(RASTER, "a", "e", "width", "height").agg(
        F.min("_p.x").alias("_lo_x"), F.max("_p.x").alias("_hi_x"),
        F.min("_p.y").alias("_lo_y"), F.max("_p.y").alias("_hi_y"))
    pixel = F.when(
        (F.abs("a") > tiny) & (F.abs("e") > tiny), F.least(F.abs("a"), F.abs("e"))
    ).otherwise(F.least(size("x") / F.col("width"), size("y") / F.col("height")))
    whole = per.agg(
        F.min("_lo_x").alias("x0"), F.max("_hi_x").alias("x1"), F.min("_lo_y").alias("y0"),
        F.max("_hi_y").alias("y1"), F.min(pixel).alias("px"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    if max_dimension is not None:
        big = F.greatest((w / F.col("px")).cast("long"), (h / F.col("px")).cast("long")) > max_dimension
        whole = whole.withColumn("px", F.when(
            big, F.greatest(w / max_dimension, h / max_dimension, F.col("px"))).otherwise(F.col("px")))
    sized = whole.withColumn("width", (w / F.col("px")).cast("int")).withColumn(
        "height", (h / F.col("px")).cast("int"))
    return sized.select(F.struct(
        "x0", "y1", (w / F.col("width")).alias("xres"), (h / F.col("height")).alias("yres"),
        "width", "height").alias("grid"))


def _with_affine(pixels: DataFrame, rasters: DataFrame) -> DataFrame:
    terms = ("a", "b", "c", "d", "e", "f", "width", "height")
    return with_raster(pixels, rasters.select(RASTER, F.struct(*terms).alias("_raster")))


def mosaic(
    pixels: DataFrame, rasters: DataFrame, bands: Sequence[str] = ("r", "g", "b"),
    max_dimension: int | None = None, background: int = 255,
) -> DataFrame:
    """Rotated rasters merged on one grid: per band, the last non-zero value stays.

    ``rasters`` holds ``raster_id, plot_order, width, height, a..f``.  Cells that
    no raster reaches are background and are not listed.
    """
    grid = mosaic_grid(rasters, max_dimension).select("grid").scalar()
    samples = scatter(_with_affine(pixels, rasters), bands, grid)
    ordered = with_raster(samples, rasters.select(RASTER, "plot_order"), "out_row", "out_col")
    rounded = {b: F.floor(F.col(b) + 0.5).cast("int") for b in bands}
    return ordered.groupBy("out_row", "out_col").agg(*[
        F.coalesce(F.max_by(v, F.when(v != 0, F.col("plot_order"))), F.lit(background)).alias(b)
        for b, v in rounded.items()])


def reproject_raster(
    pixels: DataFrame, rasters: DataFrame, bands: Sequence[str], forward: Projection,
    inverse: Projection, resolution: float,
) -> DataFrame:
    """Rasters resampled bilinearly in another plane at a given resolution.

    All rasters share one grid that starts at the smallest x and the largest y of
    their projected corners.
    """
    ends = _corners(rasters).select(forward(F.col("_p.x"), F.col("_p.y")).alias("_q")).agg(
        F.min("_q.x").alias("x0"), F.max("_q.x").alias("x1"), F.min("_q.y").alias("y0"),
        F.max("_q.y").alias("y1"))
    cells = lambda lo, hi: F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / resolution)).cast("int")
    grid = ends.select(F.struct(
        "x0", "y1", F.lit(resolution).alias("xres"), F.lit(resolution).alias("yres"),
        cells("x0", "x1").alias("width"), cells("y0", "y1").alias("height"))).scalar()
    return scatter(_with_affine(pixels, rasters), bands, grid, forward, inverse)
