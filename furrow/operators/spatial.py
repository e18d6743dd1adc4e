"""Joins in space: points in polygons, footprints over polygons, nearest neighbours.

Every join here is an equi-join on grid cells with an exact test behind it.  No
side is broadcast by hint: Spark broadcasts a side it measures as small, and
otherwise shuffles on the cell, where adaptive execution may split a hot cell.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow.functions.geo import (
    FLATTENING, SEMI_MAJOR, SEMI_MINOR, geodesic_m, overlap_area, point_inside, ring_bounds, ring_edges,
    rings_bounds, rings_edges, world_to_pixel)
from furrow.plans.greedy import queue_choice
from furrow.plans.nearest import Tree
from furrow.plans.session import cut_lineage
from furrow.plans.skew import keep_first

# Metres per degree of latitude at its smallest, rounded down.
METRES_PER_DEGREE = 110_500.0

# Rows of a grid cell that meet the other side's in one piece.
CROWD = 20_000

# Halvings of the widest cell among crowded positions.
FINER = 6

# Tiles of border ends: degrees of latitude they go to, width in reaches of an end, ends and spots
# of a tile that are settled in one piece, rows of a table of tiles.
POLEWARD = 89.0
HALO = 4
TILE_ENDS = 1 << 18
CROWDED_TILE = 1 << 18
TABLE_ROWS = 1 << 16


def _cell(value: Column, level: Column, base: float) -> Column:
    return F.floor(value / (F.lit(base) * F.pow(F.lit(2.0), level)))


def _shape(polys: DataFrame, ring: str) -> tuple[Column, Column]:
    """Bounds and edges of a column of rings, or of shapes of several rings each."""
    several = polys.schema[ring].dataType.elementType.typeName() == "array"
    return ((rings_bounds(F.col(ring)), rings_edges(F.col(ring))) if several else
            (ring_bounds(F.col(ring)), ring_edges(F.col(ring))))


def _levelled(polys: DataFrame, ring: str, base: float) -> DataFrame:
    """Polygons on the grid level whose cells are at least as wide as they are.

    A polygon then covers at most two cells per axis, however large it is.
    """
    bounds, edges = _shape(polys, ring)
    box = polys.withColumn("_box", bounds).withColumn("_edges", edges)
    size = F.greatest(F.col("_box.x1") - F.col("_box.x0"), F.col("_box.y1") - F.col("_box.y0"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1e-300)) / base)).cast("int"))
    return box.withColumn("_level", level)


def _gridded(levelled: DataFrame, base: float) -> DataFrame:
    span = lambda low, high: F.explode(F.sequence(
        _cell(F.col(f"_box.{low}"), F.col("_level"), base),
        _cell(F.col(f"_box.{high}"), F.col("_level"), base)))
    return levelled.withColumn("_cx", span("x0", "x1")).withColumn("_cy", span("y0", "y1"))


def _levels(levelled: DataFrame) -> Column:
    """Grid levels in use, as one small array."""
    return levelled.select(F.collect_set("_level")).scalar()


def _cell_join(many: DataFrame, cells: DataFrame, on: Sequence[str], crowd: int = CROWD) -> DataFrame:
    """Equi-join on cells, of which the crowded ones of ``many`` are dealt into slices of about ``crowd`` rows.

    A slice meets copies of its cell's rows in ``cells``.  ``cells`` is never
    broadcast: it holds copies that Spark's size estimate does not see.
    """
    counted = many.groupBy(*on).agg(F.ceil(F.count("*") / crowd).cast("int").alias("_slices")).where("_slices > 1")
    # at most one row for each ``crowd`` rows of ``many``
    crowded = F.broadcast(cut_lineage(counted))
    slices = F.coalesce("_slices", F.lit(1))
    # by the row itself, so that a task run again deals the same; maps can't be hashed
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in many.schema.fields if "map<" not in f.dataType.simpleString()])
    dealt = many.join(crowded, list(on), "left").withColumn(
        "_slice", F.pmod(row, slices).cast("int")).drop("_slices")
    copied = cells.join(crowded, list(on), "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    return dealt.join(copied.hint("merge"), [*on, "_slice"]).drop("_slice")


def pip_join(
    points: DataFrame, polys: DataFrame, x: str = "lon", y: str = "lat", ring: str = "ring",
    base: float = 1e-4,
) -> DataFrame:
    """Points with every polygon they lie strictly within.

    ``ring`` holds closed rings, or arrays of rings (outer ones counter-clockwise,
    holes clockwise): a point in a hole or on its edge is outside.
    ``base`` is the cell width of the finest grid level, in the units of the
    coordinates; about the size of the smaller polygons is best.
    """
    # the polygons are asked for their levels first, so their source is read once
    levelled = cut_lineage(_levelled(polys, ring, base).drop("_edges")).withColumn("_edges", _shape(polys, ring)[1])
    cells = _gridded(levelled, base)
    placed = points.withColumn("_level", F.explode(_levels(levelled)))
    placed = placed.withColumn("_cx", _cell(F.col(x), F.col("_level"), base)).withColumn(
        "_cy", _cell(F.col(y), F.col("_level"), base))
    near = _cell_join(placed, cells, ["_level", "_cx", "_cy"])
    inside = near.where(
        F.col(x).between(F.col("_box.x0"), F.col("_box.x1"))
        & F.col(y).between(F.col("_box.y0"), F.col("_box.y1"))
        & point_inside(F.col(x), F.col(y), F.col("_edges")))
    return inside.drop("_level", "_cx", "_cy", "_box", "_edges")


def pip_first(
    points: DataFrame, polys: DataFrame, ids: Sequence[str], ordinal: str, x: str = "lon",
    y: str = "lat", ring: str = "ring", base: float = 1e-4,
) -> DataFrame:
    """Each point with the first polygon, by ``ordinal``, that contains it; else nulls."""
    props = [c for c in polys.columns if c != ring]
    distinct = keep_first(polys, [ring], [ordinal])
    hits = pip_join(points.select(*ids, x, y), distinct, x, y, ring, base)
    first = hits.groupBy(*ids).agg(F.min_by(F.struct(*props), F.col(ordinal)).alias("_poly"))
    joined = points.join(first, list(ids), "left")
    return joined.select(*points.columns, *[F.col("_poly")[c].alias(c) for c in props])


def box_pairs(
    left: DataFrame, right: DataFrame, left_box: Sequence[str], right_box: Sequence[str],
    on: Sequence[str] = (), base: float = 1e-4,
) -> DataFrame:
    """Pairs of boxes that touch or overlap, within equal ``on`` keys.

    Boxes are (x0, y0, x1, y1) columns; the two sides share no other names.  A
    box fills at most four cells of the level that fits it, and is also placed
    on the coarser levels the other side uses; a pair is met once, on the
    coarser of its two levels, in the cell of its lower-left common corner.
    """

    def level(box: Sequence[str]) -> Column:
        x0, y0, x1, y1 = (F.col(c) for c in box)
        size = F.greatest(x1 - x0, y1 - y0, F.lit(base))
        return F.ceil(F.log2(size / base)).cast("int")

    def place(df: DataFrame, box: Sequence[str], own: str, others: Column) -> DataFrame:
        levels = F.array_union(F.array(F.col(own)), others)
        placed = df.withColumn("_level", F.explode(levels)).where(F.col("_level") >= F.col(own))
        for out, low, high in (("_cx", box[0], box[2]), ("_cy", box[1], box[3])):
            placed = placed.withColumn(out, F.explode(F.sequence(
                _cell(F.col(low), F.col("_level"), base), _cell(F.col(high), F.col("_level"), base))))
        return placed

    ls, rs = left.withColumn("_ll", level(left_box)), right.withColumn("_rl", level(right_box))
    used = lambda df, name: df.select(F.collect_set(name)).scalar()
    lp, rp = place(ls, left_box, "_ll", used(rs, "_rl")), place(rs, right_box, "_rl", used(ls, "_ll"))
    lx0, ly0, lx1, ly1 = (F.col(c) for c in left_box)
    rx0, ry0, rx1, ry1 = (F.col(c) for c in right_box)
    return _cell_join(lp, rp, [*on, "_level", "_cx", "_cy"]).where(
        (F.col("_level") == F.greatest("_ll", "_rl"))
        & (F.col("_cx") == _cell(F.greatest(lx0, rx0), F.col("_level"), base))
        & (F.col("_cy") == _cell(F.greatest(ly0, ry0), F.col("_level"), base))
        & (lx0 <= rx1) & (lx1 >= rx0) & (ly0 <= ry1) & (ly1 >= ry0)
    ).drop("_level", "_cx", "_cy", "_ll", "_rl")


def max_overlap_join(
    images: DataFrame, polys: DataFrame, ids: Sequence[str], ordinal: str,
    box: Sequence[str] = ("x0", "y0", "x1", "y1"), ring: str = "ring", base: float = 1e-4,
) -> DataFrame:
    """Each footprint box with the polygon it covers most; nulls without overlap.

    Equal areas go to the first polygon by ``ordinal``.
    """
    props = [c for c in polys.columns if c != ring]
    bounds, edges = _shape(polys, ring)
    bounded = polys.withColumn("_box", bounds).select(
        *props, edges.alias("_edges"),
        *[F.col(f"_box.{c}").alias(f"_p{c}") for c in ("x0", "y0", "x1", "y1")])
    near = box_pairs(images.select(*ids, *box), bounded, box, ["_px0", "_py0", "_px1", "_py1"], base=base)
    area = near.withColumn("overlap", overlap_area(F.col("_edges"), *[F.col(c) for c in box]))
    best = area.groupBy(*ids).agg(
        F.min_by(F.struct(*props, "overlap"), F.struct(-F.col("overlap"), F.col(ordinal))).alias("_poly")
    ).where(F.col("_poly.overlap") > 0)
    joined = images.join(best, list(ids), "left")
    return joined.select(
        *images.columns, *[F.col("_poly")[c].alias(c) for c in [*props, "overlap"]])


def _in_space(df: DataFrame, lat: str, lon: str, side: str) -> DataFrame:
    """Rows with a position, in metres from the earth's centre: ``_{side}x``, ``_{side}y``, ``_{side}z``."""
    e2 = FLATTENING * (2 - FLATTENING)
    up, along = F.radians(lat), F.radians(lon)
    bend = F.lit(SEMI_MAJOR) / F.sqrt(1 - e2 * F.sin(up) * F.sin(up))
    place = {"x": bend * F.cos(up) * F.cos(along), "y": bend * F.cos(up) * F.sin(along),
             "z": bend * (1 - e2) * F.sin(up)}
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns(
        {f"_{side}{c}": v for c, v in place.items()})


def _near_pairs(
    left: DataFrame, right: DataFrame, radius_m: float, l_lat: str, l_lon: str, r_lat: str, r_lon: str,
) -> DataFrame:
    """Pairs with their straight ``_line`` of at most ``radius_m``, a superset of those within the radius.

    Positions are taken in space, where neither the poles nor the date line are
    special: cells are cubes as wide as the radius, and right rows also lie in
    the 26 around theirs.  The straight line is never longer than the geodesic.
    """
    axes = ("x", "y", "z")
    cell = lambda c: F.floor(F.col(c) / radius_m)
    spots = _in_space(right, r_lat, r_lon, "r")
    for c in axes:
        spots = spots.withColumn(f"_c{c}", F.explode(F.sequence(cell(f"_r{c}") - 1, cell(f"_r{c}") + 1)))
    rows = _in_space(left, l_lat, l_lon, "l").withColumns({f"_c{c}": cell(f"_l{c}") for c in axes})
    gaps = [F.col(f"_l{c}") - F.col(f"_r{c}") for c in axes]
    # positions in metres carry rounding of about 1e-9
    line = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
    # Spark's size estimate does not see the copies, so it must not broadcast them
    return rows.join(spots.hint("merge"), [f"_c{c}" for c in axes]).withColumn("_line", line).where(
        F.col("_line") <= radius_m + 1e-6).drop(*[f"_{side}{c}" for side in "clr" for c in axes])


def nearest_within(
    left: DataFrame, right: DataFrame, radius_m: float, ids: Sequence[str], order: Sequence[str],
    lat: str = "lat", lon: str = "lon", prefix: str = "r_",
) -> DataFrame:
    """Left rows with their nearest right row within ``radius_m`` on the ellipsoid.

    Left rows without one are dropped.  Right rows at one position count once,
    the first by ``order``; equal distances go to the first as well.
    """
    spots = keep_first(right.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()), [lat, lon], order)
    renamed = spots.select(*[F.col(c).alias(f"{prefix}{c}") for c in spots.columns])
    pairs = _near_pairs(left.select(*ids, lat, lon), renamed, radius_m, lat, lon,
                        f"{prefix}{lat}", f"{prefix}{lon}")
    ends = [F.col(c) for c in (lat, lon, f"{prefix}{lat}", f"{prefix}{lon}")]
    # a geodesic exceeds its chord c by less than c * (c / R)**2 / 6, with R the least radius of
    # curvature, so only rows whose chord comes that close to the least can be nearest
    spare = 1 + (radius_m * SEMI_MAJOR / SEMI_MINOR**2) ** 2 / 6
    least = F.min("_line").over(Window.partitionBy(*ids))
    close = pairs.withColumn("_least", least).where(
        F.col("_line") <= F.col("_least") * spare + 1e-6).withColumn("_m", geodesic_m(*ends))
    # the distance travels with its row: a geodesic is worked out once for each pair
    best = close.groupBy(*ids).agg(F.min_by(
        F.struct(*renamed.columns, F.col("_m").alias(f"{prefix}distance")),
        F.struct("_m", *[f"{prefix}{o}" for o in order])).alias("_best")
    ).where(F.col(f"_best.{prefix}distance") <= radius_m)
    return left.join(best, list(ids)).select(*left.columns, "_best.*")


def select_gcp_images(
    images: DataFrame, gcps: DataFrame, radius_m: float, ids: Sequence[str], order: Sequence[str],
) -> DataFrame:
    """Images near a ground control point, with its position and label.

    Images without coordinates, and all images when there are no points, are
    kept with label ``N/A`` at 0/0.
    """
    near = nearest_within(images, gcps, radius_m, ids, order, prefix="_g_")
    hit = near.select(*images.columns, F.col("_g_lat").alias("gcp_lat"),
                      F.col("_g_lon").alias("gcp_lon"), F.col("_g_label").alias("gcp_label"))
    none = gcps.select(F.count("*") == 0).scalar()
    rest = images.where(none | F.col("lat").isNull() | F.col("lon").isNull()).select(
        *images.columns, F.lit(0.0).alias("gcp_lat"), F.lit(0.0).alias("gcp_lon"),
        F.lit("N/A").alias("gcp_label"))
    return hit.unionByName(rest)


def match_borders(
    borders: DataFrame, images: DataFrame, image_order: str, max_m: float = 0.25,
) -> DataFrame:
    """Plot borders with the images nearest to their start and end.

    Nearest in degrees, as positions are stored; accepted when both ends lie
    within ``max_m`` metres.  An end travels once, to the tile it lies in, and an
    image to the tiles within reach of it (``_in_tiles``).  Ends near a pole, next
    to the date line or among very crowded images are few; they are looked up on
    cells (``_on_cells``), whose copies would fill the disk if all ends had them.
    ``image_order`` becomes ``start_{}`` and ``end_{}``.
    """
    finite = lambda c: F.abs(c) < float("inf")  # neither null nor NaN
    spots = cut_lineage(keep_first(images.where(finite("lat") & finite("lon"))
                                   .select("lat", "lon", image_order), ["lat", "lon"], [image_order]))
    ends = borders.where("plot_index IS NOT NULL").select("plot_index", F.explode(F.array(*[
        F.struct(F.lit(end == "start").alias("start"), F.col(f"{end}_lat").cast("double").alias("e_lat"),
                 F.col(f"{end}_lon").cast("double").alias("e_lon")) for end in ("start", "end")])).alias("_e")
    ).select("plot_index", "_e.*").where(finite("e_lat") & finite("e_lon"))
    plain, odd = _split_ends(ends, spots, max_m)
    best = _in_tiles(plain, spots, image_order, max_m)
    if not odd.isEmpty():
        best = best.unionByName(_on_cells(odd, spots, image_order, max_m))
    close = best.where(geodesic_m(F.col("e_lat"), F.col("e_lon"), F.col("lat"), F.col("lon"), 4) <= max_m)
    pick = lambda start: F.max(F.when(F.col("start") == start, F.col(image_order)))
    both = close.groupBy("plot_index").agg(
        pick(True).alias(f"start_{image_order}"), pick(False).alias(f"end_{image_order}"))
    return borders.join(both.na.drop(), "plot_index")


def _reach(lat: Column, max_m: float) -> Column:
    """Degrees within which all positions within ``max_m`` of one at ``lat`` are stored, up to POLEWARD."""
    up = max_m / METRES_PER_DEGREE
    # a way of that length does not come nearer to the pole than this parallel
    wide = up / F.cos(F.radians(F.abs(lat) + up))
    return F.sqrt(wide * wide + up * up) * (1 + 1e-9) + 1e-12


def _tile_level(lat: Column, max_m: float) -> Column:
    return F.ceil(F.log2(_reach(lat, max_m) * HALO / (max_m / METRES_PER_DEGREE))).cast("int")


def _tile(value: Column, max_m: float) -> Column:
    return _cell(value, F.col("_level"), max_m / METRES_PER_DEGREE)


def _spot_levels(spots: DataFrame, max_m: float) -> DataFrame:
    """Spots on the levels of all ends that may reach them: mostly one, two next to where the level changes."""
    up = max_m / METRES_PER_DEGREE
    # an end up to POLEWARD reaches less than 60 times as far as ``up``
    level = lambda lat: _tile_level(F.least(F.greatest(lat, F.lit(0.0)), F.lit(POLEWARD - up)), max_m)
    lat = F.abs("lat")
    return spots.withColumn("_level", F.explode(F.sequence(level(lat - 60 * up), level(lat + 60 * up))))


def _split_ends(ends: DataFrame, spots: DataFrame, max_m: float) -> tuple[DataFrame, DataFrame]:
    """Ends with ``_level``, ``_cy``, ``_cx`` that tiles can settle, and the others.

    Others lie near a pole, so that positions next to them may be stored a long way off, or where
    a spot may be next to them a whole turn of longitude off, or in or next to a tile of over
    CROWDED_TILE spots.
    """
    up = max_m / METRES_PER_DEGREE
    lon, reach = F.col("e_lon"), _reach(F.col("e_lat"), max_m)
    low, high = (spots.select(f("lon")).scalar() for f in (F.min, F.max))
    plain = (F.abs("e_lat") <= POLEWARD - up) & (lon + 360 > high + reach) & (lon - 360 < low - reach)
    plain = F.coalesce(plain, F.lit(False))
    tiles = ["_level", "_cy", "_cx"]
    counted = _spot_levels(spots, max_m).withColumn("_cy", _tile(F.col("lat"), max_m)).withColumn(
        "_cx", _tile(F.col("lon"), max_m)).groupBy(*tiles).count().where(F.col("count") > CROWDED_TILE)
    crowded = cut_lineage(counted.drop("count"))
    placed = ends.where(plain).withColumn("_level", _tile_level(F.col("e_lat"), max_m)).withColumn(
        "_cy", _tile(F.col("e_lat"), max_m)).withColumn("_cx", _tile(lon, max_m))
    if crowded.isEmpty():
        return placed, ends.where(~plain)
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    # at most nine rows for each CROWDED_TILE spots
    crowded = F.broadcast(crowded.withColumn("_cy", around("_cy")).withColumn("_cx", around("_cx")).distinct())
    odd = ends.where(~plain).unionByName(placed.join(crowded, tiles, "left_semi").drop(*tiles))
    return placed.join(crowded, tiles, "left_anti"), odd


def _in_tiles(ends: DataFrame, spots: DataFrame, image_order: str, max_m: float) -> DataFrame:
    """Ends with the spot nearest in degrees, if it lies within their reach.

    Tiles are ``HALO`` times as wide as the reach of the ends on their level, and a
    spot also goes to those within that reach, so a tile holds every spot that an end
    in it asks for.  Many tiles share a task's table, one of over ``TILE_ENDS`` ends
    has several; whatever else is in a table is a spot like any other.
    """
    tiles = ["_level", "_cy", "_cx"]
    counted = ends.groupBy(*tiles).agg(F.ceil(F.count("*") / TILE_ENDS).cast("int").alias("_slices")).where("_slices > 1")
    # at most one row for each TILE_ENDS ends
    crowded = cut_lineage(counted)
    several = not crowded.isEmpty()
    sliced = lambda df: df.join(F.broadcast(crowded), tiles, "left") if several else df.withColumn("_slices", F.lit(1))
    slices = F.coalesce("_slices", F.lit(1))
    rows = ends.select("plot_index").count() + spots.count()
    table = F.pmod(F.xxhash64(*tiles, "_slice"), F.lit(1 + rows // TABLE_ROWS)).alias("_table")
    asked = sliced(ends).withColumn(
        "_slice", F.pmod(F.xxhash64("plot_index", "start", "e_lat", "e_lon"), slices).cast("int")).select(
        table, "plot_index", "start", "e_lat", "e_lon")
    halo = max_m / METRES_PER_DEGREE * F.pow(F.lit(2.0), F.col("_level")) / HALO
    around = lambda c: F.explode(F.sequence(_tile(F.col(c) - halo, max_m), _tile(F.col(c) + halo, max_m)))
    placed = sliced(_spot_levels(spots, max_m).withColumn("_cy", around("lat")).withColumn(
        "_cx", around("lon"))).withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).select(
        table, "lat", "lon", image_order)
    schema = StructType([*(ends.schema[c] for c in ("plot_index", "start", "e_lat", "e_lon")),
                         *(spots.schema[c] for c in ("lat", "lon", image_order))])

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest_spots(left, right, image_order, max_m)

    return asked.groupBy("_table").cogroup(placed.groupBy("_table")).applyInArrow(settle, schema)


def _nearest_spots(ends: pa.Table, spots: pa.Table, image_order: str, max_m: float) -> pa.Table:
    """Ends with their nearest spot, the first by ``image_order`` (null first) of equally near ones."""
    numbers = lambda table, name: table[name].to_numpy().astype(float)
    if not (ends.num_rows and spots.num_rows):
        spots = spots.slice(0, 0)
        ends, found = ends.slice(0, 0), np.zeros(0, int)
    else:
        first = pc.rank(spots[image_order].combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy()
        spots = spots.take(np.lexsort((numbers(spots, "lon"), numbers(spots, "lat"), first)))
        lat, lon = numbers(ends, "e_lat"), numbers(ends, "e_lon")
        up = max_m / METRES_PER_DEGREE
        reach = np.hypot(up, up / np.cos(np.radians(np.abs(lat) + up))) * (1 + 1e-9) + 1e-12
        found = Tree(numbers(spots, "lat"), numbers(spots, "lon")).nearest(lat, lon, reach * reach)
        ends, found = ends.filter(pa.array(found >= 0)), found[found >= 0]
    spots = spots.take(found)
    return pa.table({**{c: ends[c] for c in ("plot_index", "start", "e_lat", "e_lon")},
                     **{c: spots[c] for c in ("lat", "lon", image_order)}})


def _on_cells(ends: DataFrame, spots: DataFrame, image_order: str, max_m: float) -> DataFrame:
    """Ends with the spot nearest in degrees, at any latitude and among any crowd.

    Some spot near each end bounds how far the nearest one can be; that one is
    looked up on grid cells as wide as the bound, so the pairs compared don't grow
    with the density of images.
    """
    who = ["plot_index", "start", "e_lat", "e_lon"]
    degrees = (F.pow(F.col("lat") - F.col("e_lat"), F.lit(2))
               + F.pow(F.col("lon") - F.col("e_lon"), F.lit(2)))
    ends = cut_lineage(ends)
    bounds = cut_lineage(_some_near(ends, _near_any(spots, ends, max_m), max_m, who, degrees))
    # cells as wide as the bound or up to twice as wide; rounding of a degree is about 1e-14
    reach = F.sqrt("_d") * (1 + 1e-9) + 1e-12
    base = max_m / METRES_PER_DEGREE
    bounds = bounds.withColumn("_reach", reach).withColumn(
        "_level", F.greatest(F.lit(-FINER), F.ceil(F.log2(F.col("_reach") / base)).cast("int")))
    cell = lambda c: _cell(c, F.col("_level"), base)
    around = lambda c: F.explode(F.sequence(cell(F.col(c) - F.col("_reach")), cell(F.col(c) + F.col("_reach"))))
    asked = bounds.withColumn("_cy", around("e_lat")).withColumn("_cx", around("e_lon"))
    placed = spots.withColumn("_level", F.explode(_levels(bounds))).withColumn(
        "_cy", cell(F.col("lat"))).withColumn("_cx", cell(F.col("lon")))
    rank = F.struct(degrees.alias("d"), F.col(image_order).alias("o"), "lat", "lon")
    # neither side's size estimate sees its copies, so neither may be broadcast
    best = asked.join(placed.hint("merge"), ["_level", "_cy", "_cx"]).where(degrees <= F.col("_d")).groupBy(
        *who).agg(F.min(rank).alias("_best"))
    return best.select(*who, "_best.lat", "_best.lon", F.col("_best.o").alias(image_order))


def _near_any(spots: DataFrame, ends: DataFrame, max_m: float) -> DataFrame:
    """Spots that lie in or next to a cube of some end; cubes are twice as wide as ``max_m``."""
    axes = ("x", "y", "z")
    cube = lambda df, lat, lon: _in_space(df, lat, lon, "s").withColumns(
        {f"_c{c}": F.floor(F.col(f"_s{c}") / (2 * max_m)) for c in axes}).drop(*[f"_s{c}" for c in axes])
    asked = cube(ends, "e_lat", "e_lon").select(*[f"_c{c}" for c in axes]).distinct()
    for c in axes:
        asked = asked.withColumn(f"_c{c}", F.explode(F.sequence(F.col(f"_c{c}") - 1, F.col(f"_c{c}") + 1)))
    # the size estimate does not see the copies, so they must not be broadcast
    return cut_lineage(cube(spots, "lat", "lon").join(
        asked.distinct().hint("merge"), [f"_c{c}" for c in axes], "left_semi").select(*spots.columns))


def _some_near(
    ends: DataFrame, spots: DataFrame, max_m: float, who: Sequence[str], degrees: Column,
) -> DataFrame:
    """``who`` and ``_d``, the least of ``degrees`` to some spots near it; all ends within ``max_m`` of a spot are told.

    One spot stands for each cube, on levels from ``max_m`` wide down to as many
    halvings as ``FINER``; an end asks the cubes it lies in.  Where its widest
    cube is empty, it looks around among spots a quarter as far apart.
    """
    axes = ("x", "y", "z")
    width = F.lit(max_m) / F.pow(F.lit(2.0), F.col("_k"))
    placed = lambda df, lat, lon: _in_space(df, lat, lon, "s").withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.lit(FINER)))).withColumns(
        {f"_c{c}": F.floor(F.col(f"_s{c}") / width) for c in axes}).drop(*[f"_s{c}" for c in axes])
    cube = ["_k", *[f"_c{c}" for c in axes]]
    stand = cut_lineage(placed(spots, "lat", "lon").groupBy(*cube).agg(
        F.min(F.struct("lat", "lon")).alias("_p")).select(*cube, "_p.*"))
    inside = cut_lineage(placed(ends, "e_lat", "e_lon").join(stand.hint("merge"), cube).groupBy(*who).agg(
        F.min(degrees).alias("_d")))
    # the diagonal of a quarter cube is shorter than half a cube
    rest = ends.where(F.col("e_lat").isNotNull() & F.col("e_lon").isNotNull()).join(inside, list(who), "left_anti")
    around = _near_pairs(rest, stand.where("_k = 2").select("lat", "lon"), 1.5 * max_m,
                         "e_lat", "e_lon", "lat", "lon").groupBy(*who).agg(F.min(degrees).alias("_d"))
    return inside.unionByName(around)


def associate_plots(
    centers: DataFrame, boundaries: DataFrame, seen: str = "seen", ordinal: str = "ordinal",
    base: float = 1e-4,
) -> DataFrame:
    """One boundary per plot and one plot per boundary key ``{plot}_{accession}``.

    Plots choose in the order they were first seen (``seen``, then plot_index);
    each takes the first boundary by ``ordinal`` that contains its centre and
    whose key is still free.  Boundaries of one shape are met once, and plots in
    the same shapes share a list of their boundaries (``plans.greedy``), so
    plots and boundaries on top of each other are not listed as pairs.
    """
    number = lambda df, name: cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))
    key = F.concat_ws("_", F.coalesce(F.col("plot").cast("string"), F.lit("None")),
                      F.coalesce(F.col("accession").cast("string"), F.lit("None")))
    named = cut_lineage(boundaries.select("plot", "accession", ordinal, "ring").withColumn("boundary_key", key))
    shapes = number(named.select("ring").distinct(), "_shape")
    keys = number(named.select("boundary_key").distinct(), "what")
    spots = centers.groupBy("plot_index", "lon", "lat").agg(F.min(seen).alias(seen))
    inside = pip_join(spots, shapes, base=base).groupBy("plot_index", seen).agg(
        F.sort_array(F.collect_set("_shape")).alias("_shapes"))
    inside = cut_lineage(inside)
    plots = number(inside.select("plot_index").distinct(), "who")
    zones = number(inside.select("_shapes").distinct(), "zone")
    turns = cut_lineage(inside.join(plots, "plot_index").join(zones, "_shapes").drop("_shapes"))
    first = lambda df, by: df.groupBy(by, "boundary_key", "what").agg(F.min_by(
        F.struct("plot", "accession", ordinal), ordinal).alias("b")).select(by, "boundary_key", "what", "b.*")
    of_shape = first(named.join(shapes, "ring").join(keys, "boundary_key"), "_shape")
    lists = cut_lineage(first(zones.select("zone", F.explode("_shapes").alias("_shape")).join(
        of_shape, "_shape"), "zone"))
    taken = queue_choice(turns, lists, [seen, "plot_index"], [ordinal, "boundary_key"])
    return taken.join(plots, "who").join(lists, ["zone", "what"]).select(
        "plot_index", "boundary_key", "plot", "accession")


def nearest_pixel(
    places: DataFrame, pixels: DataFrame, rasters: DataFrame, x: str = "x", y: str = "y",
) -> DataFrame:
    """Places with the pixel whose centre coordinate lies nearest.

    The pixel index follows from the inverse geotransform, clamped to the
    raster, so the pixel table is met by an equi-join.  ``rasters`` holds
    ``raster_id, geotransform, width, height``.
    """
    at = world_to_pixel(F.col(x), F.col(y), F.col("geotransform"))
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(F.floor(v + 0.5).cast("int"), F.col(n) - 1))
    located = places.join(rasters, "raster_id").withColumn("_at", at).withColumn(
        "col", clamp(F.col("_at.col"), "width")).withColumn("row", clamp(F.col("_at.row"), "height"))
    return located.drop("_at", *[c for c in rasters.columns if c != "raster_id"]).join(
        pixels, ["raster_id", "row", "col"])
