"""Detection boxes: overlap, tiling, lifting, projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]

# Class codes of the plant detector.
PLANT_CLASSES = {0: "plant", 1: "weed"}

# The usable rows of a stereo frame, its last row and column, and the
# column shift between the two cameras.
FIRST_ROW, LAST_ROW = 512, 1536
FRAME_LAST_COL, FRAME_LAST_ROW = 2591, 2047
CAMERA_SHIFT = 90


def corners(x: Column, y: Column, width: Column, height: Column) -> Box:
    """Centre form to (x1, y1, x2, y2)."""
    return x - width / 2, y - height / 2, x + width / 2, y + height / 2


def iou_xywh(a: Box, b: Box) -> Column:
    """Overlap ratio of two centre-form boxes; 0 when disjoint or both empty."""
    ax1, ay1, ax2, ay2 = corners(*a)
    bx1, by1, bx2, by2 = corners(*b)
    w = F.least(ax2, bx2) - F.greatest(ax1, bx1)
    h = F.least(ay2, by2) - F.greatest(ay1, by1)
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return F.when((w <= 0) | (h <= 0) | (union == 0), 0.0).otherwise(w * h / union)


def iou_corners(a: Box, b: Box, offset: float = 1.0) -> Column:
    """Overlap ratio of two corner-form boxes whose extents grow by ``offset``."""
    area = lambda c: (c[2] - c[0] + offset) * (c[3] - c[1] + offset)
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + offset)
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + offset)
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def box_hits_region(box: Box, region: Box) -> Column:
    """True where two corner-form boxes touch or overlap."""
    return ((box[0] <= region[2]) & (box[2] >= region[0])
            & (box[1] <= region[3]) & (box[3] >= region[1]))


def tile_offsets(length: Column, size: int, overlap: int) -> Column:
    """Tile starts along one axis: regular steps, the last flush with the edge."""
    room = length - size
    steps = F.sequence(F.lit(0), F.greatest(room, F.lit(0)).cast("int"), F.lit(size - overlap))
    last = F.element_at(steps, -1)
    return F.when(last < room, F.concat(steps, F.array(room.cast("int")))).otherwise(steps)


def lift_points(points: Column, dx: Column, dy: Column) -> Column:
    """Shift an array of ``struct<x, y>`` mask points."""
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def lift_segments(segments: Column, dx: Column, dy: Column) -> Column:
    """Shift an array of ``[x, y]`` mask segments."""
    return F.transform(segments, lambda s: F.array(
        F.get(s, F.lit(0)) + dx, F.get(s, F.lit(1)) + dy))


def class_name(code: Column) -> Column:
    """Class name of a detector code."""
    names = F.create_map(*[F.lit(v) for pair in PLANT_CLASSES.items() for v in pair])
    return F.try_element_at(names, code.cast("int"))


def file_stamp(name: Column) -> Column:
    """Stamp of a ``name-<stamp>.jpg`` file."""
    return F.regexp_extract(name, r"^[^-]*-(\d+)\.[^.]{3}$", 1).try_cast("long")


def box_to_utm(
    bbox: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column, nx: Column, ny: Column
) -> Column:
    """Pixel box ``[x, y, w, h]`` to ``struct<e1, n1, e2, n2>`` metres.

    The frame is a regular grid between its outermost points (given in
    centimetres).  Null where the box leaves the usable rows.  An index left of
    the frame counts from its right edge.
    """
    px = lambda i: F.get(bbox, F.lit(i)).cast("int")
    east = lambda i: (xmin + F.pmod(i, nx) * (xmax - xmin) / (nx - 1)) / 100
    north = lambda j: (ymax - F.pmod(j, ny) * (ymax - ymin) / (ny - 1)) / 100
    left, bottom = px(0) - CAMERA_SHIFT, px(1) + px(3)
    right = F.least(left + px(2), F.lit(FRAME_LAST_COL), nx - 1)
    low = F.least(bottom, F.lit(FRAME_LAST_ROW), ny - 1)
    return F.when(
        (px(1) >= FIRST_ROW) & (bottom <= LAST_ROW),
        F.struct(east(left).alias("e1"), north(px(1)).alias("n1"),
                 east(right).alias("e2"), north(low).alias("n2")))
