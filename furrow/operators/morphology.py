"""Closing and opening of masks, tile by tile with halos."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RASTER = "raster_id"
TILE = 256


class Element(list):
    """Offsets (row, column) of a structuring element, with its shape and radius."""

    def __init__(self, shape: str, radius: int) -> None:
        span = range(-radius, radius + 1)
        super().__init__((i, j) for i in span for j in span
                         if shape == "square" or abs(i) + abs(j) <= radius)
        self.shape, self.radius = shape, radius


def square(radius: int) -> Element:
    return Element("square", radius)


def diamond(radius: int) -> Element:
    return Element("diamond", radius)


class Boxes:
    """Bounding boxes of several tiles' pixels, row by row and end to end in one array."""

    def __init__(self, tile: np.ndarray, row: np.ndarray, col: np.ndarray) -> None:
        starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        number = np.cumsum(np.append(True, tile[1:] != tile[:-1])) - 1
        low_row, low_col = np.minimum.reduceat(row, starts), np.minimum.reduceat(col, starts)
        height = np.maximum.reduceat(row, starts) - low_row + 1
        width = np.maximum.reduceat(col, starts) - low_col + 1
        first = np.cumsum(height * width) - height * width
        self.at = first[number] + (row - low_row[number]) * width[number] + col - low_col[number]
        box = np.repeat(np.arange(len(starts)), height * width)
        inside = np.arange(len(box)) - first[box]
        self.width, self.height = width[box], height[box]
        self.row, self.col = inside // self.width, inside % self.width

    def _side(self, x: np.ndarray, radius: int, sign: int, along_rows: bool, pick: Callable) -> np.ndarray:
        """Extreme over the next ``radius`` places in one direction, own one included; by doubling."""
        place, length = (self.col, self.width) if along_rows else (self.row, self.height)
        stride = np.ones(len(x), np.int64) if along_rows else self.width
        reach = 1
        while reach < radius + 1:
            step = min(reach, radius + 1 - reach)
            there = place + sign * step
            own = np.flatnonzero((there >= 0) & (there < length))
            wider = x.copy()
            wider[own] = pick(x[own], x[own + sign * step * stride[own]])
            x, reach = wider, reach + step
        return x

    def line(self, x: np.ndarray, radius: int, along_rows: bool, pick: Callable) -> np.ndarray:
        """Extreme over ``radius`` places to both sides."""
        return pick(self._side(x, radius, 1, along_rows, pick), self._side(x, radius, -1, along_rows, pick))

    def sweep(self, x: np.ndarray, element: Element, pick: Callable) -> np.ndarray:
        """Extreme over the element: a square is a row and a column, a diamond crosses in turn."""
        if element.shape == "square":
            return self.line(self.line(x, element.radius, True, pick), element.radius, False, pick)
        for _ in range(element.radius):
            x = pick(self.line(x, 1, True, pick), self.line(x, 1, False, pick))
        return x


def _swept(tile, row, col, value: np.ndarray, known: np.ndarray, kind: str, element: Element) -> np.ndarray:
    """Values after both passes; places without a value don't count, ``known`` is updated."""
    boxes = Boxes(tile, row, col)
    passes = [(np.maximum, -1), (np.minimum, 2)]  # masks are 0 or 1
    for pick, blank in passes if kind == "close" else passes[::-1]:
        grid = np.full(len(boxes.row), blank, np.int8)
        order = np.argsort(value if blank < 0 else -value, kind="stable")  # of equal positions the extreme
        order = order[known[order]]
        grid[boxes.at[order]] = value[order]
        value = boxes.sweep(grid, element, pick)[boxes.at]
        known[:] = value != blank
    return value


def _whole_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole tiles from rows sorted by tile; held are the rows of one tile."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        new = _borders(table)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held


def _borders(table: pa.Table) -> np.ndarray:
    """Where a new tile begins."""
    keys = [pa.chunked_array([table[RASTER].combine_chunks().dictionary_encode().indices]).to_numpy(),
            table["_br"].to_numpy(), table["_bc"].to_numpy()]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def morph(
    pixels: DataFrame, kind: str, element: Element, mask: str = "mask", tile: int = TILE,
) -> DataFrame:
    """Close or open a 0/1 mask; positions outside the raster do not count, nor do nulls.

    Rasters are cut into tiles, and pixels near a border go along to the tiles
    beside it: twice the element's radius, so that both passes are done in one
    task.  That one shuffle moves little more than the pixels themselves, and a
    pass costs a few array operations, whatever the element's size.  Other
    columns travel with their pixel.  Raster and position must not be null.
    """
    if kind not in ("close", "open"):
        raise ValueError("kind is close or open")
    reach = 2 * element.radius
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    own = (F.col("_br") == F.floor(F.col("row") / tile)) & (F.col("_bc") == F.floor(F.col("col") / tile))
    dealt = pixels.withColumn("_br", F.explode(span("row"))).withColumn("_bc", F.explode(span("col"))).withColumn(
        "_own", own)
    names = pixels.columns

    def run(batches):
        for table in _whole_tiles(batches):
            number = np.cumsum(_borders(table))
            given = table[mask].combine_chunks()
            known = np.asarray(given.is_valid()).copy()
            value = given.cast(pa.int8()).fill_null(0).to_numpy()
            value = _swept(number, table["row"].to_numpy().astype(np.int64),
                           table["col"].to_numpy().astype(np.int64), value, known, kind, element)
            at = table.schema.get_field_index(mask)
            out = table.set_column(at, mask, pa.array(value.astype(np.int32), mask=~known))
            yield from out.filter(table["_own"]).select(names).combine_chunks().to_batches()

    schema = dealt.withColumn(mask, F.col(mask).cast("int")).select(*[f"`{n}`" for n in names]).schema
    ready = dealt.withColumn(mask, F.col(mask).cast("int"))
    return ready.repartition(RASTER, "_br", "_bc").sortWithinPartitions(RASTER, "_br", "_bc").mapInArrow(run, schema)
