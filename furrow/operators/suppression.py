"""Greedy suppression of overlapping boxes, for groups of any size and density."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.plans.greedy import TILE, dropped
from furrow.plans.session import cut_lineage
from furrow.plans.skew import ordinal

# boxes of a cell, best first, that are settled in one round
HEAD = 256
# boxes of a group that a task settles alone, and of the groups it looks at together
SMALL = 1024
TOGETHER = 8192
CORNERS = ["_x1", "_y1", "_x2", "_y2"]
CELL = ["_by", "_lx", "_ly", "_cx", "_cy"]

_PLACED = pa.schema([
    ("_by", pa.string()), *[(c, pa.float64()) for c in CELL[1:]], ("_ux", pa.bool_()), ("_uy", pa.bool_()),
    ("_r", pa.int64()), *[(c, pa.float64()) for c in CORNERS]])
PLACED = ("_by string, _lx double, _ly double, _cx double, _cy double, _ux boolean, _uy boolean, _r long, "
          "_x1 double, _y1 double, _x2 double, _y2 double")
_FOUND = pa.schema([("better", pa.int64()), ("worse", pa.int64()), ("_by", pa.string()),
                    ("_x", pa.float64()), ("_y", pa.float64())])
FOUND = "better long, worse long, _by string, _x double, _y double"


def _overlap(a: dict, b: dict, least, greatest):
    """Width, height and union of the overlap of two boxes, for columns as for arrays."""
    w = least(a["_x2"], b["_x2"]) - greatest(a["_x1"], b["_x1"])
    h = least(a["_y2"], b["_y2"]) - greatest(a["_y1"], b["_y1"])
    area = lambda c: (c["_x2"] - c["_x1"]) * (c["_y2"] - c["_y1"])
    return w, h, area(a) + area(b) - w * h


def _middle(low: np.ndarray, high: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The part of an extent that meets that of any box which overlaps it enough."""
    half = (high - low) * ((1 - threshold) / 2 * (1 + 1e-9) + 1e-12)
    return (high + low) / 2 - half, (high + low) / 2 + half


def _base(threshold: float) -> float:
    """Ratio of cell widths, no smaller than the ratio of extents that can overlap enough.

    Wide levels put few boxes on two of them, and wide cells few boxes on two cells.
    """
    return max(16.0, 1 / threshold)


def place(boxes: DataFrame, threshold: float) -> DataFrame:
    """Boxes on the grid cells in which any box that overlaps them enough stands, too.

    Boxes that suppress each other have similar extents and nearby centres.  Each
    box goes on the level of its own extent and, if it is close to it, on the next
    one (``_ux``, ``_uy``), and there on the one or two cells its middle part touches, in x and y.
    """
    base = _base(threshold)

    def run(batches):
        for batch in batches:
            v = {c: batch.column(i + 2).to_numpy() for i, c in enumerate(CORNERS)}
            spots = []
            for low, high in (("_x1", "_x2"), ("_y1", "_y2")):
                extent = v[high] - v[low]
                level = np.floor(np.log(extent) / math.log(base))
                close = extent * ((1 + 1e-6) / threshold) >= np.power(base, level + 1)
                first, last = _middle(v[low], v[high], threshold)
                spots.append([])
                for up in (0, 1):
                    cell = np.power(base, level + up + 1)
                    a, b = np.floor(first / cell), np.floor(last / cell)
                    here = close if up else np.ones(len(a), bool)
                    spots[-1].append((up, level + up, a, here))
                    spots[-1].append((up, level + up, b, here & (a != b)))
            for ux, lx, cx, on_x in spots[0]:
                for uy, ly, cy, on_y in spots[1]:
                    own = np.flatnonzero(on_x & on_y)
                    if len(own):
                        rows = pa.array(own)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(rows), *[pa.array(x[own]) for x in (lx, ly, cx, cy)],
                             pa.array(np.full(len(own), bool(ux))), pa.array(np.full(len(own), bool(uy))),
                             batch.column(1).take(rows), *[pa.array(v[c][own]) for c in CORNERS]],
                            schema=_PLACED)

    return boxes.select("_by", "_r", *CORNERS).mapInArrow(run, PLACED)


def _heads(batches, head: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole cells of sorted rows, each up to one more than ``head`` boxes, with cell and position."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        by = table["_by"].combine_chunks().dictionary_encode().indices.to_numpy()
        keys = [by, *[table[c].to_numpy() for c in CELL[1:]]]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        cell = np.cumsum(new) - 1
        at = np.arange(len(cell)) - np.flatnonzero(new)[cell]
        keep = at <= head
        done = keep & (cell < cell[-1])
        if done.any():
            yield table.filter(pa.array(done)), cell[done], at[done]
        held = table.filter(pa.array(keep & ~done))
    if held is not None and held.num_rows:
        yield held, np.zeros(held.num_rows, np.int64), np.arange(held.num_rows)


def _pairs(
    table: pa.Table, cell: np.ndarray, at: np.ndarray, threshold: float, head: int,
) -> pa.RecordBatch:
    """Conflicts among the first ``head`` boxes of each cell; a row without ``better`` for the next one."""
    beyond = np.flatnonzero(at == head)
    v = {c: table[c].to_numpy() for c in (*CORNERS, "_r", "_lx", "_ly", "_cx", "_cy")}
    up = {c: table[c].to_numpy(zero_copy_only=False) for c in ("_ux", "_uy")}
    spot = {}
    for axis, low, high in (("x", "_x1", "_x2"), ("y", "_y1", "_y2")):
        first, _ = _middle(v[low], v[high], threshold)
        spot[axis] = np.floor(first / np.power(_base(threshold), v[f"_l{axis}"] + 1))
    better, worse = [], []
    live = np.flatnonzero(at < head)
    for k in range(1, head):
        live = live[live + k < len(cell)]
        live = live[(cell[live] == cell[live + k]) & (at[live] + k < head)]
        if not len(live):
            break
        i, j = live, live + k
        # a pair meets on the level of its larger extent, and in the cell of its first common point
        good = ~(up["_ux"][i] & up["_ux"][j]) & ~(up["_uy"][i] & up["_uy"][j])
        for axis in "xy":
            good &= v[f"_c{axis}"][i] == np.maximum(spot[axis][i], spot[axis][j])
        i, j = i[good], j[good]
        w, h, union = _overlap({c: v[c][i] for c in CORNERS}, {c: v[c][j] for c in CORNERS},
                               np.minimum, np.maximum)
        meet = (w > 0) & (h > 0)
        good = meet & (w * h / np.where(meet, union, 1) >= threshold)
        better.append(i[good])
        worse.append(j[good])
    i = np.concatenate([*better, beyond]).astype(np.int64)
    j = np.concatenate([*worse, beyond]).astype(np.int64)
    known = np.arange(len(i)) < len(i) - len(beyond)
    return pa.RecordBatch.from_arrays([
        pa.array(v["_r"][i], mask=~known), pa.array(v["_r"][j]),
        table["_by"].combine_chunks().take(pa.array(j)), pa.array(v["_x1"][j]), pa.array(v["_y1"][j]),
    ], schema=_FOUND)


def conflicts(boxes: DataFrame, threshold: float, head: int = HEAD) -> DataFrame:
    """(better, worse) of boxes that overlap enough, with the worse one's group and place.

    Of each cell the first ``head`` boxes in the order of rank take part; a row
    without ``better`` names the next one.
    """
    def run(batches):
        for rows in _heads(batches, head):
            yield _pairs(*rows, threshold, head)

    # the hash in front: the sort compares one number for most pairs of rows instead of texts with a common beginning
    placed = place(boxes, threshold).withColumn("_cell", F.xxhash64(*CELL))
    return placed.repartition("_cell").sortWithinPartitions("_cell", *CELL, "_r").drop("_cell").mapInArrow(run, FOUND)


def _suppressed(boxes: DataFrame, winners: DataFrame, threshold: float) -> DataFrame:
    """``_r`` of the boxes that one of the winners overlaps enough."""
    win = place(winners, threshold).select(*CELL, *[F.col(c).alias(f"{c}w") for c in CORNERS])
    w, h, union = _overlap({c: F.col(f"{c}w") for c in CORNERS}, {c: F.col(c) for c in CORNERS},
                           F.least, F.greatest)
    return place(boxes, threshold).select(*CELL, "_r", *CORNERS).join(win, CELL).where(
        (w > 0) & (h > 0) & (w * h / union >= threshold)).select("_r").distinct()


def _stay(group: np.ndarray, v: dict[str, np.ndarray], threshold: float) -> np.ndarray:
    """Which boxes stay, of whole groups with the better box first."""
    n = len(group)
    stay = np.ones(n, bool)
    solid = np.logical_and.reduce([np.isfinite(v[c]) for c in CORNERS])
    with np.errstate(invalid="ignore"):
        solid &= (v["_x2"] > v["_x1"]) & (v["_y2"] > v["_y1"])
    own = np.flatnonzero(solid)
    # along x, a box meets those that begin before it ends
    own = own[np.lexsort((v["_x1"][own], group[own]))]
    group, v = group[own], {c: v[c][own] for c in CORNERS}
    first, second = [], []
    live = np.arange(len(own))
    for k in range(1, len(own)):
        live = live[:np.searchsorted(live, len(own) - k)]
        live = live[(group[live] == group[live + k]) & (v["_x1"][live + k] < v["_x2"][live])]
        if not len(live):
            break
        i, j = live, live + k
        near = np.minimum(v["_y2"][i], v["_y2"][j]) > np.maximum(v["_y1"][i], v["_y1"][j])
        i, j = i[near], j[near]
        w, h, union = _overlap({c: v[c][i] for c in CORNERS}, {c: v[c][j] for c in CORNERS},
                               np.minimum, np.maximum)
        meet = (w > 0) & (h > 0)
        good = meet & (w * h / np.where(meet, union, 1) >= threshold)
        first.append(own[i[good]])
        second.append(own[j[good]])
    if not first:
        return stay
    a, b = np.concatenate(first), np.concatenate(second)
    better, worse = np.minimum(a, b), np.maximum(a, b)
    # boxes that no open one is better than stay, and what they overlap goes
    while len(better):
        waits = np.zeros(n, bool)
        waits[worse] = True
        wins = ~waits[better]
        stay[worse[wins]] = False
        going = ~wins & stay[better] & stay[worse]
        better, worse = better[going], worse[going]
    return stay


def _small(rows: DataFrame, schema, order: Sequence[str], threshold: float) -> DataFrame:
    """What stays of groups of a bounded size: each is settled in one piece."""
    names = schema.names

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                table = pa.Table.from_batches([*held, batch.slice(lo, TOGETHER)])
                by = table["_by"].combine_chunks()
                new = np.flatnonzero(np.append(True, pc.not_equal(by[1:], by[:-1]).to_numpy(zero_copy_only=False)))
                yield from settled(table.slice(0, new[-1]), new[:-1])
                held = table.slice(new[-1]).to_batches()
        if held:
            yield from settled(pa.Table.from_batches(held), np.zeros(1, np.int64))

    def settled(table: pa.Table, starts: np.ndarray):
        if table.num_rows:
            group = np.zeros(table.num_rows, np.int64)
            group[starts] = 1
            corners = {c: table[c].to_numpy() for c in CORNERS}
            yield from table.filter(pa.array(_stay(np.cumsum(group), corners, threshold))).select(names).to_batches()

    # equal in score and ids: fixed by the row itself; maps can't be hashed
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in schema.fields if "map<" not in f.dataType.simpleString()])
    return rows.withColumns({"_group": F.xxhash64("_by"), "_row": row}).repartition("_group").sortWithinPartitions(
        "_group", "_by", *order, "_row").drop("_group", "_row", "_score").mapInArrow(run, schema)


def nms(
    df: DataFrame, by: Sequence[str], box: Sequence[Column], score: str, ids: Sequence[str],
    threshold: float = 0.5, offset: float = 0.0, head: int = HEAD, tile: int = TILE, small: int = SMALL,
) -> DataFrame:
    """Greedy suppression per group: best score first, overlap >= threshold goes.

    ``box`` are corner expressions; ``offset`` widens both extents.  ``ids`` order
    boxes of one score; rows that agree in them, too, compete in an order that is
    fixed for the run.  Null scores rank first, NaN last.  A null in ``by`` is a
    group like any other.  A box with a corner that is null, NaN or infinite, or
    without an extent, suppresses nothing and stays.

    Groups of at most ``small`` boxes are settled in one piece, many to a task.
    Larger ones are cut along the ground: a round looks at the boxes of a group in the order
    of rank, up to the one at which some cell would hold more than ``head`` of
    them, so a crowded place lists no more than that many boxes against each
    other; what these conflict in is settled tile by tile (``plans.greedy``), and
    the winners remove what they overlap from the rest.  A place has room for a
    bounded number of boxes that stay, so the rest of a crowd shrinks fast.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    x1, y1, x2, y2 = box
    corners = [x1, y1, x2 + offset, y2 + offset]
    # a text that is never null stands for the group
    rows = df.select("*", *[c.cast("double").alias(n) for c, n in zip(corners, CORNERS)],
                     (-F.col(score)).alias("_score"),
                     F.to_json(F.struct(F.lit(0).alias("_"), *by)).alias("_by"))
    sizes = cut_lineage(rows.groupBy("_by").agg(F.count("*").alias("_n")))
    crowds = sizes.where(F.col("_n") > small).select("_by")
    if crowds.isEmpty():
        return _small(rows, df.schema, ["_score", *ids], threshold)
    if sizes.where(F.col("_n") <= small).isEmpty():
        return _large(rows, ids, threshold, head, tile).select(*df.columns)
    apart = _small(rows.join(crowds, "_by", "left_anti").select(*rows.columns), df.schema, ["_score", *ids], threshold)
    rest = rows.join(crowds, "_by", "left_semi").select(*rows.columns)
    return apart.union(_large(rest, ids, threshold, head, tile).select(*df.columns))


def _large(rows: DataFrame, ids: Sequence[str], threshold: float, head: int, tile: int) -> DataFrame:
    """What stays of groups of any size."""
    ranked = ordinal(rows, ["_score", *ids, "_by"], name="_r")
    limit = sys.float_info.max
    solid = reduce(lambda a, b: a & b, [F.col(c).between(-limit, limit) for c in CORNERS]) & (
        F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1"))
    waiting = ranked.where(solid).select("_by", "_r", *CORNERS)
    lost: list[DataFrame] = []
    while True:
        found = cut_lineage(conflicts(waiting, threshold, head))
        limits = found.where("better IS NULL").groupBy("_by").agg(F.min("worse").alias("_limit"))
        edges = found.where("better IS NOT NULL")
        last = limits.isEmpty()
        if not last:
            edges = edges.join(limits, "_by", "left").where("_limit IS NULL OR worse < _limit").drop("_limit")
        # groups that show no conflict and no limit are done
        gone = dropped(edges, ["_by", "_x", "_y"], tile).withColumnRenamed("node", "_r")
        lost.append(gone)
        if last:
            break
        open_boxes = cut_lineage(waiting.join(limits, "_by"))
        won = open_boxes.where(F.col("_r") < F.col("_limit")).join(gone, "_r", "left_anti")
        later = open_boxes.where(F.col("_r") >= F.col("_limit")).drop("_limit")
        out = cut_lineage(_suppressed(later, won, threshold))
        lost.append(out)
        waiting = cut_lineage(later.join(out, "_r", "left_anti"))
    return ranked.join(reduce(DataFrame.union, lost), "_r", "left_anti")
