"""Joins along time: nearest, interpolated, many streams at once.

Left and right rows travel together, cut into ranges of (key, stamp) (see
``carry``), so a match needs no join back to the left rows.  The right side is
reduced to its first row per key and stamp before: copies collapse in the
map-side aggregate.  Left rows without a stamp match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.plans.skew import carry, keep_first, same


def _fields(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def _timeline(
    left: DataFrame, rights: Sequence[DataFrame], on: str, by: Sequence[str],
    orders: Sequence[Sequence[str]],
) -> DataFrame:
    """Left rows as ``_row`` and, of each stream, the first right row per stamp as ``_r{i}``."""
    both = left.select(*by, on, _fields(left.columns).alias("_row"))
    for i, (right, order) in enumerate(zip(rights, orders)):
        rest = [c for c in right.columns if c not in by]
        first = keep_first(right.where(F.col(on).isNotNull()), [*by, on], order or rest)
        both = both.unionByName(
            first.select(*by, on, _fields(rest).alias(f"_r{i}")), allowMissingColumns=True)
    return both


def _left_rows(found: DataFrame, left: DataFrame, *more: Column) -> DataFrame:
    """The columns of the left rows, and ``more``."""
    return found.where(F.col("_row").isNotNull()).select(
        *[F.col("_row")[c].alias(c) for c in left.columns], *more)


def _nearest(on: str, before: str, after: str) -> Column:
    """Right row closest to the stamp; the earlier of two equally close ones."""
    gap_before = F.col(on) - F.col(before)[on]
    gap_after = F.col(after)[on] - F.col(on)
    return F.when(F.col(on).isNotNull(), F.when(
        F.col(after).isNull() | (gap_before <= gap_after), F.col(before)).otherwise(F.col(after)))


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str] = (),
    tolerance: float | None = None,
    order: Sequence[str] = (),
    prefix: str = "r_",
    how: str = "left",
) -> DataFrame:
    """Each left row with the right row nearest in ``on``, at most ``tolerance`` away.

    ``on`` is numeric.  The bound is inclusive, ties go to the earlier row, and
    of several right rows at one stamp the first in ``order`` counts.  Right
    columns come back with ``prefix``, the signed gap as ``{prefix}gap``.
    ``how`` is ``left`` or ``inner``.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    found = carry(
        _timeline(left, [right], on, by, [order]), by, on, {"_before": "_r0"}, {"_after": "_r0"},
    ).withColumn("_match", _nearest(on, "_before", "_after"))
    gap = F.col("_match")[on] - F.col(on)
    if tolerance is not None:
        found = found.withColumn("_match", F.when(F.abs(gap) <= tolerance, F.col("_match")))
    if how == "inner":
        found = found.where(F.col("_match").isNotNull())
    rest = [c for c in right.columns if c not in by]
    return _left_rows(
        found, left, *[F.col("_match")[c].alias(f"{prefix}{c}") for c in rest],
        gap.alias(f"{prefix}gap"))


def update_from_nearest(
    images: DataFrame, drone: DataFrame, on: str, by: Sequence[str] = (), tolerance: float = 5.0,
    order: Sequence[str] = (),
) -> DataFrame:
    """Overwrite lat, lon and alt of images by the nearest drone row's non-null values.

    The drone altitude is ``alt``, or ``altitude`` where that is missing.
    """
    altitudes = [F.col(f"_d_{c}") for c in ("alt", "altitude") if c in drone.columns]
    wanted = [c for c in (*by, on, "lat", "lon", "alt", "altitude") if c in drone.columns]
    wanted += [c for c in order if c not in wanted]
    joined = asof_nearest(images, drone.select(*wanted), on, by, tolerance, order=order, prefix="_d_")
    for name, values in (("lat", [F.col("_d_lat")]), ("lon", [F.col("_d_lon")]), ("alt", altitudes)):
        joined = joined.withColumn(name, F.coalesce(*values, F.col(name)))
    return joined.select(*images.columns)


def interp_join(
    left: DataFrame, right: DataFrame, on: str, cols: Sequence[str], by: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """Right columns interpolated linearly at the left stamps.

    Outside the right range the two outermost samples are extended; with fewer
    than two samples the result is null.
    """
    samples = right.select(*by, on, *dict.fromkeys([*cols, *order]))
    found = carry(
        _timeline(left, [samples], on, by, [order or list(cols)]), by, on,
        {"_b": "_r0"}, {"_a": "_r0"}, depth=2)
    # after the last sample; before the first; between two
    low = F.when(F.col("_a").isNull(), F.col("_b_2")).when(
        F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_b"))
    high = F.when(F.col("_a").isNull(), F.col("_b")).when(
        F.col("_b").isNull(), F.col("_a_2")).otherwise(F.col("_a"))
    found = found.withColumn("_low", low).withColumn("_high", high)
    slope = lambda c: (F.col("_high")[c] - F.col("_low")[c]) / (
        F.col("_high")[on] - F.col("_low")[on])
    return _left_rows(found, left, *[
        (slope(c) * (F.col(on) - F.col("_low")[on]) + F.col("_low")[c]).alias(c) for c in cols])


def mean_period(df: DataFrame, on: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean gap between consecutive stamps per key, from the ends and the count."""
    return df.groupBy(*by).agg(
        F.try_divide(F.max(on) - F.min(on), F.count(on) - 1).alias("period"))


def sync_streams(
    streams: Sequence[DataFrame],
    on: str,
    by: Sequence[str] = (),
    threshold: float | str | None = "mean_period",
    orders: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """Rows of the first stream with the nearest row of every other stream.

    Rows without a match in some stream are dropped.  ``threshold`` is a largest
    gap, ``"mean_period"`` for the mean period of the first stream per key, or
    None for no bound.  Columns of stream ``i`` get the prefix ``s{i}_``.
    All streams are matched in one pass over the union of their rows.
    """
    first, others = streams[0], list(streams[1:])
    n = range(len(others))
    found = carry(
        _timeline(first, others, on, by, orders or [()] * len(others)), by, on,
        {f"_b{i}": f"_r{i}" for i in n}, {f"_a{i}": f"_r{i}" for i in n},
    ).where(F.col("_row").isNotNull())
    keep = F.lit(True)
    for i in n:
        found = found.withColumn(f"_m{i}", _nearest(on, f"_b{i}", f"_a{i}"))
        keep = keep & F.col(f"_m{i}").isNotNull()
    if threshold == "mean_period":
        found = _attach_period(found, mean_period(first, on, by), by)
        bound = F.col("_period")
    else:
        bound = None if threshold is None else F.lit(threshold)
    if bound is not None:
        for i in n:
            keep = keep & (F.abs(F.col(f"_m{i}")[on] - F.col(on)) <= bound)
    return _left_rows(
        found.where(keep), first,
        *[F.col(f"_m{i}")[c].alias(f"s{i + 1}_{c}")
          for i in n for c in others[i].columns if c not in by])


def _attach_period(df: DataFrame, periods: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return df.withColumn("_period", periods.select("period").scalar())
    renamed = periods.select(*[F.col(k).alias(f"_p_{k}") for k in by], F.col("period").alias("_period"))
    on = same([F.col(k) for k in by], [F.col(f"_p_{k}") for k in by])
    return df.join(renamed, on, "left").drop(*[f"_p_{k}" for k in by])
