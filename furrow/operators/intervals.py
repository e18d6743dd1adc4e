"""Interval joins by levelled buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.plans.skew import keep_first


def interval_join(
    rows: DataFrame, spans: DataFrame, value: str, start: str, end: str, base: float = 64,
) -> DataFrame:
    """Rows with every span whose inclusive [start, end] holds their ``value``.

    A span sits on the level whose buckets are as wide as it is, so it fills at
    most two of them, and rows look up one bucket per level in use.
    """
    width = lambda level: F.lit(float(base)) * F.pow(F.lit(2.0), level)
    levelled = spans.where(F.col(start) <= F.col(end)).withColumn(
        "_level", F.greatest(F.lit(0), F.ceil(F.log2(
            F.greatest(F.col(end) - F.col(start), F.lit(1e-300)) / base)).cast("int")))
    filled = levelled.withColumn("_bucket", F.explode(F.sequence(
        F.floor(F.col(start) / width(F.col("_level"))), F.floor(F.col(end) / width(F.col("_level"))))))
    levels = levelled.select(F.collect_set("_level")).scalar()
    placed = rows.withColumn("_level", F.explode(levels)).withColumn(
        "_bucket", F.floor(F.col(value) / width(F.col("_level"))))
    return placed.join(filled, ["_level", "_bucket"]).where(
        F.col(value).between(F.col(start), F.col(end))).drop("_level", "_bucket")


def assign_intervals(
    rows: DataFrame, spans: DataFrame, row: str, start: str, end: str, order: str,
    values: Sequence[str], base: float = 64,
) -> DataFrame:
    """Overwrite ``values`` of rows from the last span, by ``order``, that holds them.

    Spans over the same rows count once, and each distinct row number is
    resolved once; rows outside every span keep what they have.
    """
    last = keep_first(spans.select(start, end, order, *values), [start, end], [-F.col(order)])
    hits = interval_join(rows.select(row).distinct(), last, row, start, end, base)
    won = hits.groupBy(row).agg(F.max_by(F.struct(*values), F.col(order)).alias("_won"))
    joined = rows.join(won, row, "left")
    for name in values:
        new = F.col("_won")[name]
        if name in rows.columns:
            new = F.when(F.col("_won").isNotNull(), new).otherwise(F.col(f"`{name}`"))
        joined = joined.withColumn(name, new)
    return joined.drop("_won")
