"""Order-dependent building blocks that stay balanced under hot keys.

A window partitioned by a key alone puts every row of that key into one task.
The functions here split a key further, by ranges of its order column, and
pass only small summaries across the splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.plans.session import cut_lineage

# monotonically_increasing_id keeps the row position in the lower 33 bits
_POSITION_BITS = 33


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of two key lists."""
    pairs = [a.eqNullSafe(b) for a, b in zip(left, right)]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``.

    An aggregate rather than ``row_number() == 1``, so copies of a key collapse
    before the shuffle and a hot key costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row")) if rest else (
        df.select(*keys).distinct())
    if not rest:
        return picked.select(*df.columns)
    return picked.select(*keys, "_row.*").select(*df.columns)


def ordinal(
    df: DataFrame,
    order: Sequence[Column | str],
    by: Sequence[str] = (),
    name: str = "ordinal",
) -> DataFrame:
    """Zero-based position of each row in ``order``, per ``by`` key if given.

    ``order`` must be total for the result to be unique.  Rows are range-sorted,
    so a hot key spreads over many partitions; the partition sizes (one row per
    partition) give the offsets.  The sorted rows are written to the shared
    folder because the positions must be the same in both uses.
    """
    sort = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [F.col(k) for k in by] + sort
    placed = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", _POSITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # at most one row per shuffle partition, whatever the size of the data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    numbered = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset")
                    + F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_part", "_place", "_offset")
    )
    if not by:
        return numbered
    starts = numbered.groupBy(*by).agg(F.min(name).alias("_start"))
    starts = starts.select(*[F.col(k).alias(f"_k_{k}") for k in by], "_start")
    on = same([F.col(k) for k in by], [F.col(f"_k_{k}") for k in by])
    return (
        numbered.join(starts, on, "left")
        .withColumn(name, F.col(name) - F.col("_start"))
        .drop("_start", *[f"_k_{k}" for k in by])
    )


def carry(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    depth: int = 1,
) -> DataFrame:
    """Nearest non-null values before and after each row, per key, in the order of ``ts``.

    ``previous`` and ``following`` map an output column to the nullable column it
    carries; a row is never its own match.  With ``depth=2`` the value beyond the
    nearest one comes along as ``{output}_2``.  Per key and carried column the
    stamps of non-null values must be unique; at one stamp rows with a value
    come before rows without any, and rows without a stamp come first of all.

    Rows are cut into ranges of (key, stamp), so neither a hot key nor a crowded
    stretch of time fills one task.  A key that crosses a range border needs the
    values next to it: of each range at most ``depth`` values per key, column and
    end are copied to the ranges that look for them.  The cut is written to the
    shared folder because it must be the same in all its uses.
    """
    previous, following = previous or {}, following or {}
    sources = sorted({*previous.values(), *following.values()})
    given = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in sources])
    # spreads rows of one stamp; maps can't be hashed
    ties = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    placed = cut_lineage(
        df.withColumn("_given", given)
        .repartitionByRange(*by, ts, F.col("_given").desc(), F.xxhash64(*[f"`{c}`" for c in ties]))
        .withColumn("_part", F.spark_partition_id()))
    rows = placed.withColumn("_copy", F.lit(False)).unionByName(
        _border_values(placed, by, ts, sources, depth), allowMissingColumns=True)

    inside = Window.partitionBy("_part", *by)
    up = inside.orderBy(F.col(ts).asc(), F.col("_given").desc())
    down = inside.orderBy(F.col(ts).desc(), F.col("_given").asc())
    for outputs, order in ((previous, up), (following, down)):
        past = order.rowsBetween(Window.unboundedPreceding, -1)
        for out, src in outputs.items():
            rows = rows.withColumn(out, F.last(src, ignorenulls=True).over(past))
            if depth == 2:
                pair = F.when(F.col(src).isNotNull(), F.struct(
                    F.col(src).alias("near"), F.col(out).alias("far")))
                rows = rows.withColumn("_pair", pair).withColumn(
                    f"{out}_2", F.last("_pair", ignorenulls=True).over(past)["far"])
    names = [n for out in (*previous, *following) for n in ([out, f"{out}_2"] if depth == 2 else [out])]
    return rows.where(~F.col("_copy")).select(*[f"`{c}`" for c in df.columns], *names)


def _border_values(
    placed: DataFrame, by: Sequence[str], ts: str, sources: Sequence[str], depth: int,
) -> DataFrame:
    """Copies of values for the ranges that look for them beyond their border.

    The last ``depth`` values of a range serve the ranges after it until ``depth``
    later values have come, and the first ones the ranges before it likewise.
    """
    key = [F.col(k) for k in by] or [F.lit(0)]
    spans = placed.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(
        F.min("_part").alias("_lo"), F.max("_part").alias("_hi")).where("_lo < _hi")
    # only keys that cross a border: fewer than there are ranges, whatever the data
    kinds = F.array_compact(F.array(*[
        F.when(F.col(s).isNotNull(), F.lit(i)) for i, s in enumerate(sources)]))
    values = (
        placed.where("_given")
        .join(F.broadcast(spans), same(key, [F.col(f"_k{i}") for i in range(len(key))]))
        .select(*by, ts, *sources, "_part", "_lo", "_hi", F.explode(kinds).alias("_kind")))
    inside = Window.partitionBy("_part", *by, "_kind")
    at_end = F.row_number().over(inside.orderBy(F.col(ts).desc())) <= depth
    at_start = F.row_number().over(inside.orderBy(F.col(ts).asc())) <= depth
    ends = values.withColumn("_end", at_end).withColumn("_start", at_start).withColumn(
        "_forward", F.explode(F.array_compact(F.array(
            F.when(F.col("_end"), F.lit(True)), F.when(F.col("_start"), F.lit(False))))))
    line = Window.partitionBy(*by, "_kind", "_forward").orderBy("_part", ts)
    ends = ends.select(
        "*", F.when(F.col("_forward"), F.col("_part") + 1).otherwise(
            F.coalesce(F.lag("_part", depth).over(line), "_lo")).alias("_from"),
        F.when(F.col("_forward"), F.coalesce(F.lead("_part", depth).over(line), "_hi")).otherwise(
            F.col("_part") - 1).alias("_to"))
    served = F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to"))
    return ends.select(
        *by, ts, F.explode(served).alias("_part"), F.lit(True).alias("_given"),
        F.lit(True).alias("_copy"),
        *[F.when(F.col("_kind") == i, F.col(s)).alias(s) for i, s in enumerate(sources)])


def exact_quantiles(
    df: DataFrame, value: str, by: Sequence[str], shares: dict[str, float],
) -> DataFrame:
    """Exact quantiles per key, linear between neighbours, one column per share.

    Values are range-sorted and only those at the wanted positions are gathered,
    so neither a hot key nor many distinct values fill one task.
    """
    known = df.select(*by, value).where(F.col(value).isNotNull())
    placed = ordinal(known, [value], by, "_k")
    sizes = placed.groupBy(*by).agg((F.max("_k") + 1).alias("_n"))
    spots = sizes.select(*by, "_n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(share)).alias("at"))
        for name, share in shares.items()])).alias("_s"))
    wanted = spots.select(
        *by, F.col("_s.name").alias("_name"), F.col("_s.at").alias("_at"),
        F.explode(F.array_distinct(F.array(F.floor("_s.at"), F.ceil("_s.at")))).alias("_k"))
    found = placed.join(wanted, [*by, "_k"]).groupBy(*by, "_name", "_at").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    level = F.col("_lo") + (F.col("_at") - F.floor("_at")) * (F.col("_hi") - F.col("_lo"))
    return found.groupBy(*by).agg(*[
        F.max(F.when(F.col("_name") == name, level)).alias(name) for name in shares])
