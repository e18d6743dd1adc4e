"""Versioned table snapshots and keyed appends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.plans.skew import keep_first, same


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        marker = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v") and name[1:].isdigit() and fs.exists(marker):
            done.append(int(name[1:]))
    return sorted(done)


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Write ``df`` as the next version under ``path`` and return its number.

    A version counts once its ``_SUCCESS`` marker exists, so a lost job leaves
    the version before it in place.
    """
    done = _versions(df.sparkSession, path)
    version = done[-1] + 1 if done else 0
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/v{version}")
    return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Latest finished version, or the one named."""
    if version is None:
        done = _versions(spark, path)
        if not done:
            raise FileNotFoundError(f"no finished snapshot under {path}")
        version = done[-1]
    return spark.read.parquet(f"{path}/v{version}")


def anti_new(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``."""
    return new.join(existing.select(*keys), list(keys), "left_anti")


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists and holds more than markers and unfinished work."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(root)) and any(
        not status.getPath().getName().startswith(("_", ".")) for status in fs.listStatus(root))


def stored_keys(
    target: str, batch: DataFrame, keys: Sequence[str], partition_by: Sequence[str] = (),
) -> DataFrame:
    """Keys of the table at ``target`` that ``batch`` could hold, from its partitions if there are any.

    The partitions a batch touches are few (its days, say), so the driver names
    them and the scan leaves the others out.
    """
    stored = batch.sparkSession.read.parquet(target)
    if not partition_by:
        return stored.select(*keys)
    touched = batch.select(*partition_by).distinct().collect()
    match = [reduce(lambda a, b: a & b, [
        F.col(c).isNull() if row[c] is None else F.col(c) == F.lit(row[c]).cast(batch.schema[c].dataType)
        for c in partition_by]) for row in touched]
    return stored.where(reduce(lambda a, b: a | b, match, F.lit(False))).select(*keys)


def append_new(
    target: str, batch: DataFrame, keys: Sequence[str], partition_by: Sequence[str] = (),
) -> None:
    """Append the rows whose key the Parquet table at ``target`` does not hold yet.

    Running the same batch twice adds nothing the second time.  ``partition_by``
    lays the table out by columns that are the same for equal keys (the day of a
    stamp, a dataset): then a batch reads the keys of the partitions it touches,
    however large the table has grown.  Without it all stored keys are read.
    """
    spark = batch.sparkSession
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in batch.columns]))
    batch = keep_first(batch, list(keys), [rest])
    # only a missing table counts as new; a table that can't be read raises
    fresh = batch
    if _has_files(spark, target):
        stored = stored_keys(target, batch, keys, partition_by).toDF(*[f"_stored_{k}" for k in keys])
        # a null in a key is a value like any other
        fresh = batch.join(stored, same(
            [F.col(f"`{k}`") for k in keys], [F.col(f"`_stored_{k}`") for k in keys]), "left_anti")
    fresh.select(*[F.col(f"`{c}`") for c in batch.columns]).write.mode("append").partitionBy(
        *partition_by).parquet(target)
