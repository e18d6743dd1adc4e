"""Questions from chunks of documents to buckets of fingerprints, and the answers back.

Documents are dealt into chunks of a few MB by a hash of the row; rows equal in
id and text are numbered first, so they spread over the chunks too.  A chunk asks
about each distinct fingerprint once, whatever the number of its copies, so a
passage that a third of all documents share reaches its bucket once per chunk.
Fingerprints go as sorted 32-bit remainders in one blob for each bucket; the
answer is an array in the same order, so no positions travel.  The order is a
function of the chunk's documents alone, hence the same when a task runs again.
The number of chunks and of buckets grows with the bytes of text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.text import U64, pack_sorted, planes
from furrow.plans.session import cut_lineage

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
COPIES = 4096  # equal rows that one task writes out at a time

ASK = "bucket long, chunk long, keys binary, extra binary"
ANSWER = "chunk long, bucket long, answer binary"
_ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()),
                  ("extra", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary())])


@dataclass(frozen=True)
class Deal:
    """How many chunks, and how many leading bits of a fingerprint name its bucket."""

    chunks: int
    bits: int


def deal(docs: DataFrame) -> Deal:
    """Sizes for this input, from one aggregate over the length of the texts."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return Deal(16 + total // CHUNK_BYTES, max(4, math.ceil(math.log2(total / BUCKET_BYTES + 1))))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``copy``, a number that tells rows equal in doc_id and text apart.

    Rows that stand alone pass through.  Equal ones are counted, sent on in lots
    of ``COPIES`` and written out again there, so the number depends on the rows
    alone and stays the same when a task runs again.
    """
    marked = rows.withColumn("print", F.xxhash64("doc_id", "text"))
    often = cut_lineage(
        marked.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"))
    alone = marked.join(often, "print", "left_anti").select(
        "doc_id", "text", F.lit(0).cast("long").alias("copy"))
    lots = marked.join(often, "print", "left_semi").groupBy("doc_id", "text").agg(
        F.count("*").alias("n")).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))
    ).repartition("doc_id", "text", "first")
    return alone.union(lots.select("doc_id", "text", F.explode(F.sequence(
        "first", F.least(F.col("n"), F.col("first") + COPIES) - 1)).alias("copy")))


def in_chunks(docs: DataFrame, sizes: Deal) -> DataFrame:
    """doc_id, text and chunk; every pass takes these rows, so their exchange is shared."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return numbered(rows).select(
        "doc_id", "text",
        F.pmod(F.xxhash64("doc_id", "text", "copy"), F.lit(sizes.chunks)).alias("chunk"))


def questions(
    chunk: int, ids: np.ndarray, bits: int, extra: list[np.ndarray],
) -> pa.Table:
    """One row per bucket for ascending distinct ``ids`` of 32 + ``bits`` bits."""
    cuts = np.searchsorted(ids, np.arange((1 << bits) + 1, dtype=U64) << U64(32))
    rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
    low = (ids & U64(0xFFFFFFFF)).astype(np.uint32)
    return pa.table({
        "bucket": pa.array([r[0] for r in rows], pa.int64()),
        "chunk": pa.array([chunk] * len(rows), pa.int64()),
        "keys": pa.array([pack_sorted(low[lo:hi]) for _, lo, hi in rows], pa.binary()),
        "extra": pa.array([b"".join(planes(x[lo:hi]) for x in extra) for _, lo, hi in rows],
                          pa.binary()),
    }, schema=_ASK)


def answers(table: pa.Table, sizes: list[int], values: np.ndarray) -> pa.Table:
    """Rows that carry each question's share of ``values``."""
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return pa.table({
        "chunk": table["chunk"].combine_chunks(), "bucket": table["bucket"].combine_chunks(),
        "answer": pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])],
                           pa.binary()),
    }, schema=_ANSWER)


def gathered(table: pa.Table, dtype, column: str = "answer") -> np.ndarray:
    """A chunk's answers in the order of its fingerprints."""
    pairs = sorted(zip(table["bucket"].to_pylist(), table[column].to_pylist()))
    return np.frombuffer(b"".join(raw for _, raw in pairs), dtype)
