"""Ranked lexical search by sparse ball trees (operator 13).

A document is a sparse vector over the terms of the items: the value of a term
is its weight times its damped frequency, an integer, so an item's score is the
inner product with a vector of ones.

1. one pass over the texts counts the items' terms in every document and all
   terms of every document; the counts are written once;
2. two aggregates over them give the number of documents and terms, and the
   document frequency of each of the items' terms;
3. the vectors of a partition are dealt into shards.  A shard becomes a ball
   tree: each node has a centroid and a radius, and is cut between two far
   members.  For every item the nodes are visited best bound first, bound =
   item . centroid + length of the item x radius.  Bounds are rounded up by
   more than the error of their sums, scores at the leaves are exact integers.
   The best found so far stay from shard to shard, so later shards are pruned
   by them;
4. what a partition found is ranked in two steps.

Items are taken in blocks of ``block_bytes`` of text, which bounds what is sent
to the tasks; each block is one search over all documents.

Defined cases: null text, and text without a term, has no terms and is found by
nothing; a null doc_id ranks behind all others of its score; rows with one
doc_id are documents of their own; equal rows of ``items`` are one item, rows
that share an item_id but not the text are ranked apart; an item without an id
keeps its null; an empty table gives an empty result; further columns are not
looked at.  A text of any length is one row of a task.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import text
from furrow.plans.session import cut_lineage

BEST = 50
LEAF = 64
SHARD = 4096
BLOCK_BYTES = 4 << 20

COUNTS = "doc_id long, n long, terms array<int>, tf array<int>"
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                     ("tf", pa.list_(pa.int32()))])
FOUND = "item int, doc_id long, score long"
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
_LAST = np.iinfo(np.int64).max
_GROUPS = 64


def terms_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Document and code of each term, in order, and the distinct terms the codes stand for."""
    data, offsets = text.text_bytes(column)
    data = text.LOWER[data]
    starts, ends, _ = text.class_runs(text.LETTER[data].view(np.uint8), offsets)
    codes, words = text.word_codes(data, starts, ends)
    return np.searchsorted(offsets, starts, "right") - 1, codes, words


def _counts(table: pa.Table, vocabulary: pa.Array) -> pa.RecordBatch:
    """Number of terms and the frequencies of the vocabulary's terms, for documents with terms."""
    doc, codes, words = terms_of(table["text"])
    n = np.bincount(doc, minlength=table.num_rows)
    known = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False)
    known = known[codes].astype(np.int64)
    size = len(vocabulary)
    pairs, tf = np.unique(doc[known >= 0] * size + known[known >= 0], return_counts=True)
    own = np.flatnonzero(n > 0)
    cuts = pa.array(np.append(np.searchsorted(pairs, own * size), len(pairs)), pa.int32())
    return pa.RecordBatch.from_arrays([
        table["doc_id"].combine_chunks().take(pa.array(own)), pa.array(n[own], pa.int64()),
        pa.ListArray.from_arrays(cuts, pa.array(pairs % max(size, 1), pa.int32())),
        pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int32()))], schema=_COUNTS)


@dataclass
class Items:
    """Terms of a block of items, as numbers of its vocabulary."""

    vocabulary: pa.Array
    terms: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Items:
        doc, codes, words = terms_of(pa.array(texts, pa.string()))
        pairs = np.unique(doc * max(len(words), 1) + codes)
        doc, codes = pairs // max(len(words), 1), pairs % max(len(words), 1)
        return cls(words, codes, np.searchsorted(doc, np.arange(len(texts) + 1)))


def weights(documents: int, frequency: np.ndarray) -> np.ndarray:
    """Weight of each term from the number of documents and of those that hold it."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1)))
                     for df in frequency], np.int64)


def damped(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Frequency ``tf`` in a document of ``n`` terms, saturated and scaled by its length."""
    m = 100 - 50 + (50 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Vectors:
    """Sparse rows: columns and integer values end to end, with the rows' borders."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, values: np.ndarray, first: np.ndarray):
        self.ids, self.columns, self.values, self.first = ids, columns, values, first

    def take(self, rows: np.ndarray) -> _Vectors:
        sizes = self.first[rows + 1] - self.first[rows]
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(first[-1]) + np.repeat(self.first[rows] - first[:-1], sizes)
        return _Vectors(self.ids[rows], self.columns[at], self.values[at], first)

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Inner product of each row (none is empty) with a dense vector."""
        return np.add.reduceat(self.values * dense[self.columns], self.first[:-1])


class BallTree:
    """Centroids and radii over the vectors of a shard; leaves hold at most ``leaf`` rows."""

    def __init__(self, rows: _Vectors, width: int, leaf: int = LEAF) -> None:
        self.centroid: list[tuple[np.ndarray, np.ndarray]] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[_Vectors | None] = []
        squares = np.add.reduceat(rows.values.astype(float) ** 2, rows.first[:-1])
        self._grow(rows, squares, width, leaf)

    def _grow(self, rows: _Vectors, squares: np.ndarray, width: int, leaf: int) -> None:
        todo = [(rows, squares, None, 0)]
        while todo:
            rows, squares, parent, side = todo.pop()
            node = len(self.radius)
            if parent is not None:
                pair = self.children[parent]
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            centroid = np.bincount(rows.columns, rows.values, width) / len(rows.ids)
            away = np.maximum(squares - 2 * rows.dot(centroid) + centroid @ centroid, 0)
            # rounding errors of the sums are far below this share of the longest vector
            self.radius.append(math.sqrt(away.max() + 1e-9 * squares.max()) * (1 + 1e-9))
            held = np.flatnonzero(centroid)
            self.centroid.append((held, centroid[held]))
            self.rows.append(None)
            self.children.append(None)
            if len(rows.ids) <= leaf:
                self.rows[node] = rows
                continue
            left = self._side(rows, squares, int(away.argmax()), width)
            self.children[node] = (-1, -1)
            for k, part in enumerate((np.flatnonzero(left), np.flatnonzero(~left))):
                todo.append((rows.take(part), squares[part], node, k))

    @staticmethod
    def _side(rows: _Vectors, squares: np.ndarray, far: int, width: int) -> np.ndarray:
        """Rows nearer to the first of two far rows; halves where all are alike."""
        def distances(i: int) -> np.ndarray:
            dense = np.zeros(width)
            own = slice(rows.first[i], rows.first[i + 1])
            dense[rows.columns[own]] = rows.values[own]
            return squares - 2 * rows.dot(dense) + squares[i]

        one = distances(far)
        left = one < distances(int(one.argmax()))
        if not left.any() or left.all():
            left = np.arange(len(left)) < len(left) // 2
        return left

    def bounds(self, items: Items, dense: np.ndarray) -> list[np.ndarray]:
        """For each node the highest score that each item can reach in it, rounded up."""
        counts = np.diff(items.first)
        some = np.flatnonzero(counts)
        length = np.sqrt(counts[some])
        out = []
        for (columns, values), radius in zip(self.centroid, self.radius):
            dense[columns] = values
            bound = np.zeros(len(counts))
            bound[some] = np.add.reduceat(dense[items.terms], items.first[some])
            bound[some] = (bound[some] + length * radius) * (1 + 1e-9) + 1
            dense[columns] = 0
            out.append(bound)
        return out


class _Best:
    """The highest scores of one item so far; equal scores by ascending id."""

    def __init__(self, most: int) -> None:
        self.most, self.least = most, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        scores = np.concatenate([self.scores, scores[good]])
        ids = np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[:self.most]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.most:
            self.least = int(self.scores[-1])


def search(tree: BallTree, items: Items, width: int, best: list[_Best]) -> None:
    """Best-first search of every item; a node that can't reach the least score kept is left out."""
    bounds = np.array(tree.bounds(items, np.zeros(width)))
    asked = np.zeros(width, np.int64)
    for i, kept in enumerate(best):
        own = items.terms[items.first[i]:items.first[i + 1]]
        if not len(own):
            continue
        asked[own] = 1
        bound = bounds[:, i].tolist()
        heap = [(-bound[0], 0)]
        while heap:
            high, node = heapq.heappop(heap)
            if -high < kept.least:
                break
            rows = tree.rows[node]
            if rows is not None:
                kept.add(rows.dot(asked), rows.ids)
                continue
            for child in tree.children[node]:
                if bound[child] >= kept.least:
                    heapq.heappush(heap, (-bound[child], child))
        asked[own] = 0


def _shards(batches, rows: int):
    """Tables of about ``rows`` rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _vectors(table: pa.Table, weight: np.ndarray, documents: int, terms: int) -> _Vectors:
    """Vectors of a shard without zero values; rows without any value are left out."""
    lists = table["terms"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    columns = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    tf = table["tf"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = table["n"].combine_chunks().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    values = weight[columns] * damped(tf, n[row], documents, terms)
    good = values > 0
    row, columns, values = row[good], columns[good], values[good]
    sizes = np.bincount(row, minlength=len(sizes))
    some = sizes > 0
    ids = pc.fill_null(table["doc_id"].combine_chunks(), _LAST).to_numpy(zero_copy_only=False)
    return _Vectors(ids[some], columns, values, np.concatenate([[0], np.cumsum(sizes[some])]))


def _block(docs: DataFrame, names: list, texts: list, best: int, shard: int, leaf: int) -> DataFrame | None:
    """The best documents of one block of items, or None if it has no term in any document."""
    spark = docs.sparkSession
    items = Items.of(texts)
    vocabulary = spark.sparkContext.broadcast(items.vocabulary)

    def count(batches):
        for table in text.slices(batches):
            yield _counts(table, vocabulary.value)

    counts = cut_lineage(docs.mapInArrow(count, COUNTS))
    documents, total = counts.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    frequency = np.zeros(len(items.vocabulary), np.int64)
    # one row per term of the block
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[row["term"]] = row["count"]
    sent = spark.sparkContext.broadcast(
        (weights(documents, frequency), items.terms, items.first))

    def find(batches):
        weight, terms, first = sent.value
        own, width = Items(None, terms, first), len(weight)
        found = [_Best(best) for _ in range(len(first) - 1)]
        for table in _shards(batches, shard):
            rows = _vectors(table, weight, documents, total)
            for lo in range(0, len(rows.ids), shard):
                part = rows.take(np.arange(lo, min(lo + shard, len(rows.ids))))
                search(BallTree(part, width, leaf), own, width, found)
        item = np.repeat(np.arange(len(found)), [len(b.ids) for b in found])
        ids = np.concatenate([b.ids for b in found] or [np.zeros(0, np.int64)])
        scores = np.concatenate([b.scores for b in found] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([
            pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=ids == _LAST),
            pa.array(scores, pa.int64())], schema=_FOUND)

    def top(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("rank", rank).where(F.col("rank") <= best)

    part = F.pmod(F.spark_partition_id(), F.lit(_GROUPS)).alias("part")
    found = counts.where(F.size("terms") > 0).mapInArrow(find, FOUND)
    first = top(found.select("*", part), ["item", "part"])
    ranked = top(first.drop("part", "rank"), ["item"])
    named = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")


def ranked(
    docs: DataFrame, items: DataFrame, best: int = BEST, shard: int = SHARD, leaf: int = LEAF,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``best`` highest-scoring documents of each item.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"),
                         F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        # a block holds block_bytes of items on average, so this collect is bounded
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy(
            "item_id", "text").collect()
        found = _block(docs, [r["item_id"] for r in own], [r["text"] for r in own], best, shard, leaf
                       ) if own else None
        out = out if found is None else out.union(found)
    return out
