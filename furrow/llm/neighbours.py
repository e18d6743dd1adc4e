"""Nearest neighbours by inner product, with a vantage-point tree per shard (operator 7).

The largest inner product is the smallest distance after one more component,
sqrt(M^2 - |v|^2) with M the largest norm, has been added to every vector (0 to
the query, which is scaled to length M).  That distance obeys the triangle
inequality, so a tree of vantage points prunes: a ball whose nearest point is
farther than the k-th best so far is left out.  ``slack`` relaxes the bound:
with 1 the search is exact, above 1 a ball must beat the best by that factor,
which visits fewer leaves and may miss neighbours.

Rows are dealt into shards of bounded size by a hash, queries into blocks; each
task builds the tree of one shard, keeps equal vectors once, and answers one
block of queries, all of them together at each node.  Block results are merged
by rank.  Scores are computed again in double precision on the original
vectors, term by term in order.

Defined cases: null, zero or non-finite vectors take no part, nor do rows
without an id; vectors of another length than the query's are no candidates;
rows that share the query's id are the query's own; repeated equal rows count
once; ties go to the smaller id; fewer candidates than asked for give fewer
rows; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 20
SLACK = 1.0
SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
LEAF = 256

RESULT = "query_id long, vec_id long, score double"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class VantageTree:
    """Distinct points by distance to vantage points; the median splits each ball."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points, leaf
        self.square = np.einsum("ij,ij->i", points, points)
        self.root = self._build(np.arange(len(points)))

    def _distance(self, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        gap = self.square[rows] - 2 * self.points[rows] @ centre + centre @ centre
        return np.sqrt(np.maximum(gap, 0))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # the point farthest from the first makes a good vantage point
        far = rows[int(np.argmax(self._distance(rows, self.points[rows[0]])))]
        distance = self._distance(rows, self.points[far])
        order = np.argsort(distance, kind="stable")
        half = len(rows) // 2
        near, rest = order[:half], order[half:]
        return (far, distance[near[-1]], distance[rest[0]], distance[rest[-1]],
                self._build(rows[near]), self._build(rows[rest]))


class Search:
    """A block of queries against one tree; the best k of each so far, by distance."""

    def __init__(self, tree: VantageTree, queries: np.ndarray, wanted: int, slack: float) -> None:
        self.tree, self.queries, self.wanted, self.slack = tree, queries, wanted, slack
        self.square = np.einsum("ij,ij->i", queries, queries)
        # squared distances carry rounding of this size, so ties at the edge are kept
        scale = max(self.square.max(initial=0), tree.square.max(initial=0))
        self.margin = 1e-9 * max(scale, 1e-300)
        n = len(queries)
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.best = np.full((n, wanted), np.inf)

    def run(self) -> None:
        self._visit(self.tree.root, np.arange(len(self.queries)))

    def _reach(self, own: np.ndarray) -> np.ndarray:
        return np.sqrt(self.best[own, -1] + self.margin) / self.slack

    def _visit(self, node, own: np.ndarray) -> None:
        if not len(own):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, own)
            return
        far, inner, gap, outer, near, rest = node
        centre = self.tree.points[far]
        distance = np.sqrt(np.maximum(
            self.square[own] - 2 * self.queries[own] @ centre + centre @ centre, 0))
        inside = distance <= (inner + gap) / 2
        for first in (True, False):
            self._visit(near if first else rest, own[inside == first])
        # the other side, where the ball of the k-th best still reaches it
        back, on = own[~inside], own[inside]
        self._visit(near, back[distance[~inside] - inner <= self._reach(back)])
        near_gap = gap - distance[inside]
        self._visit(rest, on[near_gap <= self._reach(on)])

    def _leaf(self, rows: np.ndarray, own: np.ndarray) -> None:
        gap = np.maximum(self.square[own][:, None] + self.tree.square[rows][None, :]
                         - 2 * self.queries[own] @ self.tree.points[rows].T, 0)
        limit = self.best[own, -1] + self.margin
        merged = np.concatenate([self.best[own], gap], axis=1)
        self.best[own] = np.partition(merged, self.wanted - 1, axis=1)[:, :self.wanted]
        self.best[own] = np.sort(self.best[own], axis=1)
        which, column = np.nonzero(gap <= np.minimum(limit, self.best[own, -1] + self.margin)[:, None])
        cuts = np.searchsorted(which, np.arange(len(own) + 1))
        for i, q in enumerate(own):
            if cuts[i + 1] > cuts[i]:
                c = column[cuts[i]:cuts[i + 1]]
                self.found[q].append((rows[c], gap[i, c]))

    def candidates(self, q: int) -> np.ndarray:
        if not self.found[q]:
            return np.zeros(0, np.int64)
        rows = np.concatenate([r for r, _ in self.found[q]])
        gap = np.concatenate([g for _, g in self.found[q]])
        return rows[gap <= self.best[q, -1] + self.margin]


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.add.accumulate(vectors * query, axis=1)[:, -1]


def _augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(most * most - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.concatenate([vectors, extra[:, None]], axis=1)


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["vector"].combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def search_shard(
    queries: pa.Table, shard: pa.Table, top: int, slack: float, most: float, leaf: int = LEAF,
) -> pa.Table:
    """The best ``top`` candidates of one shard for each query of one block."""
    if not queries.num_rows or not shard.num_rows:
        return _SCHEMA.empty_table()
    vectors, ids = _matrix(shard), np.asarray(shard["vec_id"].combine_chunks(), np.int64)
    distinct, inverse = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, inverse.ravel()))
    cuts = np.searchsorted(inverse.ravel()[order], np.arange(len(distinct) + 1))
    # of equal vectors the smallest top + 1 ids are enough: one may be the query's own
    members = [np.unique(ids[order[a:b]])[:top + 1] for a, b in zip(cuts[:-1], cuts[1:])]
    asked, query_ids = _matrix(queries), np.asarray(queries["vec_id"].combine_chunks(), np.int64)
    length = np.sqrt(np.einsum("ij,ij->i", asked, asked))
    scaled = np.concatenate([asked * (most / length)[:, None], np.zeros((len(asked), 1))], axis=1)
    # own vector aside, top distinct points hold the top candidates
    search = Search(VantageTree(_augmented(distinct, most), leaf), scaled, top + 1, slack)
    search.run()
    out_query, out_id, out_score = [], [], []
    for q in range(len(asked)):
        points = search.candidates(q)
        if not len(points):
            continue
        score = exact_scores(asked[q], distinct[points])
        names = np.concatenate([members[p] for p in points])
        values = np.repeat(score, [len(members[p]) for p in points])
        other = names != query_ids[q]
        names, values = names[other], values[other]
        chosen = np.lexsort((names, -values))[:top]
        out_query.append(np.full(len(chosen), query_ids[q]))
        out_id.append(names[chosen])
        out_score.append(values[chosen])
    return pa.table({"query_id": np.concatenate([*out_query, np.zeros(0, np.int64)]),
                     "vec_id": np.concatenate([*out_id, np.zeros(0, np.int64)]),
                     "score": np.concatenate([*out_score, np.zeros(0)])}, schema=_SCHEMA)


def nearest(
    vectors: DataFrame, is_query: Column, top: int = TOP, slack: float = SLACK,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the ``top`` largest inner products.

    Takes vec_id and embedding; ``is_query`` says which rows are queries.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (
        F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(
            "embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("asks"),
                       F.col("embedding").cast("array<double>").alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    total, asked, most = rows.agg(F.count("*"), F.count_if(F.col("asks")), F.max(norm)).first()
    shards, blocks = max(1, math.ceil(total / shard_rows)), max(1, math.ceil((asked or 0) / block_rows))
    rows = rows.withColumn("dims", F.size("vector"))
    # every block of queries meets every shard: both grow with the data, one task holds one of each
    stored = rows.select(
        "vec_id", "vector", "dims", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = rows.where("asks").select(
        "vec_id", "vector", "dims",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    keys = ["dims", "shard", "block"]

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_shard(left, right, top, slack, most)

    found = queries.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(answer, RESULT)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
