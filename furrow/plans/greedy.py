"""Greedy choice in rank order over a conflict graph, tile by tile."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.plans.graph import components
from furrow.plans.session import cut_lineage
from furrow.plans.skew import carry, ordinal

# edges a tile may hold
TILE = 200_000

# turns a task serves in a round, and the length of a list for each turn on it
TURNS = 50_000
AHEAD = 16

SOLVED = "node long, kept boolean, other long, same boolean"
_SOLVED = pa.schema([("node", pa.int64()), ("kept", pa.bool_()), ("other", pa.int64()),
                     ("same", pa.bool_())])


def settle(edges: Sequence[tuple[int, int | None, bool]]) -> Iterator[tuple]:
    """What one tile can say about its nodes, as (node, kept, other, same).

    An edge (node, other, same) stands for the statement "``other`` is kept" if
    ``same``, else for its opposite; ``other`` None is a statement that holds if
    ``same``.  A node is kept if none of its statements holds.  All edges of a
    node are given, and of two nodes the one with the smaller number is settled
    first.  Nodes that depend on nodes elsewhere come back with what remains of
    their statements; a node with a single one is replaced by it in the others.
    """
    statements = defaultdict(list)
    for node, other, same in edges:
        statements[node].append((other, same))
    known: dict[int, bool | tuple[int, bool]] = {}
    for node in sorted(statements):
        rest: set[tuple[int, bool]] = set()
        holds = False
        for other, same in statements[node]:
            value = True if other is None else known.get(other, (other, True))
            if isinstance(value, tuple):
                value = (value[0], value[1] == same)
                holds |= (value[0], not value[1]) in rest
                rest.add(value)
            else:
                holds |= value == same
            if holds:
                break
        if holds or not rest:
            known[node] = not holds
            yield node, not holds, None, None
            continue
        if len(rest) == 1:
            (other, same), = rest
            known[node] = (other, not same)
        else:
            known[node] = (node, True)
        for other, same in rest:
            yield node, None, other, same


def resolved(statements: DataFrame, near: Sequence[str], tile: int = TILE) -> DataFrame:
    """``node`` and ``kept`` of every node with statements (node, other, same).

    A node is kept if none of its statements holds: "``other`` is kept" if
    ``same``, its opposite if not.  Others have smaller numbers than the node and
    are kept if they have no statement of their own.  The columns ``near`` are the
    same in all statements of a node, and their order brings neighbours together.

    Statements are cut into tiles along ``near``.  Inside a tile nodes are settled
    one by one in a single pass; a chain that enters from another tile shrinks to
    one statement about the node it starts from.  Nodes that no one else refers to
    are set aside, so a chain over many tiles is a chain of as many nodes in the
    next round, and the number of rounds grows with the logarithm of its length to
    the base of a tile.  No connected set has to fit into a task.
    """
    spark = statements.sparkSession
    given = statements.select(*near, "node", "other", "same")
    follows = given.select(F.col("node").alias("other"), F.lit(True).alias("follows")).distinct()
    open_edges = cut_lineage(given.join(follows, "other", "left").select(
        *near, "node", F.when(F.col("follows"), F.col("other")).alias("other"), "same"))

    def solve(batches):
        rows = []
        for batch in batches:
            rows += zip(*[batch.column(c).to_pylist() for c in ("node", "other", "same")])
        found = list(zip(*settle(rows))) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(found, _SOLVED)], schema=_SOLVED)

    settled = spark.createDataFrame([], "node long, kept boolean")
    aside: list[DataFrame] = []
    while True:
        size = open_edges.count()
        if not size:
            break
        tiles = open_edges.repartitionByRange(-(-size // tile), *near, "node")
        where = open_edges.select("node", *near).distinct()
        solved = cut_lineage(tiles.select("node", "other", "same").mapInArrow(solve, SOLVED))
        done = solved.where("kept IS NOT NULL").select("node", "kept")
        settled = settled.union(done)
        left = solved.where("kept IS NULL")
        if left.isEmpty():
            break
        asked = left.select(F.col("other").alias("node")).distinct()
        aside.append(left.join(asked, "node", "left_anti").select("node", "other", "same"))
        known = done.select(F.col("node").alias("other"), F.col("kept").alias("fact"))
        # a fact about the other node makes the statement one that holds or not
        active = left.join(asked, "node", "left_semi").join(known, "other", "left").join(where, "node")
        fact = F.col("fact") == F.col("same")
        open_edges = cut_lineage(active.select(
            *near, "node", F.when(F.col("fact").isNull(), F.col("other")).alias("other"),
            F.when(F.col("fact").isNull(), F.col("same")).otherwise(fact).alias("same")))
    for rest in reversed(aside):
        facts = rest.join(settled.select(F.col("node").alias("other"), F.col("kept").alias("fact")), "other")
        late = facts.groupBy("node").agg((~F.max(F.col("fact") == F.col("same"))).alias("kept"))
        settled = cut_lineage(settled.union(late))
    return settled


def dropped(edges: DataFrame, near: Sequence[str], tile: int = TILE) -> DataFrame:
    """``node`` of every node that a kept one of smaller number excludes.

    ``edges`` holds (better, worse), better < worse, and the columns ``near`` of
    the worse one.  A node is kept if no kept node excludes it.
    """
    found = resolved(edges.select(*near, F.col("worse").alias("node"), F.col("better").alias("other"),
                                  F.lit(True).alias("same")), near, tile)
    return found.where(~F.col("kept")).select("node")


def serial_choice(
    offers: DataFrame, who: str, what: str, order: Sequence[str], near: Sequence[str], tile: int = TILE,
) -> DataFrame:
    """Offers (``who``, ``what``) taken one after the other in ``order``, each side once.

    An offer is taken if neither of its sides stands in an offer taken before it.
    With offers of one ``who`` next to each other in the order this is the choice
    of everyone in turn among what is still free.  An offer knows whether its side
    is free from the offer of that side before it, so there are five statements
    for each offer, however many share a side; ``order`` must be total.
    """
    placed = cut_lineage(ordinal(offers, order, name="_n"))
    chained = carry(placed.withColumn("_own", F.col("_n")), [who], "_n", previous={"_who": "_own"})
    chained = cut_lineage(carry(chained, [what], "_n", previous={"_what": "_own"}))
    # three nodes for each offer: who is free, what is free, the offer is taken
    number = lambda c, kind: F.col(c) * 3 + kind
    statement = lambda node, other, same, given: F.when(
        F.col(given).isNotNull(), F.struct(node.alias("node"), other.alias("other"), F.lit(same).alias("same")))
    rows = []
    for kind, before in ((0, "_who"), (1, "_what")):
        rows += [statement(number("_n", 2), number("_n", kind), False, before),
                 statement(number("_n", kind), number(before, kind), False, before),
                 statement(number("_n", kind), number(before, 2), True, before)]
    told = chained.withColumn("_s", F.explode(F.array_compact(F.array(*rows)))).select(*near, "_s.*")
    lost = resolved(told, near, tile).where("NOT kept AND node % 3 = 2").select(
        F.expr("node div 3").alias("_n"))
    return placed.join(lost, "_n", "left_anti").drop("_n")


SERVED = "_group long, _at long, who long, zone long, what long"
_SERVED = pa.schema([(c, pa.int64()) for c in ("_group", "_at", "who", "zone", "what")])


def serve(turns: pa.Table, lists: pa.Table) -> pa.Table:
    """The turns of one part in order, each with the first of its zone's list that is free, or null.

    A list only gets shorter from its head, so a zone needs no more than a place
    in it.  Stops at a turn that finds the end of a list marked as ``cut``.
    """
    lists = lists.sort_by([("zone", "ascending"), ("_k", "ascending")])
    zones, starts = np.unique(lists["zone"].to_numpy(), return_index=True)
    what, cut = lists["what"].to_numpy(), lists["cut"].to_numpy(zero_copy_only=False)
    ends = np.append(starts[1:], len(what))
    place = {z: [a, b] for z, a, b in zip(zones.tolist(), starts.tolist(), ends.tolist())}
    turns = turns.sort_by("_at")
    taken, served, found = set(), set(), []
    for who, zone, out in zip(*[turns[c].to_pylist() for c in ("who", "zone", "out")]):
        spot = place.get(zone)
        if out or who in served or spot is None:
            found.append(None)
            continue
        at, end = spot
        while at < end and (first := int(what[at])) in taken:
            at += 1
        spot[0] = at
        if at < end:
            taken.add(first)
            served.add(who)
            found.append(first)
        elif cut[end - 1]:
            break
        else:
            found.append(None)
    done = turns.slice(0, len(found))
    return pa.table([*[done[c] for c in _SERVED.names[:-1]], pa.array(found, pa.int64())], schema=_SERVED)


def queue_choice(
    turns: DataFrame, lists: DataFrame, turn: Sequence[str], order: Sequence[str],
    batch: int = TURNS, ahead: int = AHEAD,
) -> DataFrame:
    """(who, zone, what) taken one after the other, each side once.

    ``turns`` (who, zone) come in the order ``turn``; each takes the first
    ``what`` of its zone's list that is free, in ``order``.  Numbers are longs,
    and a ``what`` stands once in a list.  Turns of one zone share its list, so
    the rows are turns and lists, not every offer to every turn.

    Zones that share a ``what`` or a ``who`` are served together, others side by
    side.  A round serves at most ``batch`` turns of a part, with as much of the
    lists as these are likely to use; it ends early at a turn that needs more,
    so neither long lists nor a large connected set have to fit into a task.
    """
    links = lambda df, by: df.join(df.groupBy(by).agg(F.min("zone").alias("b")), by).where("zone <> b").select(
        F.col("zone").alias("a"), "b").distinct()
    lists = cut_lineage(lists.select("zone", "what", *order))
    rooted = components(links(lists, "what").union(links(turns, "who")))
    size = F.greatest(F.lit(1), F.ceil(turns.select(F.count("*")).scalar() / batch))
    part = F.pmod(F.xxhash64(F.coalesce("root", "zone")), size).cast("long")
    queued = turns.join(rooted.withColumnRenamed("node", "zone"), "zone", "left").withColumn("_group", part)
    queued = cut_lineage(ordinal(queued.drop("root"), ["_group", *turn], ["_group"], "_at").select(
        "_group", "_at", "who", "zone", F.lit(False).alias("out")))
    taken = []
    while True:
        first = queued.groupBy("_group").agg(F.min("_at").alias("_first"))
        now = cut_lineage(queued.join(first, "_group").where(F.col("_at") < F.col("_first") + batch).drop("_first"))
        asked = now.groupBy("_group", "zone").agg((F.count("*") * ahead + 4 * ahead).alias("_most"))
        ranked = ordinal(lists.join(asked, "zone"), ["zone", *order], ["zone"], "_k")
        heads = ranked.where(F.col("_k") <= F.col("_most")).withColumn("cut", F.col("_k") == F.col("_most"))
        # the row at the limit only tells that there are more
        heads = heads.select("_group", "zone", "_k", "what", "cut")
        served = cut_lineage(now.groupBy("_group").cogroup(heads.groupBy("_group")).applyInArrow(serve, SERVED))
        got = served.where("what IS NOT NULL")
        taken.append(got.select("who", "zone", "what"))
        settled = served.groupBy("_group").agg(F.max("_at").alias("_last"))
        left = queued.join(settled, "_group").where(F.col("_at") > F.col("_last")).drop("_last")
        if left.isEmpty():
            break
        queued = cut_lineage(left.join(got.select("who", F.lit(True).alias("_new")), "who", "left").select(
            "_group", "_at", "who", "zone", F.coalesce("_new", "out").alias("out")))
        lists = cut_lineage(lists.join(got.select("what"), "what", "left_anti").join(
            queued.select("zone").distinct(), "zone", "left_semi"))
    return reduce(DataFrame.union, taken)
