"""Similarity join of documents on word shingles, by a prefix tree (operator 5).

Two documents link when the Jaccard similarity of their sets of distinct
five-word shingles reaches the threshold.  Sets are ordered globally, rare
shingles first, so that two linked sets share a shingle within a short prefix:

1. each chunk of documents asks for the document frequency of its distinct
   shingles (``exchange``); a set whose rare end holds too many shingles that
   occur nowhere else links with nothing and is settled there;
2. equal sets collapse to one class, so copies cost one row;
3. classes that share a shingle of their prefixes fall into one candidate
   cluster (``components``; no pairs are formed);
4. within a cluster the ordered sets go into a prefix tree.  A probe walks it
   with the overlap counted so far, shared by all sets below a node, and leaves
   a subtree when the lengths that remain can't reach the threshold, or when
   all of it is already linked with the probe;
5. a cluster larger than a block is dealt into blocks.  Blocks are joined
   alone, then the linked groups that remain by one representative each, and
   whatever is still apart block against block: no link between different
   texts is lost, and a group of near copies stays near linear.

Shingles are 64-bit fingerprints, classes 128-bit sums of them.

Defined cases: null, empty or blank text has no shingles and links with
nothing; fewer than five words make one shingle of the whole sequence; a null
doc_id stays null unless its class links it to a smaller id; repeated rows and
rows with one doc_id are judged by their own text; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import exchange, text
from furrow.plans.graph import components
from furrow.llm.text import U64
from furrow.plans.session import cut_lineage

SHINGLE = 5
THRESHOLD = 75  # per cent
BLOCK = 1024

_SEED = 21
_PIECE = 48

SETS = ("doc_id long, n_shingles long, class binary, prefix array<long>, "
        "tokens binary")
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()),
                   ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])
_LINKS = "a binary, b binary"
_LINK_SCHEMA = pa.schema([("a", pa.binary()), ("b", pa.binary())])


class _Sets:
    """Distinct shingles of a chunk's documents, in the order of their fingerprints."""

    def __init__(self, table: pa.Table, size: int, bits: int) -> None:
        data, offsets = text.text_bytes(table["text"])
        data = text.LOWER[data]
        starts, ends, first = text.word_spans(data, offsets)
        words = text.word_hashes(data, starts, ends, _SEED)
        at, doc = text.window_starts(first, size)
        values = text.rolling(words, size)[at] if len(at) else np.zeros(0, U64)
        counts = np.diff(first)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            whole = [text.rolling(words[first[i]:first[i + 1]], int(counts[i]))[0] for i in short]
            values = np.concatenate([values, text.mix(np.array(whole, U64)
                                                      + counts[short].astype(U64))])
            doc = np.concatenate([doc, short])
        # equal values keep the order they come in, so those of one document lie together
        order = text.ascending(values)
        values, doc = values[order], doc[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
        self.values, self.doc = values[new], doc[new]
        self.sizes = np.bincount(self.doc, minlength=table.num_rows)
        short_ids = self.values >> U64(32 - bits)
        first_of = np.ones(len(short_ids), bool)
        first_of[1:] = short_ids[1:] != short_ids[:-1]
        self.asked = short_ids[first_of]
        self.group = np.cumsum(first_of) - 1

    def questions(self, chunk: int, bits: int) -> pa.Table:
        counts = np.minimum(np.bincount(self.group, minlength=len(self.asked)), 0xFFFF)
        return exchange.questions(chunk, self.asked, bits, [counts.astype(np.uint16)])


def _frequency_class(table: pa.Table) -> pa.Table:
    """A byte for each shingle's document frequency: 1 if it stands in one document only."""
    keys = [text.unpack_sorted(raw, np.uint32) for raw in table["keys"].to_pylist()]
    counts = np.concatenate([text.from_planes(raw, np.uint16) for raw in table["extra"].to_pylist()])
    asked = np.concatenate(keys)
    order = text.ascending(asked.astype(U64) << U64(32))
    new = np.ones(len(asked), bool)
    new[1:] = asked[order[1:]] != asked[order[:-1]]
    first = np.flatnonzero(new)
    frequency = np.add.reduceat(counts[order], first, dtype=np.int64)
    level = np.where(frequency < 128, frequency, 100 + 4 * np.log2(np.maximum(frequency, 1)))
    found = np.empty(len(asked), np.uint8)
    found[order] = np.repeat(np.minimum(level, 255).astype(np.uint8), np.diff(first, append=len(asked)))
    return exchange.answers(table, [len(k) for k in keys], found)


def _signatures(sets: _Sets, n: int) -> np.ndarray:
    """128 bits for each document's set."""
    out = np.zeros((n, 2), U64)
    for k, seed in enumerate((0x51, 0x7F)):
        np.add.at(out[:, k], sets.doc, text.mix(sets.values ^ U64(seed)))
    return out


def _ordered_sets(table: pa.Table, answers: pa.Table, size: int, bits: int, percent: int) -> pa.Table:
    """Per document its class and, where it may have a partner, its shared shingles in order."""
    sets = _Sets(table, size, bits)
    level = exchange.gathered(answers, np.uint8)[sets.group]
    n = sets.sizes
    shared = level > 1
    open_doc = (n > 0) & (100 * np.bincount(sets.doc[shared], minlength=len(n)) >= percent * n)
    keep = shared & open_doc[sets.doc]
    doc, value, rank = sets.doc[keep], sets.values[keep], level[keep]
    # values ascend already; of documents and ranks up to 16 bits the order is found by counting
    order = np.argsort(rank, kind="stable")
    order = order[np.argsort(doc[order].astype(np.min_scalar_type(len(n))), kind="stable")]
    doc, value = doc[order], value[order]
    cuts = np.searchsorted(doc, np.arange(len(n) + 1))
    signature = _signatures(sets, len(n))
    single = n - np.bincount(sets.doc[shared], minlength=len(n))
    prefix, tokens = [], []
    for i in range(len(n)):
        if not open_doc[i]:
            prefix.append(None)
            tokens.append(None)
            continue
        own = value[cuts[i]:cuts[i + 1]]
        first = n[i] - -(-percent * n[i] // 100) + 1 - single[i]
        prefix.append(own[:max(first, 0)].view(np.int64))
        tokens.append(own.tobytes())
    return pa.table({
        "doc_id": table["doc_id"].combine_chunks(), "n_shingles": pa.array(n, pa.int64()),
        "class": pa.array([signature[i].tobytes() for i in range(len(n))], pa.binary()),
        "prefix": pa.array(prefix, pa.list_(pa.int64())), "tokens": pa.array(tokens, pa.binary()),
    }, schema=_SETS)


class _Node:
    """Tree node: the tokens on the edge into it and bounds over the sets below."""

    __slots__ = ("edge", "children", "longest", "least", "sets", "group")

    def __init__(self, edge: list[int]) -> None:
        self.edge = edge
        self.children: dict[int, _Node] = {}
        self.longest = 0  # tokens below the end of the edge, at most
        self.least = 1 << 62  # size of the smallest set at or below
        self.sets: list[int] = []
        self.group = -1  # a set at or below, if all of these are linked, else -2


class PrefixTree:
    """Ordered sets with shared beginnings; finds links of a probe and joins the groups."""

    def __init__(self, percent: int) -> None:
        self.percent, self.root = percent, _Node([])
        self.parent: list[int] = []
        self.size: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _settled(self, node: _Node) -> int:
        """Root of the group that holds the whole subtree, or -2."""
        return self.find(node.group) if node.group >= 0 else node.group

    def add(
        self, tokens: list[int], size: int, apart: int | None = None, probe: bool = True, insert: bool = True,
    ) -> None:
        """Links the set with those in the tree, then inserts it; either may be left out.

        ``apart`` is the number of a set it is known to be linked with.
        """
        number = len(self.parent)
        self.parent.append(number)
        self.size.append(size)
        if apart is not None:
            self.parent[number] = self.find(apart)
        if probe:
            self._probe(frozenset(tokens), size, number)
        if insert:
            self._insert(tokens, size, number)

    def _probe(self, own: frozenset[int], size: int, number: int) -> None:
        percent = self.percent
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if self._settled(node) == self.find(number):
                continue
            edge, longest, least = node.edge, node.longest, node.least
            need = -(-percent * (size + least) // (100 + percent))
            left, dead = len(edge), False
            for lo in range(0, len(edge), _PIECE):
                piece = edge[lo:lo + _PIECE]
                left -= len(piece)
                overlap += len(own.intersection(piece))
                if overlap + min(left + longest, len(own) - overlap) < need:
                    dead = True
                    break
            if dead:
                continue
            for other in node.sets:
                if (100 + percent) * overlap >= percent * (size + self.size[other]):
                    self.parent[self.find(other)] = self.find(number)
            stack.extend((child, overlap) for child in node.children.values())

    def _insert(self, tokens: list[int], size: int, number: int) -> None:
        node, at, path = self.root, 0, []
        while True:
            path.append((node, at))
            if at == len(tokens):
                break
            child = node.children.get(tokens[at])
            if child is None:
                child = _Node(tokens[at:])
                node.children[tokens[at]] = child
                node, at = child, len(tokens)
                path.append((node, at))
                break
            edge, k = child.edge, 0
            limit = min(len(edge), len(tokens) - at)
            while k < limit and edge[k] == tokens[at + k]:
                k += 1
            if k < len(edge):
                upper = _Node(edge[:k])
                child.edge = edge[k:]
                upper.children[edge[k]] = child
                upper.longest = child.longest + len(edge) - k
                upper.least, upper.group = child.least, child.group
                node.children[tokens[at]] = upper
                child = upper
            node, at = child, at + k
        node.sets.append(number)
        for node, at in path:
            node.longest = max(node.longest, len(tokens) - at)
            node.least = min(node.least, size)
            if node.group == -1:
                node.group = number
            elif node.group >= 0 and self.find(node.group) != self.find(number):
                node.group = -2
        return

    def links(self) -> list[tuple[int, int]]:
        return [(i, r) for i in range(len(self.parent)) if (r := self.find(i)) != i]


def _tree_links(table: pa.Table, percent: int) -> pa.Table:
    """Spanning links of one group of classes; ``linked`` names a group that is already known.

    With ``home``, the classes come from two blocks that are joined already: those
    at home go into the tree, the others only ask it.
    """
    names, sizes = table["class"].to_pylist(), table["n_shingles"].to_pylist()
    known = table["linked"].to_pylist() if "linked" in table.column_names else [None] * len(names)
    across = "home" in table.column_names
    home = table["home"].to_pylist() if across else [True] * len(names)
    order = sorted(range(len(names)), key=lambda i: (not home[i], sizes[i], names[i]))
    sets = {}
    for i in order:
        sets[i] = np.frombuffer(table["tokens"][i].as_buffer(), np.int64).tolist()
    tree, seen, numbers = PrefixTree(percent), {}, []
    for i in order:
        group = known[i]
        tree.add(sets[i], sizes[i], seen.get(group) if group is not None else None,
                 probe=not (across and home[i]), insert=home[i])
        if group is not None:
            seen.setdefault(group, len(numbers))
        numbers.append(names[i])
    pairs = tree.links()
    return pa.table({"a": pa.array([numbers[a] for a, _ in pairs], pa.binary()),
                     "b": pa.array([numbers[b] for _, b in pairs], pa.binary())},
                    schema=_LINK_SCHEMA)


def _cluster_links(clustered: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) that connect exactly the classes connected by similarity."""

    def join(table: pa.Table) -> pa.Table:
        return _tree_links(table, percent)

    members = clustered.select("class", "cluster")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("members"))
    # only names are joined on the cluster, which leaves a large one in one task; their sets follow by class
    placed = cut_lineage(members.join(sizes, "cluster").select(
        "class", "cluster", F.ceil(F.col("members") / block).cast("long").alias("blocks")).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks"))))
    columns = ["class", "n_shingles", "tokens"]
    sets = clustered.select(*columns)
    inside = sets.join(placed, "class").repartition("cluster", "block").groupBy(
        "cluster", "block").applyInArrow(join, _LINKS)
    several = placed.where("blocks > 1")
    if several.isEmpty():
        return inside
    inside, large = cut_lineage(inside), cut_lineage(sets.join(several, "class"))

    def grouped(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links as stars, which the next call goes on from, and the large clusters by star."""
        stars = components(links).select(F.col("node").alias("a"), F.col("root").alias("b"))
        named = stars.select(F.col("a").alias("class"), F.col("b").alias("linked"))
        return stars, large.join(named, "class", "left").withColumn(
            "linked", F.coalesce("linked", "class"))

    # one representative of each linked group, again in blocks
    stars, first = grouped(inside)
    heads = first.where(F.col("class") == F.col("linked"))
    bound = heads.groupBy("cluster").agg(
        F.ceil(F.count("*") / block).cast("long").alias("parts"))
    across = cut_lineage(heads.join(bound, "cluster").withColumn(
        "part", F.pmod(F.xxhash64("class", F.lit(1)), F.col("parts"))).select(
        "cluster", "part", *columns).groupBy("cluster", "part").applyInArrow(join, _LINKS))
    # what is still apart: every pair of blocks of a cluster that holds several groups
    stars, second = grouped(stars.union(across))
    apart = second.groupBy("cluster").agg(
        F.min("linked").alias("lo"), F.max("linked").alias("hi")).where("lo <> hi").select("cluster")
    rest = second.join(apart, "cluster").withColumn("other", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        "linked", (F.col("block") < F.col("other")).alias("home"), *columns).where("lo <> hi")
    return stars.union(rest.groupBy("cluster", "lo", "hi").applyInArrow(join, _LINKS))


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = THRESHOLD, block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links, own included.

    Links join documents whose shingle sets have a Jaccard similarity of at
    least ``percent`` per cent.
    """
    deal = exchange.deal(docs)
    chunks = exchange.in_chunks(docs, deal)

    def ask(table: pa.Table) -> pa.Table:
        return _Sets(table, size, deal.bits).questions(table["chunk"][0].as_py(), deal.bits)

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        return _ordered_sets(left, right, size, deal.bits, percent)

    frequencies = chunks.groupBy("chunk").applyInArrow(ask, exchange.ASK).groupBy(
        "bucket").applyInArrow(_frequency_class, exchange.ANSWER)
    sets = cut_lineage(chunks.groupBy("chunk").cogroup(frequencies.groupBy("chunk")).applyInArrow(
        order, SETS))
    classes = sets.where("tokens IS NOT NULL").groupBy("class", "n_shingles").agg(
        F.min("doc_id").alias("least"), F.first("prefix").alias("prefix"),
        F.first("tokens").alias("tokens"))
    classes = cut_lineage(classes)
    entries = classes.select("class", F.explode("prefix").alias("token"))
    least = entries.groupBy("token").agg(F.min("class").alias("b"), F.count("*").alias("n")).where(
        "n > 1").drop("n")
    edges = entries.join(least, "token").select(F.col("class").alias("a"), "b").where("a <> b")
    clusters = components(edges)
    named = clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    named = cut_lineage(named.union(named.select(F.col("cluster").alias("class"), "cluster").distinct()))
    clustered = classes.drop("prefix").join(named, "class")
    linked = components(_cluster_links(clustered, percent, block)).select(
        F.col("node").alias("class"), F.col("root"))
    rooted = sets.select("doc_id", "n_shingles", "class").join(linked, "class", "left").withColumn(
        "root", F.coalesce("root", "class"))
    reach = rooted.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(reach, "root", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias(
            "component_id"))
