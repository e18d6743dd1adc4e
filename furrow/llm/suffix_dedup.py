"""Repeated byte strings, by induced sorting of sampled suffixes (operator 8).

A byte goes when a string of 200 bytes that covers it starts anywhere else too.

Sample: the anchor of a 200-byte window is its 64-byte substring of smallest
fingerprint, so equal windows have equal anchors at equal places.  One position
in about seventy is an anchor.  Chunks ask how often each anchor occurs
(``exchange``); a window whose anchor is alone has no copy.

Sorting: the windows of an anchor that recurs travel, as one run of text, to
the bucket of the anchor.  A bucket sorts the sampled suffixes, those that
begin at the anchors, with their longest common prefixes.  The order of the
suffixes one byte further left is induced from it by a stable sort on that one
byte, and so on; the common-prefix value of two neighbours is carried along as
the steps taken plus the minimum over the range between them in the sampled
order.  A window has a copy exactly if a neighbour's value reaches 200.

Shards larger than memory: the tuples are cut into buckets by anchor, their
number grows with the text, and Spark's shuffle keeps them on disk and brings
them bucket by bucket; equal runs of a chunk go once.  No deeper recursion is
needed because no comparison goes beyond 200 bytes.  An anchor with more than
``HOT`` runs could still outgrow its bucket, so its windows go one by one, those
equal in a chunk once, to buckets of their own fingerprints: only equal windows
meet there, and no more of them than there are chunks.  They are compared by 96
and more bits, as the runs of a chunk are.

Defined cases: null text counts as empty; texts shorter than a window stay
whole; copies inside one document count, also overlapping ones; repeated rows
and rows with one doc_id are copies of each other; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import exchange, text
from furrow.llm.text import U64

WINDOW = 200
HOT = 1 << 14

_SEEDS = (text.byte_table(31), text.byte_table(32))
_SLICE = 1 << 19
_PLACE = U64((1 << 20) - 1)

RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
          "kept binary, spans array<struct<start:long,end:long>>")


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    if done < width:
        values = np.minimum(values[:len(values) - (width - done)], values[width - done:])
    return values


class _Chunk:
    """Windows of a chunk's documents, in runs that share one anchor."""

    def __init__(self, table: pa.Table, window: int, bits: int) -> None:
        self.window, self.gram, self.bits = window, max(1, window * 64 // 200), bits
        self.data, self.offsets = text.text_bytes(table["text"])
        parts = [self._anchors(lo) for lo in range(0, len(self.data), _SLICE)]
        low, anchor, value, count = (np.concatenate(c) for c in zip(
            (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)),
            *parts))
        # a run that reaches into the next slice comes in two pieces
        new = np.ones(len(low), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        self.low, self.anchor = low[first], anchor[first]
        self.count = np.add.reduceat(count, first) if len(first) else count
        # anchors are minima, so their fingerprints are small: mixed again they spread evenly
        self.name = text.mix(value[first]) >> U64(32 - bits)
        self.asked, self.inverse = np.unique(self.name, return_inverse=True)

    def _anchors(self, lo: int) -> tuple[np.ndarray, ...]:
        """Runs of windows that start in one slice: first start, anchor, its fingerprint, length."""
        hi = min(lo + _SLICE, len(self.data))
        first, last = np.searchsorted(self.offsets, [lo, hi], "right")
        inside = np.zeros(hi - lo, bool)
        for a, b in zip(self.offsets[first - 1:last], self.offsets[first:last + 1]):
            inside[max(a - lo, 0):max(b - self.window + 1 - lo, 0)] = True
        own = np.flatnonzero(inside)
        grams = text.rolling(_SEEDS[0][self.data[lo:hi + self.window]], self.gram)
        if not len(own):
            return own, own, np.zeros(0, U64), own
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
        reach = self.window - self.gram + 1
        place = (_sliding_min(keys, reach)[own] & _PLACE).astype(np.int64)
        new = np.ones(len(own), bool)
        new[1:] = place[1:] != place[:-1]
        at = np.flatnonzero(new)
        return (own[at] + lo, place[at] + lo, grams[place[at]], np.diff(np.append(at, len(own))))

    def questions(self, chunk: int) -> pa.Table:
        counts = np.bincount(self.inverse, minlength=len(self.asked))
        return exchange.questions(chunk, self.asked, self.bits,
                                  [np.minimum(counts, 0xFFFF).astype(np.uint16)])

    def runs(self, levels: np.ndarray) -> None:
        """Distinct texts of the runs whose anchor recurs, ordered by anchor and content."""
        own = levels[self.inverse] > 0
        self.run_low, self.run_count = self.low[own], self.count[own]
        left = self.anchor[own] - self.run_low
        name = self.name[own]
        ends = self.run_low + self.run_count - 1 + self.window
        prints = [text.span_hashes(self.data, self.run_low, ends, seed) for seed in _SEEDS]
        shape = left * (self.window + 1) + self.run_count
        order = np.lexsort((prints[1], prints[0], shape, name))
        new = np.ones(len(order), bool)
        if len(order):
            same = np.ones(len(order) - 1, bool)
            for column in (name, shape, *prints):
                same &= column[order][1:] == column[order][:-1]
            new[1:] = ~same
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        first = order[new]
        self.names, self.lows, self.ends = name[first], self.run_low[first], ends[first]
        self.lefts, self.counts = left[first], self.run_count[first]
        self.many = np.bincount(self.group, minlength=len(first)) > 1
        self.hot = levels[self.inverse][own][first] > 1
        self._windows()

    def _windows(self) -> None:
        """Distinct windows of the runs with a hot anchor, ordered by fingerprint."""
        lows, counts = self.lows[self.hot], self.counts[self.hot]
        run = np.repeat(np.arange(len(lows)), counts)
        start = lows[run] + np.arange(len(run)) - (np.cumsum(counts) - counts)[run]
        place = np.argsort(start)
        start = start[place]
        prints = [text.span_hashes(self.data, start, start + self.window, seed) for seed in _SEEDS]
        name = prints[0] >> U64(32 - self.bits)
        order = np.lexsort((prints[1], name))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(name[order]) != 0) | (np.diff(prints[1][order]) != 0)
        first = order[new]
        self.window_names, self.window_prints = name[first], prints[1][first]
        # which of the distinct windows each window of a hot run is
        self.window_group = np.empty(len(order), np.int64)
        self.window_group[place[order]] = np.cumsum(new) - 1
        self.window_many = np.bincount(
            self.window_group, weights=1 + self.many[self.hot][run], minlength=len(first)) > 1

    def run_questions(self, chunk: int) -> pa.Table:
        """Runs to the buckets of their anchors, windows of hot anchors to those that follow."""
        cold = np.flatnonzero(~self.hot)
        names = self.names[cold]
        cuts = np.searchsorted(names, np.arange((1 << self.bits) + 1, dtype=U64) << U64(32))
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
        raw, spans = self.data.tobytes(), list(zip(self.lows[cold].tolist(), self.ends[cold].tolist()))
        low = (names & U64(0xFFFFFFFF)).astype(np.uint32)
        shape = np.stack([self.lefts, self.counts, self.many]).astype(np.uint8)[:, cold]
        runs = pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int64()),
            "chunk": pa.array([chunk] * len(rows), pa.int64()),
            "keys": pa.array([text.pack_sorted(low[lo:hi]) for _, lo, hi in rows], pa.binary()),
            "extra": pa.array([shape[:, lo:hi].tobytes() + b"".join(
                [raw[a:b] for a, b in spans[lo:hi]]) for _, lo, hi in rows], pa.binary()),
        }, schema=exchange._ASK)
        windows = exchange.questions(chunk, self.window_names, self.bits,
                                     [self.window_prints, self.window_many.astype(np.uint8)])
        return pa.concat_tables([runs, windows.set_column(
            0, "bucket", pc.add(windows["bucket"], 1 << self.bits))])

    def removed(self, answers: pa.Table) -> np.ndarray:
        """Bytes under a window that has a copy."""
        parts = []
        cold = ~self.hot
        cuts = np.searchsorted(self.names[cold], np.arange((1 << self.bits) + 1, dtype=U64) << U64(32))
        sizes = np.concatenate([[0], np.cumsum(self.counts[cold])])
        of_window = pc.greater_equal(answers["bucket"], 1 << self.bits)
        of_run = answers.filter(pc.invert(of_window))
        for bucket, raw in sorted(zip(of_run["bucket"].to_pylist(), of_run["answer"].to_pylist())):
            n = int(sizes[cuts[bucket + 1]] - sizes[cuts[bucket]])
            parts.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=n))
        windows = exchange.gathered(answers.filter(of_window), np.uint8)
        sizes = np.concatenate([[0], np.cumsum(self.counts)])
        found = np.zeros(int(sizes[-1]), np.uint8)
        hot = np.repeat(self.hot, self.counts)
        found[~hot] = np.concatenate([np.zeros(0, np.uint8), *parts])
        found[hot] = windows[self.window_group]
        total = int(self.run_count.sum())
        run = np.repeat(np.arange(len(self.run_count)), self.run_count)
        step = np.arange(total) - (np.cumsum(self.run_count) - self.run_count)[run]
        hit = found[sizes[self.group[run]] + step] > 0
        start = (self.run_low[run] + step)[hit]
        steps = np.zeros(len(self.data) + 1, np.int32)
        steps[start] += 1  # starts are distinct, and so are ends
        steps[start + self.window] -= 1
        return np.cumsum(steps[:-1]) > 0


def _recurring(hot: int):
    def find(table: pa.Table) -> pa.Table:
        """Which anchors of a bucket occur twice or more (1), and more than ``hot`` times (2)."""
        keys = [text.unpack_sorted(raw, np.uint32) for raw in table["keys"].to_pylist()]
        counts = np.concatenate([text.from_planes(raw, np.uint16) for raw in table["extra"].to_pylist()])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=counts)
        level = ((total > 1) * (1 + (total > hot))).astype(np.uint8)
        return exchange.answers(table, [len(k) for k in keys], level[inverse])

    return find


def _equal(table: pa.Table) -> pa.Table:
    """Which windows of a bucket occur twice or more."""
    keys = [text.unpack_sorted(raw, np.uint32) for raw in table["keys"].to_pylist()]
    sizes, extra = [len(k) for k in keys], table["extra"].to_pylist()
    prints = np.concatenate([text.from_planes(raw[:8 * n], U64) for raw, n in zip(extra, sizes)])
    many = np.frombuffer(b"".join([raw[8 * n:] for raw, n in zip(extra, sizes)]), np.uint8)
    keys = np.concatenate(keys)
    order = np.lexsort((prints, keys))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(prints[order]) != 0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    often = np.bincount(group, weights=1 + many) > 1
    return exchange.answers(table, sizes, often[group].astype(np.uint8))


class _RangeMinimum:
    """Minimum over any range of an array, from minima over powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over positions lo to hi - 1, with hi > lo."""
        out = np.empty(len(lo), self.levels[0].dtype)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            row = self.levels[k]
            out[own] = np.minimum(row[lo[own]], row[hi[own] - (1 << int(k))])
        return out


def induced_copies(
    runs: list[bytes], left: np.ndarray, count: np.ndarray, window: int,
) -> np.ndarray:
    """For each run and steps left of its anchor: whether that window also starts in another run.

    Run ``i`` has its anchor at byte ``left[i]`` and ``count[i]`` windows, the
    first at byte 0.  Returns a table of flags with a column per step.
    """
    m, deep = len(runs), int(left.max(initial=0))
    right = np.frombuffer(b"".join([r[a:a + window].ljust(window, b"\0")
                                    for r, a in zip(runs, left.tolist())]), np.uint8).reshape(m, window)
    before = np.frombuffer(b"".join([r[:a][::-1].ljust(deep, b"\0") for r, a in
                                     zip(runs, left.tolist())]), np.uint8).reshape(m, deep)
    order = np.argsort(right.view(f"S{window}").ravel(), kind="stable")
    common = np.empty(max(m - 1, 0), np.uint8)
    for lo in range(0, m - 1, 1 << 14):
        rows = right[order[lo:lo + (1 << 14) + 1]]
        differs = rows[1:] != rows[:-1]
        common[lo:lo + len(differs)] = np.where(
            differs.any(axis=1), differs.argmax(axis=1), min(window, 255))
    least = _RangeMinimum(common)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    flags = np.zeros((m, deep + 1), bool)
    same_left = np.zeros(m, np.int64)
    for step in range(deep + 1):
        if step:
            stay = left[order] >= step
            order, same_left = order[stay], same_left[stay]
            char = before[order, step - 1]
            induced = np.argsort(char, kind="stable")
            order, same_left, char = order[induced], same_left[induced], char[induced]
            new = np.zeros(len(order), np.int64)
            new[1:] = (char[1:] != char[:-1]) | (same_left[1:] != same_left[:-1])
            same_left = np.cumsum(new)
        valid = left[order] - step < count[order]
        own, prefix = order[valid], same_left[valid]
        pair = np.flatnonzero(prefix[1:] == prefix[:-1])
        if not len(pair):
            continue
        a, b = own[pair], own[pair + 1]
        equal = least.between(rank[a], rank[b]) >= min(window, 255) - step
        flags[a[equal], step] = True
        flags[b[equal], step] = True
    return flags


def _copies(window: int, bits: int):
    def find(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() >= 1 << bits:
            return _equal(table)
        runs, shapes, sizes = [], [], []
        for raw, extra in zip(table["keys"].to_pylist(), table["extra"].to_pylist()):
            n = len(raw) // 4
            shape = np.frombuffer(extra, np.uint8, 3 * n).reshape(3, n)
            ends = np.cumsum(shape[1].astype(np.int64) - 1 + window) + 3 * n
            runs += [extra[b - (c - 1 + window):b] for b, c in zip(ends.tolist(), shape[1].tolist())]
            shapes.append(shape)
            sizes.append(n)
        left, count, many = np.concatenate(shapes, axis=1).astype(np.int64)
        flags = induced_copies(runs, left, count, window)
        flags |= (many > 0)[:, None]
        run = np.repeat(np.arange(len(runs)), count)
        step = left[run] - (np.arange(len(run)) - (np.cumsum(count) - count)[run])
        found = flags[run, step]
        cuts = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.table({
            "chunk": table["chunk"].combine_chunks(), "bucket": table["bucket"].combine_chunks(),
            "answer": pa.array([np.packbits(found[a:b]).tobytes()
                                for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        }, schema=exchange._ANSWER)

    return find


def _result(chunk: _Chunk, ids: pa.Array, gone: np.ndarray, texts: bool) -> pa.Table:
    sizes, lost, n_spans, digests, kept, spans = [], [], [], [], [], []
    for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()):
        own = gone[a:b]
        edges = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
        begins = np.flatnonzero(edges == 1)
        rest = chunk.data[a:b][~own].tobytes()
        sizes.append(b - a)
        lost.append(b - a - len(rest))
        n_spans.append(len(begins))
        digests.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest if texts else None)
        spans.append([{"start": int(s), "end": int(e)} for s, e in
                      zip(begins, np.flatnonzero(edges == -1))] if texts else [])
    return pa.table({
        "doc_id": ids, "n_bytes": pa.array(sizes, pa.int64()),
        "n_removed": pa.array(lost, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.binary()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    })


def remove_repeated_bytes(
    docs: DataFrame, window: int = WINDOW, texts: bool = True, hot: int = HOT,
) -> DataFrame:
    """Removes every byte under a ``window``-byte string that also starts anywhere else.

    Takes doc_id and text; returns one row per document with its bytes, removed
    bytes, maximal removed runs and a digest of what stays and, with ``texts``,
    the remaining bytes and the runs.  Windows of an anchor with more than ``hot``
    runs are compared one by one.
    """
    if not 2 <= window <= 250:
        raise ValueError("the window must be 2 to 250 bytes")
    sizes = exchange.deal(docs)
    bits = sizes.bits
    chunks = exchange.in_chunks(docs, sizes)

    def ask(table: pa.Table) -> pa.Table:
        return _Chunk(table, window, bits).questions(table["chunk"][0].as_py())

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left, window, bits)
        chunk.runs(exchange.gathered(right, np.uint8))
        return chunk.run_questions(left["chunk"][0].as_py())

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right["kind"].combine_chunks()
        chunk = _Chunk(left, window, bits)
        chunk.runs(exchange.gathered(right.filter(pc.equal(kind, 1)), np.uint8))
        gone = chunk.removed(right.filter(pc.equal(kind, 2)))
        return _result(chunk, left["doc_id"].combine_chunks(), gone, texts)

    anchors = chunks.groupBy("chunk").applyInArrow(ask, exchange.ASK).groupBy(
        "bucket").applyInArrow(_recurring(hot), exchange.ANSWER)
    copies = chunks.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(
        send, exchange.ASK).groupBy("bucket").applyInArrow(_copies(window, bits), exchange.ANSWER)
    both = anchors.withColumn("kind", F.lit(1)).unionByName(copies.withColumn("kind", F.lit(2)))
    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, RESULT)
