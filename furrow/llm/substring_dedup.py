"""Repeated word windows, by fixed-block anchors (operator 2).

Each document is cut into non-overlapping reference blocks of half a window.
A window that occurs in two documents holds a whole block of the smaller one,
so probing the block index with every rolling window of block length finds an
anchor in both.  Hits are extended: every full window around an anchor is
compared with the same windows elsewhere, and adjacent ones that match make up
the maximal exact repeat.  Both steps go through ``exchange``: a chunk asks once
per distinct fingerprint, so a passage in a third of all documents costs a
bucket one entry per chunk, and no pairs of documents are ever formed.

Anchors use fingerprints of about 36 bits, where a collision only adds work;
windows use 96 bits and more.

Defined cases: null text and white space only have no words; a document with
fewer words than a window keeps them all; a null doc_id counts as larger than
any other; rows with one doc_id don't remove each other's words; an empty table
gives an empty result; further columns are not looked at.
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

WINDOW = 50
_LAST = np.iinfo(np.int64).max
_SEEDS = (11, 12)

RESULT = ("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, "
          "spans array<struct<start:long,end:long>>")


class _Chunk:
    """Words, rolling windows and distinct anchors of one chunk of documents."""

    def __init__(self, table: pa.Table, window: int, bits: int) -> None:
        self.window, self.block, self.bits = window, window // 2, bits
        ids = table["doc_id"].combine_chunks()
        self.ids = np.where(np.asarray(ids.is_null()), _LAST,
                            np.asarray(ids.fill_null(0), dtype=np.int64))
        self.data, self.offsets = text.text_bytes(table["text"])
        self.starts, self.ends, self.first = text.word_spans(self.data, self.offsets)
        self.codes, self.distinct = text.word_codes(self.data, self.starts, self.ends)
        self.words = text.hashed(self.distinct, _SEEDS[0])[self.codes]
        self.at, self.doc = text.window_starts(self.first, self.block)
        self.probe = text.rolling(self.words, self.block)[self.at] >> U64(32 - bits)
        self.ids_asked, self.inverse = np.unique(self.probe, return_inverse=True)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Per distinct probe: whether it is a reference block here, and stands in two documents."""
        n = len(self.ids_asked)
        is_block = np.zeros(n, np.uint8)
        is_block[self.inverse[(self.at - self.first[self.doc]) % self.block == 0]] = 1
        low, high = np.full(n, _LAST), np.full(n, -1)
        np.minimum.at(low, self.inverse, self.doc)
        np.maximum.at(high, self.inverse, self.doc)
        return is_block, (high > low).astype(np.uint8)

    def windows(self, hits: np.ndarray) -> None:
        """Full windows around anchors: where they start, their document and fingerprints."""
        hit = np.zeros(len(self.words) + 1, np.int32)
        hit[self.at[hits[self.inverse] > 0]] = 1
        seen = np.concatenate([[0], np.cumsum(hit)])
        at, doc = text.window_starts(self.first, self.window)
        near = seen[at + self.window - self.block + 1] > seen[at]
        self.full_at, self.full_doc = at[near], doc[near]
        other = text.hashed(self.distinct, _SEEDS[1])[self.codes]
        high = text.rolling(self.words, self.window)[self.full_at]
        low = text.rolling(other, self.window)[self.full_at]
        # the leading bits name the bucket, the rest and the second fingerprint are compared
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.high, self.low = high[order][new], low[order][new]
        self.least = np.full(int(new.sum()), _LAST)
        np.minimum.at(self.least, self.group, self.ids[self.full_doc])

    def window_questions(self, chunk: int) -> pa.Table:
        shift = U64(64 - self.bits)
        cuts = np.searchsorted(self.high >> shift, np.arange((1 << self.bits) + 1, dtype=U64))
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int64()),
            "chunk": pa.array([chunk] * len(rows), pa.int64()),
            "keys": pa.array([text.pack_sorted(self.high[lo:hi]) for _, lo, hi in rows], pa.binary()),
            "extra": pa.array([
                text.planes((self.low[lo:hi] >> U64(32)).astype(np.uint32))
                + text.planes(self.least[lo:hi]) for _, lo, hi in rows], pa.binary()),
        }, schema=exchange._ASK)

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Words under a window that also starts in a document with a smaller id."""
        gone = (self.ids[self.full_doc] > self.least[self.group]) | (smaller[self.group] > 0)
        steps = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(steps, self.full_at[gone], 1)
        np.add.at(steps, self.full_at[gone] + self.window, -1)
        return np.cumsum(steps[:-1]) > 0


def _anchor_hits(table: pa.Table) -> pa.Table:
    """Which probes of a bucket meet a reference block and stand in two documents."""
    keys = [text.unpack_sorted(raw, np.uint32) for raw in table["keys"].to_pylist()]
    sizes = [len(k) for k in keys]
    extra = [np.frombuffer(raw, np.uint8).reshape(2, -1) for raw in table["extra"].to_pylist()]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    flags = np.concatenate(extra, axis=1)
    block = np.bincount(inverse, weights=flags[0]) > 0
    shared = (np.bincount(inverse) > 1) | (np.bincount(inverse, weights=flags[1]) > 0)
    return exchange.answers(table, sizes, (block & shared)[inverse].astype(np.uint8))


def _window_hits(table: pa.Table) -> pa.Table:
    """Which windows of a bucket start in a document smaller than the chunk's smallest."""
    high = [text.unpack_sorted(raw, U64) for raw in table["keys"].to_pylist()]
    sizes = [len(k) for k in high]
    low, least = [], []
    for raw, n in zip(table["extra"].to_pylist(), sizes):
        low.append(text.from_planes(raw[:4 * n], np.uint32))
        least.append(text.from_planes(raw[4 * n:], np.int64))
    high, low, least = np.concatenate(high), np.concatenate(low), np.concatenate(least)
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = np.full(int(new.sum()), _LAST)
    np.minimum.at(first, group, least)
    return exchange.answers(table, sizes, (first[group] < least).astype(np.uint8))


def _result(chunk: _Chunk, ids: pa.Array, gone: np.ndarray, texts: bool) -> pa.Table:
    raw = chunk.data.tobytes()
    n_words, n_removed, digests, kept_texts, spans = [], [], [], [], []
    for i in range(len(chunk.ids)):
        lo, hi = chunk.first[i], chunk.first[i + 1]
        own = gone[lo:hi]
        lost = int(own.sum())
        words = raw[chunk.offsets[i]:chunk.offsets[i + 1]].split()
        if lost:
            words = [words[j] for j in np.flatnonzero(~own)]
        kept = b" ".join(words)
        n_words.append(hi - lo)
        n_removed.append(lost)
        digests.append(hashlib.sha256(kept).hexdigest())
        kept_texts.append(kept.decode() if texts else None)
        if texts and lost:
            edges = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
            spans.append([{"start": int(a), "end": int(b)} for a, b in
                          zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))])
        else:
            spans.append([])
    return pa.table({
        "doc_id": ids, "n_words": pa.array(n_words, pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
        "kept": pa.array(kept_texts, pa.string()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    })


def remove_repeated_windows(
    docs: DataFrame, window: int = WINDOW, texts: bool = True,
) -> DataFrame:
    """Removes every word under a window that also starts in a document with a smaller doc_id.

    Takes doc_id and text; returns one row per document with the number of words
    and of removed words, a digest of the kept words joined by one space and, with
    ``texts``, those words themselves and the removed runs as word positions.
    """
    if window < 2 or window % 2:
        raise ValueError("the window must be an even number of words")
    sizes = exchange.deal(docs)
    chunks = exchange.in_chunks(docs, sizes)
    bits = sizes.bits

    def ask_anchors(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, bits)
        return exchange.questions(table["chunk"][0].as_py(), chunk.ids_asked, bits,
                                  list(chunk.anchors()))

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return exchange._ASK.empty_table()
        chunk = _Chunk(left, window, bits)
        chunk.windows(exchange.gathered(right, np.uint8))
        return chunk.window_questions(left["chunk"][0].as_py())

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right["kind"].combine_chunks()
        chunk = _Chunk(left, window, bits)
        chunk.windows(exchange.gathered(right.filter(pc.equal(kind, 1)), np.uint8))
        gone = chunk.removed(exchange.gathered(right.filter(pc.equal(kind, 2)), np.uint8))
        return _result(chunk, left["doc_id"].combine_chunks(), gone, texts)

    anchors = chunks.groupBy("chunk").applyInArrow(ask_anchors, exchange.ASK).groupBy(
        "bucket").applyInArrow(_anchor_hits, exchange.ANSWER)
    windows = chunks.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(
        ask_windows, exchange.ASK).groupBy("bucket").applyInArrow(_window_hits, exchange.ANSWER)
    both = anchors.withColumn("kind", F.lit(1)).unionByName(windows.withColumn("kind", F.lit(2)))
    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, RESULT)
