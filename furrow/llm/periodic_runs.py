"""Periodic runs of words, by longest common extensions from a difference cover (operator 11).

A run is a stretch of consecutive words with smallest period q, at least ``copies``
periods and ``least`` words long, that can't be extended while it keeps period q.

The words of a batch of documents are numbered exactly.  Positions whose number
modulo 7 lies in the cover {0, 1, 3} are the sample: any two positions reach the
sample together within six steps.  Only the sampled suffixes are sorted, first by
seven words, then by doubling; the ranks of every round give the common prefixes
of neighbours in the order, and a sparse table over these answers range minima.
The common extension of two positions then is: compare up to six words, and if
all are equal, look up the minimum between the two sampled suffixes.  The same
over the reversed words extends to the left.

A run of period q and at least L words holds every pair (i, i + q) with i in a
stretch of L - q places, so a grid of that step meets it: for each document and
q the grid points are extended both ways, about n/3 . ln n of them in n words.
Multiples of a run's period meet the same stretch and give way to the smallest.

Documents are worked on in batches of bounded text, or alone if longer; nothing
is shared between documents, so there is no shuffle.

Defined cases: null, empty and blank texts have no words and no runs; each row is
judged alone, so null and repeated ids and equal rows change nothing; an empty
table gives an empty result; further columns are kept out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import text

LEAST = 6
COPIES = 4
BATCH_BYTES = 2 << 20
_GRID = 1 << 20

# fixed values: a perfect difference set modulo 7
PERIOD = 7
COVER = np.array([0, 1, 3])

RESULT = ("doc_id long, n_words long, "
          "runs array<struct<start:long,length:long,period:long>>, kept string")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _steps() -> np.ndarray:
    """Steps after which two positions, by their remainders, are both in the sample."""
    r = np.arange(PERIOD)
    inside = np.isin((r[:, None] + r) % PERIOD, COVER)  # position, steps
    return (inside[:, None, :] & inside[None, :, :]).argmax(2)


_STEPS = _steps()


class Extensions:
    """Length of the longest common prefix of two suffixes within one group of a sequence.

    ``codes`` are non-negative word numbers, ``group`` ascending group numbers.  The
    last position of a group must hold a code that occurs nowhere else.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray) -> None:
        self.n = len(codes)
        # padding so that every block of a sampled suffix can be read
        self.codes = np.concatenate([codes, np.full(2 * PERIOD, -1)])
        blocks = -(-self.n // PERIOD)
        self.places = (np.arange(blocks)[:, None] * PERIOD + COVER).ravel()
        group = np.concatenate([group, np.full(PERIOD, group[-1] + 1 if len(group) else 0)])
        group = group[self.places]
        self._sort(group)
        # no question goes beyond a group
        self._minima(int(np.bincount(group).max(initial=1)))

    def _sample(self, position: np.ndarray) -> np.ndarray:
        """Number in the sample of sampled positions."""
        return position // PERIOD * len(COVER) + np.searchsorted(COVER, position % PERIOD)

    def _sort(self, group: np.ndarray) -> None:
        """Order of the sampled suffixes; ``levels[k]`` ranks them by 7 * 2**k words."""
        m = len(self.places)
        bits = max(int(self.codes.max(initial=0) + 1).bit_length(), 1)
        per = max(62 // bits, 1)
        keys = []
        for lo in range(0, PERIOD, per):
            key = np.zeros(m, np.int64)
            for k in range(lo, min(lo + per, PERIOD)):
                key = key << bits | (self.codes[self.places + k] + 1)
            keys.append(key)
        keys.insert(0, group)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        # a rank is the place of the first equal suffix in the order
        rank = np.empty(m, np.int64)
        starts = np.flatnonzero(new)
        rank[order] = starts[np.cumsum(new) - 1]
        self.levels = [rank.astype(np.int32)]
        step = len(COVER)
        while step < m:
            sizes = np.diff(np.append(starts, m))
            open_at = np.flatnonzero(np.repeat(sizes > 1, sizes))
            if not len(open_at):
                break
            who = order[open_at]
            after = np.full(len(who), -1, np.int64)
            inside = who + step < m
            after[inside] = rank[who[inside] + step]
            resort = np.lexsort((after, rank[who]))
            who, after = who[resort], after[resort]
            own = rank[who]
            order[open_at] = who
            first = np.ones(len(who), bool)
            first[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
            begin = open_at[np.flatnonzero(first)]
            rank = rank.copy()
            rank[who] = begin[np.cumsum(first) - 1]
            new[open_at] = first
            starts = np.flatnonzero(new)
            self.levels.append(rank.astype(np.int32))
            step *= 2
        self.order = order
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)

    def _minima(self, widest: int) -> None:
        """Common prefixes of neighbours in the order and their minima over powers of two up to ``widest``."""
        m = len(self.order)
        a, b = self.order[:-1], self.order[1:]
        far = np.zeros(max(m - 1, 0), np.int64)  # in samples
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], len(COVER) << k
            inside = np.maximum(a, b) + far < m
            at = np.minimum(far, m - 1 - np.maximum(a, b))
            far += np.where(inside & (rank[a + at] == rank[b + at]), step, 0)
        common = far // len(COVER) * PERIOD
        left, right = self.places[a] + common, self.places[b] + common
        live = np.arange(len(common))
        for k in range(PERIOD - 1):
            live = live[(np.maximum(left[live], right[live]) + k < self.n)]
            live = live[self.codes[left[live] + k] == self.codes[right[live] + k]]
            common[live] += 1
        self.levels = []
        # table[k][i] is the least of common[i : i + 2**k]
        self.table = [common.astype(np.int32)]
        while 2 << len(self.table) - 1 <= min(widest, len(common)):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of the common prefixes between places ``low`` < ``high`` of the order."""
        out = np.empty(len(low), np.int64)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            own = level == k
            row = self.table[k]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << int(k))])
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of positions ``i`` and ``j`` (different, in one group)."""
        out = np.zeros(len(i), np.int64)
        steps = _STEPS[i % PERIOD, j % PERIOD]
        live = np.arange(len(i))
        for k in range(PERIOD - 1):
            go = steps[live] > k
            wait, live = live[~go], live[go]
            same = self.codes[i[live] + k] == self.codes[j[live] + k]
            live = live[same]
            out[live] += 1
            live = np.concatenate([wait, live])
        if len(live):
            a = self.rank[self._sample(i[live] + steps[live])]
            b = self.rank[self._sample(j[live] + steps[live])]
            out[live] += self._least(np.minimum(a, b), np.maximum(a, b))
        return out


def find_runs(
    codes: np.ndarray, first: np.ndarray, least: int = LEAST, copies: int = COPIES,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and period of every run; by document, start and period.

    Words of document d are ``codes[first[d]:first[d + 1]]``.
    """
    sizes = np.diff(first)
    docs = len(sizes)
    total = len(codes) + docs + 1
    # a mark that occurs once stands before each document and after the last
    home = first + np.arange(docs + 1)
    line = np.empty(total, np.int64)
    mark = np.zeros(total, bool)
    mark[home] = True
    line[mark] = codes.max(initial=-1) + 1 + np.arange(docs + 1)
    line[~mark] = codes
    ahead = Extensions(line, np.cumsum(mark) - mark)
    back = Extensions(line[::-1], (np.cumsum(mark)[::-1] - docs - 1) * -1)

    per_doc = np.where(sizes >= least, sizes // copies, 0)
    doc = np.repeat(np.arange(docs), per_doc)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + 1
    step = np.maximum(least, copies * q) - q
    points = (sizes[doc] - q - 1) // step + 1
    found = []
    ends = np.cumsum(points)
    lo = 0
    while lo < len(doc):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + _GRID, "right")))
        number = np.repeat(np.arange(lo, hi), points[lo:hi])
        at = (np.arange(len(number)) - np.repeat(ends[lo:hi] - points[lo:hi] - done, points[lo:hi])
              ) * step[number]
        i = home[doc[number]] + 1 + at
        hit = np.flatnonzero(line[i] == line[i + q[number]])
        i, number = i[hit], number[hit]
        j = i + q[number]
        right = ahead.of(i, j)
        left = back.of(total - i, total - j)
        length = left + right + q[number]
        good = length >= np.maximum(least, copies * q[number])
        i, number = i[good], number[good]
        found.append(np.stack([doc[number], i - left[good] - home[doc[number]] - 1,
                               length[good], q[number]]))
        lo = hi
    if not found:
        return tuple(np.zeros((4, 0), np.int64))
    d, start, length, q = np.concatenate(found, axis=1)
    # one stretch is met at several grid points and by multiples of its period
    order = np.lexsort((q, length, start, d))
    d, start, length, q = d[order], start[order], length[order], q[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    d, start, length, q = d[new], start[new], length[new], q[new]
    order = np.lexsort((q, start, d))
    return d[order], start[order], length[order], q[order]


def _collapsed(data, starts, ends, first, gone) -> list[str]:
    """Words of each document that are not gone, joined by one space."""
    compact, borders = text.compacted(data, starts, ends)
    sizes = np.diff(borders) + 1
    spaced = np.full(sizes.sum(), 32, np.uint8)
    inside = np.ones(len(spaced), bool)
    inside[np.cumsum(sizes) - 1] = False
    spaced[inside] = compact
    spaced = spaced[np.repeat(~gone, sizes)].tobytes()
    cuts = np.concatenate([[0], np.cumsum(np.where(gone, 0, sizes))])[first]
    return [spaced[a:max(a, b - 1)].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _runs_of(table: pa.Table, least: int, copies: int) -> pa.RecordBatch:
    data, offsets = text.text_bytes(table["text"])
    starts, ends, first = text.word_spans(data, offsets)
    codes, _ = text.word_codes(data, starts, ends)
    d, start, length, q = find_runs(codes, first, least, copies)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, first[d] + start + q, 1)
    np.add.at(edge, first[d] + start + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(d, np.arange(len(first))), pa.int32()),
        pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, q)], fields=list(_RUN)))
    return pa.RecordBatch.from_arrays(
        [table["doc_id"].combine_chunks(), pa.array(np.diff(first), pa.int64()), runs,
         pa.array(_collapsed(data, starts, ends, first, gone), pa.string())],
        names=["doc_id", "n_words", "runs", "kept"])


def periodic_runs(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """doc_id, n_words, the runs by start and period, and the text without repeats.

    ``kept`` joins by one space the words that no run holds after its first period.
    """
    if copies < 2:
        raise ValueError("a run has at least two periods")

    def run(batches):
        for table in text.slices(batches, most=BATCH_BYTES):
            yield _runs_of(table, least, copies)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, RESULT)
