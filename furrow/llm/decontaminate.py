"""Benchmark items inside documents, by embedded edit distance (operator 6).

Texts are compared as words without case and ASCII punctuation, joined by one
space.  A window starts at a word of a document and is as long as an item.

Embedding: a random walk copies the characters of a string and at each step
stays or moves on as a shared random bit of (step, character) says.  Strings at
a small edit distance walk together again after an edit, so their outputs agree
in many places: edit distance becomes Hamming distance.  Sampling ``sampled``
places gives one hash table; ``tables`` of them, over ``WALKS`` independent walks,
find a pair whose outputs agree in a share ``agree`` of the places with the
probability ``recall``.  Items are
grouped by length, and a group samples only the places its shortest item fills.
Every candidate is verified by the exact edit distance between the item and the
best place in the window, at most ``ratio`` of the item's length.

Windows are embedded where pairs of words of an item occur, one to three words
apart, at the byte they imply as the start, and compared with that item:
embedding each window of a corpus for each length would cost thousands of steps
per word.  All pairs of an occurrence imply starts within twice the allowed
edits; two different pairs that close are asked for (one, if the item has fewer than
``SURE_WORDS`` words), and one for each ``WORDS_A_PAIR`` words of the item.  What an occurrence must keep of the item's substrings of
``GRAM`` bytes is counted next, which loses none: an edit touches ``GRAM`` of them.

Items travel in shards of bounded size; each shard is one scan of the documents
without a shuffle of text.  Items of one word are looked up as a whole.
Hits are worked on for at most ``HITS`` at a time, or for one document.

Defined cases: null and empty texts match nothing; items without a word are
skipped; repeated items match each on its own; repeated rows and rows with one
doc_id are merged in the result (smallest distance); an empty table on either
side gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import text
from furrow.llm.text import U64

SEED_WORDS = 2
GAPS = (1, 2, 3)
SURE_WORDS = 16
WORDS_A_PAIR = 10
RATIO = 0.15
RECALL = 0.95
SAMPLED = 3
AGREE = 0.2
WALKS = 4
GRAM = 4
SLOT_BITS = 14
HITS = 1 << 20
SHARD_BYTES = 8 << 20

RESULT = "doc_id long, item_id long, distance long, item_chars long, word_at long"
_SCHEMA = pa.schema([(c, pa.int64()) for c in
                     ("doc_id", "item_id", "distance", "item_chars", "word_at")])
_TABLE = text.byte_table(61)
_PUNCTUATION = ~text.LETTER & ~text.SPACE


def normal_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without case and punctuation, then starts, ends and first word of each text."""
    data, offsets = text.text_bytes(column)
    data = text.lower_latin(data) if len(data) else data.copy()
    data[_PUNCTUATION[data]] = 32
    return (data, *text.word_spans(data, offsets))


def walk_bits(steps: int, seed: int) -> np.ndarray:
    """Whether the walk moves on, for each step and byte."""
    cells = np.arange(steps * 256, dtype=U64) + U64(seed << 32)
    return (text.mix(cells) & U64(1)).astype(np.int64).reshape(steps, 256)


def pair_seeds(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first word and text of every two words ``GAPS`` apart."""
    parts = []
    for gap in GAPS:
        at, owner = text.window_starts(first, gap + 1)
        parts.append((text.mix(words[at] * U64(2 * gap + 1) + text.mix(words[at + gap])), at, owner))
    return tuple(np.concatenate(c) for c in zip(*parts))


def embed(rows: np.ndarray, walk: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The embedding of zero-padded byte rows at the sampled steps (ascending, distinct)."""
    n, width = rows.shape
    flat, base = rows.ravel(), np.arange(n) * width
    at = np.zeros(n, np.int64)
    out, k = np.zeros((n, len(places)), np.uint8), 0
    for step in range(int(places[-1]) + 1 if len(places) else 0):
        char = np.where(at < width, flat[base + np.minimum(at, width - 1)], 0)
        if places[k] == step:
            out[:, k] = char
            k += 1
        at += walk[step, char]
    return out


def edit_distance_within(item: bytes, window: bytes) -> int:
    """Edits that turn ``item`` into the best substring of ``window``, a column of bits at a time."""
    full, top = (1 << len(item)) - 1, 1 << max(len(item) - 1, 0)
    where: dict[int, int] = {}
    for i, char in enumerate(item):
        where[char] = where.get(char, 0) | (1 << i)
    more, less, score = full, 0, len(item)
    best = score
    for char in window:
        equal = where.get(char, 0)
        vertical = equal | less
        across = (((equal & more) + more) ^ more) | equal
        up, down = less | (full & ~(across | more)), more & across
        score += bool(up & top) - bool(down & top)
        best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        more, less = down | (full & ~(vertical | up)), up & vertical
    return best


def _padded(texts: list[bytes], width: int) -> np.ndarray:
    joined = b"".join([t.ljust(width, b"\0") for t in texts])
    return np.frombuffer(joined, np.uint8).reshape(len(texts), width)


def squeezed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where each begins; the last entry is the end."""
    sizes = ends - starts
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(begin[-1]), 32, np.uint8)
    own = data[~text.SPACE[data]]
    out[np.arange(len(own)) + np.repeat(np.arange(len(sizes)), sizes)] = own
    return out, begin


def gram_slots(data: np.ndarray) -> np.ndarray:
    """A slot for the ``GRAM`` bytes at each position, zeros beyond the end."""
    wide = np.concatenate([data, np.zeros(GRAM, np.uint8)]).astype(np.uint32)
    value = np.zeros(len(data), np.uint32)
    for k in range(GRAM):
        value |= wide[k:k + len(data)] << np.uint32(8 * k)
    return ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).astype(np.uint16)


def _spread(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions low to low + size - 1 of every row, and the row of each."""
    row = np.repeat(np.arange(len(low)), size)
    return np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row], row


@dataclass
class ItemIndex:
    """Seeds and hash tables of a bounded set of items."""

    items: list[tuple[int, str | None]]
    ratio: float = RATIO
    recall: float = RECALL
    sampled: int = SAMPLED
    agree: float = AGREE
    texts: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.tables = math.ceil(math.log(1 - self.recall)
                                / math.log(1 - self.agree ** self.sampled))
        data, starts, ends, first = normal_words(pa.array([t for _, t in self.items], pa.large_string()))
        words = text.span_hashes(data, starts, ends, _TABLE)
        self.data, begin = squeezed(data, starts, ends)
        self.low = begin[first[:-1]]
        self.size = np.maximum(begin[first[1:]] - 1 - self.low, 0)
        self.limit = np.floor(self.size * self.ratio).astype(np.int64)
        self.slots = gram_slots(self.data)
        self.texts = [self.data[a:a + n] for a, n in zip(self.low, self.size)]
        self.words = np.diff(first)
        grams, at, owner = pair_seeds(words, first)
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.where = np.stack([owner, begin[at] - self.low[owner]], axis=1)[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.grams >> U64(44)).astype(np.int64)] = True
        # items of few words are looked up whole, by a fingerprint per number of words
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, n in enumerate(self.words):
            if 0 < n < SEED_WORDS:
                key = int(text.rolling(words[first[i]:first[i + 1]], n)[0])
                self.short.setdefault(n, {}).setdefault(key, []).append(i)
        self._groups()

    def _groups(self) -> None:
        """Length groups, each item at most a fifth longer than the shortest of its group."""
        long = sorted((len(self.texts[i]), i) for i, n in enumerate(self.words) if n >= SEED_WORDS)
        self.group = np.full(len(self.items), -1)
        self.groups: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.signs: list[dict[int, np.ndarray]] = [{} for _ in range(WALKS)]
        per_walk = -(-self.tables // WALKS)
        while long:
            least = long[0][0]
            own = [i for n, i in long if n <= least * 1.2]
            long = long[len(own):]
            rng = np.random.default_rng(least)
            steps = max(2 * least, self.sampled)
            places = np.sort(rng.permutation(steps)[:self.sampled * per_walk])
            # an item too short for tables of their own places has tables that share them
            slots = np.concatenate([rng.permutation(len(places)) for _ in range(
                -(-self.sampled * per_walk // (len(places) // self.sampled * self.sampled)))])
            slots = np.concatenate([
                turn[:len(turn) // self.sampled * self.sampled].reshape(-1, self.sampled)
                for turn in slots.reshape(-1, len(places))])[:per_walk]
            width = max(len(self.texts[i]) for i in own)
            rows = _padded([self.texts[i].tobytes() for i in own], width)
            for walk, signs in enumerate(self.signs):
                signs.update(zip(own, embed(rows, walk_bits(steps, 7 + walk), places)))
            self.group[own] = len(self.groups)
            self.groups.append((width, steps, places, slots))

    def starts(self, words: np.ndarray, first: np.ndarray, begin: np.ndarray):
        """Distinct (document, item, start byte) that enough shared pairs imply, in bounded parts."""
        seeds, at, doc = pair_seeds(words, first)
        near = np.flatnonzero(self.filter[(seeds >> U64(44)).astype(np.int64)])
        near = near[np.argsort(at[near], kind="stable")]
        lo = np.searchsorted(self.grams, seeds[near], "left")
        many = np.searchsorted(self.grams, seeds[near], "right") - lo
        at, doc, total = at[near], doc[near], np.concatenate([[0], np.cumsum(many)])
        done = 0
        while done < len(near):
            upto = int(np.searchsorted(total, total[done] + HITS, "right")) - 1
            # whole documents, one at least
            stop = int(np.searchsorted(doc, doc[upto], "left")) if upto < len(near) else upto
            if stop <= done:
                stop = int(np.searchsorted(doc, doc[done], "right"))
            own = slice(done, stop)
            yield self._starts(lo[own], many[own], at[own], doc[own], begin)
            done = stop

    def _starts(self, lo, many, at, doc, begin) -> np.ndarray:
        entry, hit = _spread(lo, many)
        item, offset = self.where[entry].T
        # one number per hit, ordered by document, item and implied start
        most = 2 * int(self.limit.max(initial=0))
        before = int(self.size.max(initial=0))
        reach = int(begin[-1]) + before + most + 1
        line = (doc[hit] * len(self.items) + item) * reach + begin[at[hit]] - offset + before
        order = np.argsort(line, kind="stable")
        line, seed = line[order], lo[hit][order]
        band = 2 * self.limit[item[order]]
        # the nearest hits before and after that come from another pair
        edge = np.flatnonzero(np.diff(seed, prepend=-1, append=-1))
        run = np.searchsorted(edge, np.arange(len(line)), "right") - 1
        far = np.concatenate([[-most - 1], line, [line[-1] + 2 * most + 1 if len(line) else 0]])
        other = np.minimum(far[edge[run + 1] + 1] - line, line - far[edge[run]]) <= band
        enough = other | (self.words[item[order]] < SURE_WORDS)
        line = line[enough]
        band, words = band[enough], self.words[item[order][enough]]
        # all hits of an occurrence lie within a band after its first
        stop = np.searchsorted(line, line + band, "right")
        full = stop - np.arange(len(line)) >= words // WORDS_A_PAIR
        cover = np.bincount(np.flatnonzero(full), minlength=len(line) + 1)
        cover -= np.bincount(stop[full], minlength=len(line) + 1)
        line = np.unique(line[np.cumsum(cover[:-1]) > 0])
        owner = line // reach
        return np.stack([owner // len(self.items), owner % len(self.items),
                         line - owner * reach - before])

    def _likely(self, found: np.ndarray, slots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The starts around which enough of the item's substrings occur."""
        doc, item, start = found
        if not len(doc):
            return found
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (
            np.diff(start) > 2 * self.limit[item[1:]])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc)) - 1
        doc, item, limit = doc[head], item[head], self.limit[item[head]]
        a = np.maximum(start[head] - limit, low[doc])
        b = np.minimum(start[tail] + self.size[item] + 2 * limit, high[doc])
        grams = np.maximum(self.size[item] - GRAM + 1, 0)
        asked = grams - GRAM * limit
        good = asked <= 0
        room = np.concatenate([[0], np.cumsum(np.maximum(b - a, 0) + grams + (1 << SLOT_BITS))])
        done = 0
        while done < len(head):
            stop = max(int(np.searchsorted(room, room[done] + (8 << 20), "right")) - 1, done + 1)
            k = slice(done, stop)
            seen = np.zeros((stop - done) << SLOT_BITS, bool)
            where, row = _spread(a[k], np.maximum(b[k] - a[k], 0))
            seen[(row << SLOT_BITS) + slots[where]] = True
            where, row = _spread(self.low[item[k]], grams[k])
            shared = np.bincount(row[seen[(row << SLOT_BITS) + self.slots[where]]],
                                 minlength=stop - done)
            good[k] |= shared >= asked[k]
            done = stop
        return found[:, good[np.cumsum(new) - 1]]

    def _collide(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether a window equals its item or shares a bucket of a hash table with it."""
        out = np.zeros(len(item), bool)
        for g, (width, steps, places, slots) in enumerate(self.groups):
            own = np.flatnonzero(self.group[item] == g)
            if not len(own):
                continue
            at = start[own, None] + np.arange(width)
            rows = np.where(at < end[own, None], data[np.minimum(at, len(data) - 1)], 0)
            known = _padded([self.texts[i].tobytes() for i in item[own]], width)
            out[own] = ((rows == known) | (known == 0)).all(axis=1)
            for walk, known in enumerate(self.signs):
                signs = embed(rows, walk_bits(steps, 7 + walk), places)
                agree = signs == np.stack([known[i] for i in item[own]])
                out[own] |= agree[:, slots].all(axis=2).any(axis=1)
        return out

    def matches(self, column) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) to (distance, word of the document) for texts of one column."""
        data, starts, ends, first = normal_words(column)
        words = text.span_hashes(data, starts, ends, _TABLE)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for n, table in self.short.items():
            at, doc = text.window_starts(first, n)
            prints = text.rolling(words, n)[at] if len(at) else np.zeros(0, U64)
            for k in np.flatnonzero(np.isin(prints, np.array(list(table), U64))):
                for item in table[int(prints[k])]:
                    found.setdefault((int(doc[k]), item), (0, int(at[k] - first[doc[k]])))
        data, begin = squeezed(data, starts, ends)
        low, high = begin[first[:-1]], np.maximum(begin[first[1:]] - 1, 0)
        raw, slots = data.tobytes(), gram_slots(data)
        for part in self.starts(words, first, begin):
            self._verify(self._likely(part, slots, low, high), data, raw, begin, first, low, high, found)
        return found

    def _verify(self, part, data, raw, begin, first, low, high, found) -> None:
        for lo in range(0, part.shape[1], 1 << 12):
            d, i, s = part[:, lo:lo + (1 << 12)]
            rest = []
            hits = np.flatnonzero(self._collide(data, np.maximum(s, low[d]), high[d], i))
            for d, i, s in zip(d[hits].tolist(), i[hits].tolist(), s[hits].tolist()):
                limit = int(self.limit[i])
                a, b = max(s - limit, int(low[d])), min(s + int(self.size[i]) + 2 * limit, int(high[d]))
                own, key = self.texts[i].tobytes(), (d, i)
                if (at := (b" " + raw[a:b] + b" ").find(b" " + own + b" ")) >= 0:
                    at = int(np.searchsorted(begin, a + at, "left"))
                    best = (0, at - int(first[d]))
                    found[key] = min(found.get(key, best), best)
                elif rest and rest[-1][0] == key and s - rest[-1][1] <= 2 * limit:
                    rest[-1][3] = b  # starts of one occurrence are verified together
                else:
                    rest.append([key, s, a, b])
            for key, s, a, b in rest:
                if not found.get(key, (1, 0))[0]:
                    continue
                distance = edit_distance_within(self.texts[key[1]].tobytes(), raw[a:b])
                if distance <= self.limit[key[1]]:
                    at = int(np.searchsorted(begin, max(s, int(low[key[0]])), "right")) - 1
                    best = (distance, at - int(first[key[0]]))
                    found[key] = min(found.get(key, best), best)


def contaminated(
    docs: DataFrame, items: DataFrame, ratio: float = RATIO, recall: float = RECALL,
    sampled: int = SAMPLED, agree: float = AGREE, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """doc_id, item_id, distance, item_chars and word_at for every item found in a document.

    ``docs`` has doc_id and text, ``items`` item_id and text.  Items without an id
    are looked for like any other; a document has one row with a null item_id for
    all of them, that of the closest.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"),
                         F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    out = spark.createDataFrame([], RESULT)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    for shard in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        # one shard holds shard_bytes of items on average, so this collect is bounded
        index = ItemIndex(sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda item: (
            item[0] is None, item[0] or 0, item[1])), ratio, recall, sampled, agree)
        if not any(index.words):
            continue
        shipped = spark.sparkContext.broadcast(index)

        def run(batches, shipped=shipped):
            index = shipped.value
            for table in text.slices(batches):
                ids = table["doc_id"].to_pylist()
                rows = [(ids[i], index.items[item][0], distance, len(index.texts[item]), at)
                        for (i, item), (distance, at) in index.matches(table["text"]).items()]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(_SCHEMA.names, r)) for r in rows], schema=_SCHEMA)

        out = out.union(rows.mapInArrow(run, RESULT))
    best = F.min(F.struct("distance", "item_chars", "word_at"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", "best.distance", "best.item_chars", "best.word_at")
