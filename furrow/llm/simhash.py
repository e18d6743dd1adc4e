"""Near duplicates by SimHash, found with Golay codewords (operator 12).

A document's fingerprint has 64 bits: each is set if it is set in over half of
the hashes of the document's word shingles, repeats included.  Fingerprints of
at most three differing bits link.

The fingerprint is cut into segments A, B, C of 22, 21 and 21 bits, each padded
to the 23 bits of the perfect binary Golay code.  Every 23-bit word decodes to
one codeword (12 bits); the words around a segment decode to at most six.  Two
segments that differ in two bits have a word between them that is one bit away
from both, so they share a codeword of their surroundings; if they differ in one
bit, the codeword of either lies in the other's surroundings.

Three differing bits fall on the segments in one of two ways:

- some segment Z is equal.  Of the pairs (A, B), (B, C), (C, A) one has its first
  segment equal and at most two bits apart in its second: were it three, the
  remaining segment would be equal and its own pair hold.  Key: Z and a codeword
  around the second segment, 33 bits and more, up to six keys for each pair;
- each segment differs in one bit.  Key: three codewords, 36 bits.  One side goes
  by the codewords around A, with those of B and C; the other by that of A, with
  those around B and C.

Keys meet in equi-joins over distinct fingerprints, and every meeting is verified
by the number of differing bits.  A fingerprint has at most 43,744 others within
three bits, whatever the number of documents, so links grow with the number of
distinct fingerprints.

Defined cases: null, empty and blank texts have no shingle, their fingerprint is
zero and links like any other; fewer words than a shingle make one shingle of the
whole sequence; a null doc_id stays null unless its component has an id; repeated
rows share a fingerprint and hence a component; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.text import U64
from furrow.plans.graph import components
from furrow.plans.session import cut_lineage

SHINGLE = 3
SEED = 42
DISTANCE = 3

# --- the binary Golay code of 23 bits: 12 of message, 11 of remainder

# fixed value: generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


def _corrections() -> np.ndarray:
    """The error of each remainder: the code is perfect, so those of weight up to 3 take each once."""
    single = 1 << np.arange(23)
    errors = [np.zeros(1, np.int64), single]
    i, j = np.triu_indices(23, 1)
    errors.append(single[i] | single[j])
    k = np.arange(23)
    low = np.repeat(np.arange(len(i)), 23)
    high = np.tile(k, len(i))
    good = high > j[low]
    errors.append(errors[2][low[good]] | single[high[good]])
    errors = np.concatenate(errors)
    out = np.empty(1 << 11, np.int64)
    out[_remainder(errors)] = errors
    return out


_CORRECTION = _corrections()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.int64)
    return (words ^ _CORRECTION[_remainder(words)]) >> 11


def around(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and codeword, once each, of every word and those one bit (of the lowest ``bits``) away."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(decode((words.astype(np.int64)[:, None] ^ flips).ravel()).reshape(len(words), -1))
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


# --- fingerprints

_LANES = U64(0x0101010101010101)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes the bits set in over half of them; zero for an empty run.

    Eight counters share a word, so runs are first added up in pieces of 255.
    """
    out = np.zeros(len(sizes), U64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    first = np.cumsum(sizes) - sizes
    pieces = -(-sizes[some] // 255)
    border = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    starts = np.repeat(first[some], pieces) + 255 * (
        np.arange(pieces.sum()) - np.repeat(border, pieces))
    counts = np.empty((len(some), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat(hashes >> U64(k) & _LANES, starts)
        counts[:, :, k] = np.add.reduceat(
            lanes.astype("<u8").view(np.uint8).reshape(-1, 8), border, dtype=np.int64)
    bits = 2 * counts.reshape(-1, 64) > sizes[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(value: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, ASCII capitals lowered, joined by one space."""
    # bytes.split cuts at space and at tab to carriage return, bytes.lower changes A-Z only
    words = (value or "").encode().lower().split()
    size = min(size, len(words))
    if not size:
        return np.zeros(0, U64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in pairs), U64, len(words) - size + 1)


FINGERPRINT = "doc_id long, fingerprint long"
_FINGERPRINT = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])
_ROWS = 256


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (64 bits, as a signed long) of each document."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                hashes = [shingle_hashes(t, size, seed) for t in part.column(1).to_pylist()]
                bits = majority(np.concatenate(hashes), np.array([len(h) for h in hashes]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(bits.view(np.int64))], schema=_FINGERPRINT)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, FINGERPRINT)


# --- links

KEYS = "key long, fingerprint long"
_KEYS = pa.schema([("key", pa.int64()), ("fingerprint", pa.int64())])
# lowest bit and width of A, B, C
_SEGMENTS = ((42, 22), (21, 21), (0, 21))


def _cut(values: np.ndarray) -> list[np.ndarray]:
    return [(values >> U64(low) & U64((1 << width) - 1)).astype(np.int64) for low, width in _SEGMENTS]


def equal_segment_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key for fingerprints with an equal segment; the same keys on both sides."""
    parts, rows, keys = _cut(values), [], []
    for k in range(3):
        row, code = around(parts[(k + 1) % 3], _SEGMENTS[(k + 1) % 3][1])
        rows.append(row)
        keys.append((k << 36) | parts[k][row] << 12 | code)
    return np.concatenate(rows), np.concatenate(keys)


def _product(row: np.ndarray, key: np.ndarray, more: np.ndarray, code: np.ndarray):
    """Every key of a row with each of its further codewords; both sides are in order of rows."""
    first = np.searchsorted(more, row)
    sizes = np.searchsorted(more, row, "right") - first
    begin = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(first - begin, sizes)
    return np.repeat(row, sizes), np.repeat(key, sizes) << 12 | code[at]


def one_each_keys(values: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and key for fingerprints with one differing bit in each segment.

    The narrow side looks around A, the wide one around B and C.
    """
    parts = _cut(values)
    rows = np.arange(len(values))
    sides = [around(p, w) if (k > 0) == wide else (rows, decode(p))
             for k, (p, (_, w)) in enumerate(zip(parts, _SEGMENTS))]
    row, key = sides[0]
    for more, code in sides[1:]:
        row, key = _product(row, key, more, code)
    return row, key | 3 << 36


def _keyed(values: DataFrame, make) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False)
                row, key = make(own.view(U64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], schema=_KEYS)

    return values.mapInArrow(run, KEYS)


def links(values: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of distinct ``fingerprint`` values with at most ``distance`` (0 to 3) differing bits."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys reach three differing bits")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # up to 36 keys come from a value: Spark's size estimate does not see them, so no side may be broadcast
    met = lambda left, right: left.join(right.hint("merge"), "key").where((F.col("a") < F.col("b")) & near)
    a, b = F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")
    same = _keyed(values, equal_segment_keys)
    equal = met(same.select("key", a), same.select("key", b))
    narrow = _keyed(values, lambda v: one_each_keys(v, False)).select("key", a)
    wide = _keyed(values, lambda v: one_each_keys(v, True)).select("key", b)
    each = met(narrow, wide)
    return equal.union(each).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id reachable by links."""
    marked = cut_lineage(fingerprints(docs, size, seed))
    values = cut_lineage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    tied = components(links(values.select("fingerprint"), distance))
    rooted = values.join(tied.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    # only roots that hold several fingerprints take the second step
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    own = cut_lineage(rooted.select("fingerprint", "root").join(named, "root").select(
        "fingerprint", "component_id"))
    return marked.join(own, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
