"""Word and byte fingerprints over Arrow text columns, in numpy.

A word is a maximal run of bytes other than space and tab to carriage return;
these never occur inside a multi-byte UTF-8 character, so bytes suffice.
Fingerprints are polynomial sums modulo 2**64 over mixed byte values, finished
by a bijective mixer.  They depend on the words alone, never on the batch.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C17  # odd, 3 modulo 4
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SLICE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

# maps A-Z to a-z and every other byte to itself
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def give_back() -> None:
    """Freed memory goes back to the system; the C library (glibc) and Arrow's pool keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def byte_table(seed: int) -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) + U64(seed * _MULTIPLIER % (1 << 64)))


class _Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _SLICE + 1)
            for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if (
            column.num_chunks) else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n + 1 positions where documents begin among them."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1], before[1:] = False, inside[:-1]
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
) -> tuple[np.ndarray, pa.Array]:
    """A number for each span, equal where the bytes are equal, and the distinct spans in that order.

    Spans are in order and do not overlap.
    """
    compact, borders = compacted(data, starts, ends)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(borders), pa.py_buffer(compact)]).dictionary_encode()
    return spans.indices.to_numpy(zero_copy_only=False).astype(np.int64), spans.dictionary


def hashed(words: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash of each distinct word.

    Unlike ``span_hashes`` no polynomial: there are words, such as a Thue-Morse
    string of two letters and its complement, that agree under every polynomial
    modulo 2**64 once they have some thousand letters.
    """
    digest = xxhash.xxh3_64_intdigest
    # cut from one bytes object: Arrow takes several times as long to hand out each word
    _, borders, data = words.buffers()
    raw = data.to_pybytes() if data is not None else b""
    cuts = np.frombuffer(borders, np.int64)[words.offset:words.offset + len(words) + 1].tolist() if len(words) else []
    return np.fromiter((digest(raw[a:b], seed) for a, b in zip(cuts, cuts[1:])), U64, len(words))


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and do not overlap.

    Up to 16 bytes are read as two numbers, whose hash needs no step for each
    word; of up to 8 bytes and one length different words never agree.  Longer
    words are hashed as by ``hashed``.
    """
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    own = byte_table(seed)
    out = mix(eight[starts] & _HEAD[np.minimum(sizes, 8)] ^ own[0])
    wide = np.flatnonzero(sizes > 8)
    out[wide] += mix(eight[starts[wide] + 8] & _HEAD[np.minimum(sizes[wide] - 8, 8)] ^ own[1]) * own[2]
    out = mix(out + sizes.astype(U64) * U64(_MULTIPLIER))
    long = np.flatnonzero(sizes > 16)
    if len(long):
        codes, distinct = word_codes(data, starts[long], ends[long])
        out[long] = hashed(distinct, seed)[codes]
    return out


def ascending(values: np.ndarray) -> np.ndarray:
    """Order of unsigned 64-bit values, equal ones as they come.

    The leading bits are sorted with the position behind them, which is several
    times faster than to sort positions; values that agree there and still
    differ are seen, and then positions are sorted.
    """
    bits = U64(max(len(values) - 1, 0).bit_length())
    mask = (U64(1) << bits) - U64(1)
    order = (np.sort(values & ~mask | np.arange(len(values), dtype=U64)) & mask).astype(np.int64)
    there = values[order]
    if (there[1:] < there[:-1]).any():
        return np.argsort(values, kind="stable")
    return order


def compacted(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes end to end and their n + 1 borders."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    return data[inside], np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray,
) -> np.ndarray:
    """Fingerprint of each span, for spans of up to some hundred bytes; starts and ends ascend."""
    out = np.empty(len(starts), U64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _SLICE, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _powers.get(high - low + 1)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(table[data[low:high]] * up[:-1], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        first = last
    return out


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of every window of ``width`` values (document ends are not looked at)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``width`` items of one document begin, and the document of each."""
    sizes = np.maximum(np.diff(first) - (width - 1), 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    skipped = np.cumsum(sizes) - sizes
    return np.arange(len(doc)) - skipped[doc] + first[:-1][doc], doc


def planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that zero bytes lie together and compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(raw: bytes, dtype) -> np.ndarray:
    return np.cumsum(from_planes(raw, dtype), dtype=dtype)


def slices(batches, column: str = "text", most: int = 1 << 20):
    """Tables of at most ``most`` bytes of text each, or of one row; nothing is left out."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield pa.Table.from_batches([batch.slice(first, last - first)])
            first = last


def lower_latin(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals of UTF-8 bytes as small letters; the length stays."""
    out = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[capital] += 32
    return out


# bytes of letters, digits and everything beyond ASCII
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def class_runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and kind of each run of equal non-zero kinds inside one document."""
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kinds.dtype)
    new = np.ones(n, bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[offsets[offsets < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    own = kinds[starts] > 0
    return starts[own], ends[own], kinds[starts][own]
