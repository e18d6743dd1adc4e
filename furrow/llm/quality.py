"""Ordinal quality classifier: cumulative-link regression on hashed text (operator 10).

P(grade <= k) = logistic(threshold_k - w.x) with one weight vector w for all
grades and ascending thresholds.  x holds hashed words, word beginnings and
punctuation of the whole text and shares that tell shouting and repetition;
slots in fewer than
``SUPPORT`` sampled documents, or as common in every grade, stay at zero.  The model is fitted by
full passes of adaptive gradient steps over a bounded sample of graded rows
(``sample``, taken by a hash of the id, the same at every size); it is one array
of 2**``bits`` numbers, so its broadcast is bounded.  Scoring is one scan
without a shuffle.

Defined cases: null or empty text scores like a text without any run; ids
without a text or with several ratings (the lowest counts) are no trouble; with
no usable sample every document gets the top grade with certainty; repeated
rows are scored alike; an empty table gives an empty result; further columns
are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import text
from furrow.llm.text import U64

SAMPLE = 12_000
BITS = 18
SUPPORT = 8
EXCESS = 20.0
_TABLES = [text.byte_table(seed) for seed in (41, 42, 43)]
_PREFIXES = (4, 5)
_LOUD, _AGAIN, _SHARES = 1, 2, 3
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True

SCORES = "doc_id long, expected_grade double, tail_probability double"


def features(column, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, slot and value of every feature, ordered by document and slot.

    Counted (as logarithms): word and punctuation runs, the first four and five
    bytes of words, runs of capitals, runs equal to one of the four before.
    Squared shares of all runs: punctuation, capitals, such repeats.
    """
    data, offsets = text.text_bytes(column)
    kinds = np.where(text.SPACE[data], 0, np.where(text.LETTER[data], 1, 2)).astype(np.uint8)
    starts, ends, kind = text.class_runs(kinds, offsets)
    small = text.lower_latin(data) if len(data) else data
    doc = np.searchsorted(offsets, starts, "right") - 1
    prints = text.span_hashes(small, starts, ends, _TABLES[0])
    # a run of capitals, or one met shortly before, also counts under a slot of its own
    capitals = np.concatenate([[0], np.cumsum(_CAPITAL[data])])
    loud = (ends - starts > 1) & (capitals[ends] - capitals[starts] == ends - starts)
    again = np.zeros(len(prints), bool)
    for back in range(1, 5):
        again[back:] |= (prints[back:] == prints[:-back]) & (doc[back:] == doc[:-back])
    shift, low = U64(bits), U64((1 << bits) - 1)
    keys = [(doc.astype(U64) << shift) | (prints >> U64(64 - bits))]
    for slot, own in ((_LOUD, loud), (_AGAIN, again)):
        keys.append((doc[own].astype(U64) << shift) | U64(slot))
    for length, table in zip(_PREFIXES, _TABLES[1:]):
        own = np.flatnonzero((kind == 1) & (ends - starts >= length))
        begun = text.span_hashes(small, starts[own], starts[own] + length, table)
        keys.append((doc[own].astype(U64) << shift) | (begun >> U64(64 - bits)))
    key = np.sort(np.concatenate(keys))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    counts = np.log1p(np.diff(np.append(first, len(key))))
    key = key[first]
    runs = np.bincount(doc, minlength=len(offsets) - 1)
    shares, own = [], np.flatnonzero(runs)
    for slot, flag in ((_SHARES, kind == 2), (_SHARES + 1, loud), (_SHARES + 2, again)):
        shares.append((own.astype(U64) << shift) | U64(slot))
        share = np.bincount(doc[flag], minlength=len(runs))[own] / runs[own]
        counts = np.append(counts, 8 * share ** 2)
    key = np.concatenate([key, *shares])
    order = np.argsort(key, kind="stable")
    key = key[order]
    return (key >> shift).astype(np.int64), (key & low).astype(np.int64), counts[order]


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights and ascending thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))

    def score(self, column) -> np.ndarray:
        doc, slot, value = features(column, self.bits)
        return np.bincount(doc, weights=self.weights[slot] * value, minlength=len(column))


def _telling(
    doc: np.ndarray, slot: np.ndarray, grade: np.ndarray, grades: int, bits: int,
) -> np.ndarray:
    """Slots in enough documents, whose grades differ from the sample's by chi square."""
    own = grade.astype(np.min_scalar_type(grades))[doc]
    seen = np.stack([np.bincount(slot[own == g], minlength=1 << bits)
                     for g in range(grades)]).astype(np.float64)
    total = seen.sum(axis=0)
    expected = np.bincount(grade, minlength=grades)[:, None] / len(grade) * total
    excess = ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0)
    keep = (total >= SUPPORT) & (excess >= EXCESS)
    keep[_LOUD:_SHARES + 3] = True
    return keep


def fit(
    doc: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int,
    bits: int = BITS, passes: int = 30, batch: int = 256, rate: float = 0.08, ridge: float = 2e-5,
) -> OrdinalModel:
    """Fits by adaptive gradient steps; rows are (doc, slot, value) ordered by doc.

    Thresholds are kept ascending as a first value and the logarithms of the gaps.
    """
    n = len(grade)
    known = _telling(doc, slot, grade, grades, bits)[slot]
    cuts = np.searchsorted(doc[known], np.arange(n + 1))
    slot, value = slot[known], value[known]
    del doc, known
    weights, seen = np.zeros(1 << bits), np.full(1 << bits, 1e-6)
    share = np.cumsum(np.bincount(grade, minlength=grades))[:-1] + 0.5
    start = np.log(share / (n + 1 - share))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    raw_seen = np.full(len(raw), 1e-6)
    rng = np.random.default_rng(5)
    for _ in range(passes):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo:lo + batch]
            spans = [np.arange(cuts[i], cuts[i + 1]) for i in rows]
            at = np.concatenate(spans)
            own = np.repeat(np.arange(len(rows)), [len(s) for s in spans])
            x, s = value[at].astype(np.float64), slot[at]
            score = np.bincount(own, weights=weights[s] * x, minlength=len(rows))
            level = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
            bound = np.concatenate([[-60.0], level, [60.0]])
            g = grade[rows]
            below = 1 / (1 + np.exp(-np.clip(bound[g] - score, -50, 50)))
            upto = 1 / (1 + np.exp(-np.clip(bound[g + 1] - score, -50, 50)))
            chance = np.maximum(upto - below, 1e-9)
            low, high = below * (1 - below) / chance, upto * (1 - upto) / chance
            slope = (high - low) / len(rows)  # of the loss by the score
            used, inverse = np.unique(s, return_inverse=True)
            step = np.bincount(inverse, weights=slope[own] * x) + ridge * weights[used]
            seen[used] += step * step
            weights[used] -= rate * step / np.sqrt(seen[used])
            by_level = np.zeros(len(level))
            np.add.at(by_level, g[g > 0] - 1, low[g > 0] / len(rows))
            np.add.at(by_level, g[g < grades - 1], -high[g < grades - 1] / len(rows))
            step = np.append(np.cumsum(by_level[::-1])[::-1], 0)[:len(raw)]
            step[1:] *= np.exp(raw[1:])
            raw_seen += step * step
            raw -= rate * step / np.sqrt(raw_seen)
    level = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
    return OrdinalModel(weights, level, bits)


def graded_sample(
    docs: DataFrame, graded: DataFrame, sample: int = SAMPLE, bits: int = BITS, part: Column | None = None,
) -> tuple[np.ndarray, ...]:
    """Features and grades of at most ``sample`` graded documents, chosen by a hash of the id.

    Where several rows have a chosen id, the least of their texts stands for it.
    ``part`` restricts the rated rows, for instance to those not held out.
    """
    rated = graded.where("doc_id IS NOT NULL AND grade IS NOT NULL")
    rated = rated if part is None else rated.where(part)
    chosen = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(
        F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(sample)
    # the bound of the broadcast is ``sample`` rows of two numbers
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def extract(batches):
        for table in text.slices(batches):
            doc, slot, value = features(table["text"], bits)
            cuts = np.searchsorted(doc, np.arange(table.num_rows + 1))
            yield pa.record_batch({
                "doc_id": table["doc_id"].combine_chunks().cast(pa.int64()),
                "grade": table["grade"].combine_chunks().cast(pa.int64()),
                "slots": pa.array([slot[a:b].astype(np.int32).tobytes()
                                   for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                "counts": pa.array([value[a:b].astype(np.float16).tobytes()
                                    for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    got = rows.mapInArrow(extract, "doc_id long, grade long, slots binary, counts binary").withColumn(
        "size", F.octet_length("slots")).toArrow().sort_by(
        [("doc_id", "ascending"), ("size", "ascending")])
    grade = np.array(got["grade"].to_pylist(), np.int64)
    doc = np.repeat(np.arange(len(grade), dtype=np.int32),
                    np.array(got["size"].to_pylist(), np.int64) // 4)
    slot, value = (np.concatenate([np.zeros(0, kind), *[
        np.frombuffer(raw.as_buffer(), kind) for raw in got[name]]])
        for name, kind in (("slots", np.int32), ("counts", np.float16)))
    del got
    text.give_back()
    return doc, slot, value, grade


def train(
    docs: DataFrame, graded: DataFrame, grades: int, sample: int = SAMPLE, bits: int = BITS,
    part: Column | None = None,
) -> OrdinalModel:
    """Model of ``graded`` (doc_id, grade from 0 to grades - 1) on the texts of ``docs``."""
    doc, slot, value, grade = graded_sample(docs, graded, sample, bits, part)
    if len(np.unique(grade)) < 2:
        return OrdinalModel(np.zeros(1 << bits), np.full(grades - 1, -40.0), bits)
    model = fit(doc, slot, value, grade, grades, bits)
    # the driver goes on to other work: what it gathered is given back
    del doc, slot, value, grade
    text.give_back()
    return model


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_grade and tail_probability, that of the top grade."""
    shipped = _ship(docs, model)

    def run(batches):
        own = shipped.value
        for table in text.slices(batches):
            tails = own.tails(own.score(table["text"]))
            yield pa.record_batch({
                "doc_id": table["doc_id"].combine_chunks(),
                "expected_grade": pa.array(np.round(tails.sum(axis=1), 6)),
                "tail_probability": pa.array(np.round(tails[:, -1], 6))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def select_good(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose tail probability is at least ``least``."""
    shipped = _ship(docs, model)

    def run(batches):
        own = shipped.value
        for table in text.slices(batches):
            tails = own.tails(own.score(table["text"]))
            yield from table.filter(pa.array(np.round(tails[:, -1], 6) >= least)).to_batches()

    return docs.mapInArrow(run, docs.schema)


def _ship(docs: DataFrame, model: OrdinalModel):
    # 2**bits numbers, whatever the size of the data
    return docs.sparkSession.sparkContext.broadcast(OrdinalModel(
        model.weights.astype(np.float32), model.thresholds, model.bits))
