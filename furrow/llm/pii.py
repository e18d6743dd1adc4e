"""Personal data and the terms that give it away (operator 3).

Base spans are four patterns: email, ip, card and phone, leftmost and not
overlapping within a kind, with their checks.  Positions are code points.

Disclosure: a matched value is a protected entity.  The words within ``reach``
words of it form its context; distinct contexts are counted, so copies of a
passage count once.  For a term t and an entity e met together in n(t,e)
contexts, with n(t) documents that hold t among N,

    bits(t, e) = log2( n(t,e) * N / (n(t) * n(e)) )     what t tells about e
    share(t, e) = n(t,e) / n(t)                         how often t means e

A term with at least ``support`` contexts, ``bits`` bits and a share of
``generalise`` discloses e: all its occurrences become spans of kind term.  They
are replaced by a class mark, or removed from a share of ``remove`` on.

Counts are aggregates over all documents.  Contexts travel for entities met in
enough contexts, n(t) is counted for the terms that could qualify; a fixed
bitmap keeps other words at home and decides nothing.  Up to ``listed`` qualifying
terms go to the texts as a list, without a shuffle.  More stay in their table: the
words that pass the bitmap meet them in a join, and the driver holds none of them.

Defined cases: null text counts as empty; repeated rows get equal results; long
runs of characters take linear time; an empty table gives an empty result;
further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import text
from furrow.llm.text import U64
from furrow.plans.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 8
SUPPORT = 3
BITS = 6.0
GENERALISE = 0.5
REMOVE = 0.9
LISTED = 1 << 17
_FILTER_BITS = 20
_TABLE = text.byte_table(71)

Span = tuple[int, int, int]  # start, end, index of the kind

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(value: str) -> Iterator[tuple[int, int]]:
    """As a search for local part, at sign and dotted domain, but linear: from each at sign."""
    free, at = 0, value.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(value, start - 1):
            start -= 1
        found = _DOMAIN.match(value, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at + 1)
        at = value.find("@", max(at + 1, free))


def _luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(value: str) -> list[Span]:
    """Spans of the four patterns, by start and kind."""
    out: list[Span] = []
    if "@" in value:
        out += [(a, b, 0) for a, b in _emails(value)]
    if _DIGIT.search(value):
        for m in _IP.finditer(value):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255
                   for part in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(value):
            digits = [int(c) for c in m[0] if c not in " -"] if len(m[0]) <= 38 else []
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in value:
            for m in _PHONE.finditer(value):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def describe(spans: list[Span]) -> str:
    """kind:start:end by start and kind, joined by commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def _term_words(column) -> tuple[np.ndarray, ...]:
    """Bytes without case, then start, end, fingerprint and text of each run of letters."""
    data, offsets = text.text_bytes(column)
    small = text.lower_latin(data) if len(data) else data
    starts, ends, _ = text.class_runs(text.LETTER[data].astype(np.uint8), offsets)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    own = (ends - starts >= 3) & (digits[ends] == digits[starts])
    starts, ends = starts[own], ends[own]
    prints = text.span_hashes(small, starts, ends, _TABLE)
    return data, offsets, starts, ends, prints, np.searchsorted(offsets, starts, "right") - 1


def _code_points(data: np.ndarray, base: int, places: np.ndarray) -> np.ndarray:
    """Code points between byte ``base`` and each of ``places``."""
    if not len(places):
        return places
    lead = (data[base:int(places.max())] & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])[places - base]


def _contexts(table: pa.Table, reach: int) -> list[tuple[int, int, list[int]]]:
    """(entity, context, terms around it) for every base span."""
    out = []
    values = table["text"].to_pylist()
    spans = [base_spans(v or "") for v in values]
    rows = [i for i, s in enumerate(spans) if s]
    if not rows:
        return out
    part = table.take(rows)
    data, offsets, starts, ends, prints, doc = _term_words(part["text"])
    cuts = np.searchsorted(doc, np.arange(len(rows) + 1))
    for k, i in enumerate(rows):
        lo, hi = cuts[k], cuts[k + 1]
        begin = _code_points(data, offsets[k], starts[lo:hi])
        end = _code_points(data, offsets[k], ends[lo:hi])
        own = prints[lo:hi]
        covered = np.zeros(hi - lo, bool)
        for a, b, _ in spans[i]:
            covered[np.searchsorted(end, a, "right"):np.searchsorted(begin, b, "left")] = True
        for a, b, kind in spans[i]:
            left, right = np.searchsorted(begin, a, "left"), np.searchsorted(begin, b, "left")
            near = np.concatenate([own[:left][~covered[:left]][-reach:],
                                   own[right:][~covered[right:]][:reach]])
            entity = hashlib.blake2b(f"{kind}:{values[i][a:b]}".encode(), digest_size=8).digest()
            context = hashlib.blake2b(near.tobytes(), digest_size=8).digest()
            out.append((int.from_bytes(entity, "big", signed=True),
                        int.from_bytes(context, "big", signed=True),
                        np.unique(near).view(np.int64).tolist()))
    return out


def _bitmap(terms: DataFrame):
    """Broadcast marks of 2**_FILTER_BITS slots, set where a term falls; None without terms.

    The size is the same whatever the number of terms.
    """
    slot = F.pmod(F.shiftrightunsigned("term", 64 - _FILTER_BITS), F.lit(1 << _FILTER_BITS))
    words = terms.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).collect()
    if not words:
        return None
    field = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    for r in words:
        field[r["word"]] = r["bits"]
    return terms.sparkSession.sparkContext.broadcast(
        np.unpackbits(field.view(np.uint8), bitorder="little").view(bool))


def _marked(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    return bitmap[(prints >> U64(64 - _FILTER_BITS)).astype(np.int64)]


def disclosing_terms(
    docs: DataFrame, reach: int = REACH, support: int = SUPPORT, bits: float = BITS,
    generalise: float = GENERALISE,
) -> DataFrame:
    """term (a fingerprint) and its largest share, for the terms that disclose an entity."""
    rows = docs.select("text").where("text IS NOT NULL")
    schema = "entity long, context long, terms array<long>"

    def collect(batches):
        for table in text.slices(batches):
            found = _contexts(table, reach)
            yield pa.record_batch({
                "entity": pa.array([f[0] for f in found], pa.int64()),
                "context": pa.array([f[1] for f in found], pa.int64()),
                "terms": pa.array([f[2] for f in found], pa.list_(pa.int64()))})

    # copies of a passage collapse before and after the shuffle
    contexts = cut_lineage(rows.mapInArrow(collect, schema).groupBy("entity", "context").agg(
        F.first("terms").alias("terms")))
    often = contexts.groupBy("entity").agg(F.count("*").alias("n_entity")).where(
        F.col("n_entity") >= support)
    together = cut_lineage(
        contexts.join(often, "entity").select("entity", "n_entity", F.explode("terms").alias("term"))
        .groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both"))
        .where(F.col("n_both") >= support))
    shipped = _bitmap(together)
    if shipped is None:  # no entity has a recurring term
        return together.select("term", F.lit(0.0).alias("share")).limit(0)

    def count(batches):
        for table in text.slices(batches):
            *_, prints, doc = _term_words(table["text"])
            near = _marked(shipped.value, prints)
            pairs = np.unique(np.stack([prints[near], doc[near].astype(U64)]), axis=1)
            term, n = np.unique(pairs[0], return_counts=True)
            yield pa.record_batch({"term": pa.array(term.view(np.int64)), "n": pa.array(n)})

    documents = rows.count()
    held = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    told = F.log2(F.col("n_both") * F.lit(float(documents)) / (F.col("n_term") * F.col("n_entity")))
    # n_both counts contexts, of which a document may hold several
    share = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    return cut_lineage(together.join(held, "term").where(
        (told >= bits) & (share >= generalise)).groupBy("term").agg(F.max(share).alias("share")))


def _places(column, chosen) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, starts, ends and fingerprints of the words whose fingerprints are chosen."""
    data, offsets, starts, ends, prints, doc = _term_words(column)
    hits = np.flatnonzero(chosen(prints)) if len(prints) else np.zeros(0, np.int64)
    rows, cuts = np.unique(doc[hits], return_index=True)
    for i, own in zip(rows.tolist(), np.split(hits, cuts[1:])):
        places = _code_points(data, offsets[i], np.concatenate([starts[own], ends[own]]))
        yield i, places[:len(own)], places[len(own):], prints[own]


def _with_terms(docs: DataFrame, terms: DataFrame, listed: int):
    """Rows with their text, and a function from a table of them to row: (start, end, share) of its terms."""
    if terms.count() <= listed:
        found = terms.toPandas()
        names = found["term"].to_numpy(np.int64).view(U64)
        order = np.argsort(names)
        names, shares = names[order], found["share"].to_numpy(np.float64)[order]

        def known(prints: np.ndarray) -> np.ndarray:
            return names[np.minimum(np.searchsorted(names, prints), len(names) - 1)] == prints

        def look_up(table: pa.Table) -> dict[int, list[tuple[int, int, float]]]:
            if not len(names):
                return {}
            return {i: list(zip(a.tolist(), b.tolist(), shares[np.searchsorted(names, own)].tolist()))
                    for i, a, b, own in _places(table["text"], known)}

        return docs, look_up
    shipped = _bitmap(terms)
    # terms of a text are those of its digest, so equal texts are looked through but kept once
    rows = docs.select(F.md5("text").alias("of"), "text").where("text IS NOT NULL")

    def candidates(batches):
        for table in text.slices(batches):
            for i, a, b, own in _places(table["text"], lambda prints: _marked(shipped.value, prints)):
                yield pa.record_batch({
                    "of": pa.array([table["of"][i].as_py()] * len(own), pa.string()), "a": pa.array(a, pa.int64()),
                    "b": pa.array(b, pa.int64()), "term": pa.array(own.view(np.int64))})

    spans = rows.mapInArrow(candidates, "of string, a long, b long, term long").join(terms, "term")
    name = "terms"
    while name in docs.columns:
        name += "_"
    marks = spans.groupBy("of").agg(F.collect_set(F.struct("a", "b", "share")).alias(name))
    joined = docs.join(marks, F.md5(docs["text"]) == marks["of"], "left").drop(marks["of"])

    def read(table: pa.Table) -> dict[int, list[tuple[int, int, float]]]:
        return {i: sorted((s["a"], s["b"], s["share"]) for s in own)
                for i, own in enumerate(table[name].to_pylist()) if own}

    return joined, read


def find_personal_data(docs: DataFrame, listed: int = LISTED, **thresholds) -> DataFrame:
    """Per document the counts of base spans, their digest and all spans.

    Takes doc_id and text.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, terms_of = _with_terms(keyed, disclosing_terms(docs, **thresholds), listed)

    def run(batches):
        for table in text.slices(batches):
            terms = terms_of(table)
            base = [base_spans(v or "") for v in table["text"].to_pylist()]
            extra = [[(a, b, 4) for a, b, _ in terms.get(i, ())] for i in range(len(base))]
            counts = np.array([[sum(s[2] == k for s in own) for k in range(4)] for own in base],
                              np.int64).reshape(len(base), 4)
            yield pa.record_batch({
                "doc_id": table["doc_id"].combine_chunks(),
                **{f"n_{KINDS[k]}": pa.array(counts[:, k]) for k in range(4)},
                "base_sha256": pa.array([hashlib.sha256(describe(s).encode()).hexdigest()
                                         for s in base], pa.string()),
                "spans": pa.array([describe(s + x) for s, x in zip(base, extra)], pa.string()),
                "n_term": pa.array([len(x) for x in extra], pa.int64())})

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_sha256 string, spans string, n_term long")


def replace(value: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced; of overlapping spans the first and longest counts."""
    parts, at = [], 0
    for a, b, mark in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a < at:
            continue
        parts += [value[at:a], mark]
        at = b
    return "".join(parts) + value[at:]


def sanitise(docs: DataFrame, listed: int = LISTED, remove: float = REMOVE, **thresholds) -> DataFrame:
    """The same rows and columns with personal data masked and disclosing terms generalised or removed.

    ``n_chars`` follows the text where the column exists; a null text stays null.
    """
    rows, terms_of = _with_terms(docs, disclosing_terms(docs, **thresholds), listed)

    def run(batches):
        for table in text.slices(batches):
            terms = terms_of(table)
            out = []
            for i, value in enumerate(table["text"].to_pylist()):
                if value is not None:
                    spans = [(a, b, f"[{KINDS[k].upper()}]") for a, b, k in base_spans(value)]
                    spans += [(a, b, "" if share >= remove else "[TERM]")
                              for a, b, share in terms.get(i, ())]
                    value = replace(value, spans) if spans else value
                out.append(value)
            place = table.schema.get_field_index("text")
            done = table.set_column(place, "text", pa.array(out, table.schema.field(place).type))
            yield from done.select(names).to_batches()

    names, schema = docs.columns, docs.schema
    cleaned = rows.mapInArrow(run, schema)
    if "n_chars" in names:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(
            schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned
