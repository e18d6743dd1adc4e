import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from furrow.llm import periodic_runs, queries, ranked_search, simhash
from furrow.llm.text import U64

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(value):
    return hashlib.sha256(value.encode()).hexdigest()


# --- periodic runs


def runs_by_hand(w, least=6, copies=4):
    out = {}
    for q in range(1, len(w) // copies + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, copies * q):
                out.setdefault((start, i - start + q), q)
            i = max(i, start + 1)
    return sorted((s, q, n) for (s, n), q in out.items())


@pytest.mark.parametrize("least,copies", [(6, 4), (2, 2), (5, 3)])
def test_runs_of_small_alphabets(least, copies):
    rnd = random.Random(copies)
    for _ in range(60):
        docs = []
        for _ in range(rnd.randrange(1, 9)):
            k = rnd.choice([1, 2, 3, 20])
            w = [rnd.randrange(k) for _ in range(rnd.randrange(90))]
            if w and rnd.random() < 0.5:
                a, p = rnd.randrange(len(w)), rnd.randrange(1, 9)
                w = [w[a + (i - a) % p] if i >= a and a + p <= len(w) else x for i, x in enumerate(w)]
            docs.append(w)
        first = np.cumsum([0] + [len(w) for w in docs])
        got = periodic_runs.find_runs(np.array([x for w in docs for x in w], np.int64), first, least, copies)
        for d, w in enumerate(docs):
            own = [(int(s), int(q), int(n)) for k, s, n, q in zip(*got) if k == d]
            assert own == runs_by_hand(w, least, copies)


def test_extensions_reach_what_words_say():
    rnd = np.random.default_rng(3)
    codes = np.concatenate([np.tile(rnd.integers(0, 3, 13), 9), rnd.integers(0, 2, 200), [99]])
    own = periodic_runs.Extensions(codes, np.zeros(len(codes), np.int64))
    i, j = rnd.integers(0, len(codes), (2, 3000))
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i, j, own.of(i, j)):
        k = 0
        while max(a, b) + k < len(codes) and codes[a + k] == codes[b + k]:
            k += 1
        assert n == k


def test_planted_runs_of_the_query(spark, tmp_path, documents, corpus):
    rows = corpus + [(i, " ".join(f"w{j % 40}" if i % 3 else f"w{j}" for j in range(i % 200))) for i in range(200, 420)]
    rows += [(500, "na " * 5000 + "batman"), (501, "x x x x x"), (502, "x x x x x x")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.work.queries["op11_periodic_runs"](spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = runs_by_hand(w) if n < 5000 else [(s, 1, 5000) for s in [0]]
        gone = {k for s, q, m in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=None)
        want.append((i, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else [None] * 4),
                     digest("".join(f"{s},{m},{q}\n" for s, q, m in runs)),
                     digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert sum(r[1] for r in want) > 20


def test_runs_of_an_empty_table(documents):
    assert periodic_runs.periodic_runs(documents([])).collect() == []


# --- SimHash


def fingerprint_by_hand(value):
    words = WORD.findall((value or "").translate(LOWER))
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42)
              for i in range(len(words) - k + 1)] if k else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_code_is_perfect():
    words = np.arange(1 << 23)
    index, sizes = np.unique(simhash.decode(words), return_counts=True)
    assert len(index) == 4096 and set(sizes) == {2048}
    row, code = simhash.around(words[:5000], 23)
    assert np.bincount(row).max() == 6


def test_segments_two_bits_apart_share_a_codeword():
    rnd = random.Random(5)
    for _ in range(300):
        a = rnd.randrange(1 << 23)
        b = a ^ 1 << rnd.randrange(23) ^ 1 << rnd.randrange(23)
        sets = [set(simhash.around(np.array([x]), 23)[1]) for x in (a, b)]
        assert sets[0] & sets[1]


def test_links_of_every_pattern_of_differing_bits(spark):
    rnd = random.Random(6)
    values = []
    for _ in range(400):
        base = rnd.getrandbits(64)
        values += [base, base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 6)))]
    values += [0, 7, 15, 1 << 63, (1 << 64) - 1]
    values = sorted(set(values))
    signed = np.array(values, U64).view(np.int64).tolist()
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i]
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert {tuple(r) for r in got} == want and len(want) > 200


def test_keys_of_fingerprints_are_not_broadcast(spark):
    """A value has up to 36 keys, which Spark's size estimate of the values does not see."""
    values = spark.range(8).selectExpr("id << 20 AS fingerprint")
    plan = simhash.links(values)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_near_duplicates_by_simhash(documents, corpus):
    rnd = random.Random(7)
    base = [f"word{rnd.randrange(900)}" for _ in range(1500)]
    rows = corpus + [(1000 + i, " ".join(base[:i] + [f"new{i}"] + base[i + 1:])) for i in range(0, 120)]
    rows += [(3000, None), (3001, " \n"), (None, " ".join(base)), (2000 + 1, "A B"), (1, "a b")]
    got = simhash.near_duplicates(documents(rows)).collect()
    prints = [fingerprint_by_hand(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= 3:
                group[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    want = [(i, f"{prints[x]:016x}", least.get(find(x))) for x, (i, _) in enumerate(rows)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert len({r[2] for r in want}) < len(want) - 100
    assert simhash.near_duplicates(documents([])).collect() == []


# --- ranked search


def ranked_by_hand(rows, items, best):
    split = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in rows]
    split = [(i, t) for i, t in split if t]
    docs, total = len(split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, value in items:
        found = []
        for i, t in split:
            m = 100 - 50 + 50 * len(t) * docs // total
            score = 0
            for x in set(TERM.findall((value or "").translate(LOWER))) & set(t):
                w = math.floor(1000 * math.log((2 * docs + 2) / (2 * df[x] + 1)))
                score += w * (1000000000 * t.count(x) // (1000 * t.count(x) + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:best])]
    return out


@pytest.mark.parametrize("best,shard,leaf,block", [(50, 4096, 64, 4 << 20), (5, 16, 2, 1200), (1, 7, 1, 4 << 20)])
def test_ranked_search(spark, documents, corpus, best, shard, leaf, block):
    rows = corpus + [(700 + i, corpus[3][1]) for i in range(30)]  # ties
    texts = [t for _, t in corpus if t and len(t) > 20]
    items = [(k, t[:200]) for k, t in enumerate(texts[:12])] + [(90, ""), (91, None), (92, "zzzz"), (None, texts[13])]
    given = spark.createDataFrame([(i, t, "x", 1) for i, t in items + items[:2]],
                                  "item_id long, text string, doc_id string, score int")
    got = ranked_search.ranked(documents(rows), given, best, shard, leaf, block).collect()
    assert sorted(map(str, ranked_by_hand(rows, items, best))) == sorted(str(tuple(r)) for r in got)


def test_ranked_search_of_nothing(spark, documents):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert ranked_search.ranked(documents([]), items).collect() == []
    assert ranked_search.ranked(documents([(1, "some")]), items.limit(0)).collect() == []
    assert ranked_search.ranked(documents([(1, None), (2, " .")]), items).collect() == []


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(600):
        group = i // 100 * 10
        rows.append(sorted(set(rnd.integers(group, group + 14, 6).tolist())))
    first = np.cumsum([0] + [len(r) for r in rows])
    values = rnd.integers(1, 10 ** 9, first[-1])
    vectors = ranked_search._Vectors(np.arange(600), np.concatenate(rows), values, first)
    tree = ranked_search.BallTree(vectors, 80, 16)
    items = ranked_search.Items(None, np.array([1, 3, 5, 41, 44]), np.array([0, 3, 5, 5]))
    bounds = tree.bounds(items, np.zeros(80))
    below = lambda n: [n] if tree.children[n] is None else [x for c in tree.children[n] for x in below(c)]
    for item, terms in enumerate(([1, 3, 5], [41, 44])):
        asked = np.zeros(80, np.int64)
        asked[terms] = 1
        for node in range(len(bounds)):
            assert bounds[node][item] > max(tree.rows[x].dot(asked).max() for x in below(node))
