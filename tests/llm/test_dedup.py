import hashlib
import re

import numpy as np
import pytest

from furrow.llm import exchange, ngram_join, suffix_dedup
from furrow.plans.graph import components
from furrow.llm.ngram_join import PrefixTree, near_duplicates
from furrow.llm.substring_dedup import remove_repeated_windows
from furrow.llm.suffix_dedup import remove_repeated_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


def windows_by_hand(rows, window):
    large = 1 << 62
    split = [(large if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for j in range(len(w) - window + 1):
            key = tuple(w[j:j + window])
            first[key] = min(first.get(key, large), i)
    out = []
    for (i, _), (number, w) in zip(rows, split):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < number:
                gone[j:j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), digest(kept.encode()), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 6])
def test_repeated_windows(documents, corpus, window):
    got = remove_repeated_windows(documents(corpus), window).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == windows_by_hand(corpus, window)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def bytes_by_hand(rows, window):
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for w in raw:
        for j in range(len(w) - window + 1):
            seen[w[j:j + window]] = seen.get(w[j:j + window], 0) + 1
    out = []
    for (i, _), w in zip(rows, raw):
        gone = np.zeros(len(w) + 2, bool)
        for j in range(len(w) - window + 1):
            if seen[w[j:j + window]] > 1:
                gone[j + 1:j + 1 + window] = True
        kept = bytes(b for b, g in zip(w, gone[1:]) if not g)
        out.append((i, len(w), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), digest(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [200, 40])
def test_repeated_bytes(documents, corpus, window):
    got = remove_repeated_bytes(documents(corpus), window).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == bytes_by_hand(corpus, window)
    assert all(digest(bytes(r["kept"])) == r["kept_sha256"] for r in got)


@pytest.mark.parametrize("hot", [0, 4])
def test_hot_anchors_give_the_same(documents, corpus, hot):
    line = "This line of a licence stands in every third document, whatever else it says. "
    rows = [(i, t if t is None or n % 3 else f"{t[:len(t) // 2]} {line}{t[len(t) // 2:]}")
            for n, (i, t) in enumerate(corpus)]
    got = remove_repeated_bytes(documents(rows), 100, hot=hot).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == bytes_by_hand(rows, 100)


def test_a_hot_anchor_is_spread_over_buckets():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    line = "".join(rng.choice(list("abcdefgh"), 180))
    texts = ["".join(rng.choice(list("xyz"), 300)) + line + "".join(rng.choice(list("xyz"), 300))
             for _ in range(200)]
    chunk = suffix_dedup._Chunk(pa.table({"text": texts}), 200, 4)
    asked = suffix_dedup._recurring(100)(chunk.questions(0))
    chunk.runs(exchange.gathered(asked, np.uint8))
    assert chunk.hot.any()
    sent = [len(raw) for raw in chunk.run_questions(0)["extra"].to_pylist()]
    assert len(sent) >= 16 and max(sent) < 2 * sum(sent) / 16


def test_runs_are_the_same_across_slices(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abc"), 5)) for _ in range(3000)]
    table = pa.table({"text": [" ".join(words[a:b]) for a, b in ((0, 1500), (1500, 1510), (1510, 3000))]})
    whole = suffix_dedup._Chunk(table, 200, 4)
    monkeypatch.setattr(suffix_dedup, "_SLICE", 777)
    parts = suffix_dedup._Chunk(table, 200, 4)
    for name in ("low", "anchor", "count", "name"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name)), name


def groups_by_hand(rows, percent=75):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        least = min(ids, default=None) if sets[k] else i
        out.append((i, len(sets[k]), least))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(documents, corpus, block):
    got = near_duplicates(documents(corpus), block=block).collect()
    assert sorted(map(tuple, got), key=str) == groups_by_hand(corpus)


def test_chain_across_blocks_keeps_its_links(documents):
    """Each text is similar to the next alone, so a link lost between blocks would split the chain."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6:i * 6 + 110])) for i in range(40)]
    assert sorted(map(tuple, near_duplicates(documents(rows), block=4).collect()), key=str) == (
        groups_by_hand(rows))


def test_prefix_tree_joins_what_is_similar():
    rng = np.random.default_rng(1)
    base = [sorted(rng.choice(400, 60, replace=False).tolist()) for _ in range(12)]
    sets = [sorted(set(b) - set(rng.choice(b, k).tolist())) for b in base for k in (0, 3, 9, 14)]
    tree = PrefixTree(75)
    for s in sets:
        tree.add(s, len(s))
    linked = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(set(a) & set(sets[j]))
            if 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                old, new = linked[i], linked[j]
                linked = [new if x == old else x for x in linked]
    for i in range(len(sets)):
        for j in range(i):
            assert (tree.find(i) == tree.find(j)) == (linked[i] == linked[j])


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}


@pytest.mark.parametrize("pairs, most", [([(1, 2)], 8), ([(1, 2), (2, 3)], 32)])
def test_components_run_few_stages(spark, pairs, most):
    sc, group = spark.sparkContext, f"components-of-{len(pairs)}"
    edges = spark.createDataFrame(pairs, "a long, b long").localCheckpoint()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc.setJobGroup(group, group)
    try:
        got = components(edges).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r) for r in got) == [(b, 1) for _, b in pairs]
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    assert 0 < len({s for j in jobs for s in j.stageIds}) <= most


def test_freed_memory_goes_back():
    import gc
    from pathlib import Path

    from furrow.llm import text

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    many = [np.ones(1 << 13) for _ in range(2000)]  # 64 KB each, too small for a mapping of their own
    last = np.ones(1 << 13)
    before = resident()
    del many
    gc.collect()
    text.give_back()
    assert before - resident() > 100e6 and len(last)


def test_empty_tables(documents):
    empty = documents([(1, "a")]).where("false")
    for run in (remove_repeated_windows, remove_repeated_bytes, near_duplicates):
        assert run(empty).collect() == []
    blank = documents([(1, None), (2, "")])
    assert sorted(map(tuple, near_duplicates(blank).collect())) == [(1, 0, 1), (2, 0, 2)]
    assert [r["n_bytes"] for r in remove_repeated_bytes(blank).collect()] == [0, 0]
    assert ngram_join.THRESHOLD == 75


def test_equal_rows_spread_over_chunks(documents, monkeypatch):
    monkeypatch.setattr(exchange, "COPIES", 64)
    rows = [(None, "the same notice for everyone")] * 1000 + [(7, None)] * 9 + [(i, f"text {i}") for i in range(1991)]
    dealt = exchange.in_chunks(documents(rows), exchange.Deal(64, 4)).toPandas()
    sizes = dealt.groupby("chunk").size()
    assert len(dealt) == 3000 and len(sizes) == 64 and sizes.max() < 100
    got = dealt.fillna({"doc_id": -1, "text": "none"}).groupby(["doc_id", "text"]).size()
    assert got[(-1, "the same notice for everyone")] == 1000 and got[(7, "none")] == 9


def test_a_third_of_equal_rows_without_an_id(documents, corpus):
    notice = " ".join(f"word{i % 7}{i}" for i in range(60))
    rows = corpus + [(None, notice)] * 45 + [(300, f"before {notice} after")]
    got = remove_repeated_bytes(documents(rows)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == bytes_by_hand(rows, 200)
    got = [tuple(r)[:5] for r in remove_repeated_windows(documents(rows)).collect()]
    assert sorted(got, key=str) == windows_by_hand(rows, 50)
    got = near_duplicates(documents(rows)).where("doc_id IS NULL OR doc_id = 300").collect()
    assert len(got) == 47 and {r["component_id"] for r in got if r["n_shingles"] == 56} == {300}


def thue_morse(length, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(length))


@pytest.mark.parametrize("length", [1024, 4096])
def test_long_words_that_agree_under_polynomials_stay_apart(documents, length):
    one, two = thue_morse(length), thue_morse(length, "ba")
    same = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join(same + [one])), (2, " ".join(same + [two])), (3, one), (4, two), (5, one + " ")]
    got = remove_repeated_windows(documents(rows)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == dict.fromkeys(range(1, 6), 0)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(rows)).collect()}
    # the first two share 45 of 47 shingles of five words
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}


def test_blocks_of_a_cluster_are_dealt_by_block(spark):
    from furrow.llm import ngram_join

    clustered = spark.range(9).selectExpr(
        "cast(string(id) as binary) AS class", "1L AS n_shingles", "cast('12345678' as binary) AS tokens", "cast(string(id div 100) as binary) AS cluster")
    links = ngram_join._cluster_links(clustered, 75, 100)
    assert links.select("a").union(links.select("b")).distinct().count() == 9
    assert "RepartitionByExpression [cluster" in links._jdf.queryExecution().optimizedPlan().toString()


def test_texts_go_in_slices_of_a_megabyte():
    import pyarrow as pa

    from furrow.llm import text

    batch = pa.record_batch({"text": pa.array(["x" * 300_000] * 10 + ["y" * 3_000_000])})
    tables = list(text.slices([batch]))
    assert pa.concat_tables(tables).combine_chunks().to_batches()[0].equals(batch)
    assert [t.num_rows for t in tables] == [3, 3, 3, 1, 1]


def test_order_of_values_that_share_their_leading_bits():
    from furrow.llm import text

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 1000, 5000):
        wide = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        for values in (wide, wide >> np.uint64(50), wide >> np.uint64(60) << np.uint64(60),
                       np.repeat(wide, 2)[:n] + rng.integers(0, 3, n).astype(np.uint64)):
            assert (text.ascending(values) == np.argsort(values, kind="stable")).all()


def test_blocks_that_are_joined_meet_across_only(monkeypatch):
    """Of two blocks joined before, the sets of one ask the tree of the other, and nothing is asked twice."""
    import pyarrow as pa

    from furrow.llm import ngram_join

    asked = []
    probe = PrefixTree._probe
    monkeypatch.setattr(PrefixTree, "_probe", lambda self, own, size, number: (
        asked.append(number), probe(self, own, size, number)))
    sets = [np.arange(40), np.arange(100, 140), np.arange(2, 42), np.arange(200, 240), np.arange(4, 44)]
    names = [b"a", b"b", b"c", b"d", b"e"]
    got = ngram_join._tree_links(pa.table({
        "class": pa.array(names), "n_shingles": pa.array([40] * 5),
        "tokens": pa.array([s.astype(np.int64).tobytes() for s in sets]),
        "linked": pa.array([b"a", b"b", b"c", b"d", b"c"]), "home": pa.array([True, True, False, False, False]),
    }), 75)
    assert len(asked) == 3
    linked = {n: n for n in names}
    for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist()):
        linked = {n: linked[b] if r == linked[a] else r for n, r in linked.items()}
    assert linked[b"a"] == linked[b"c"] == linked[b"e"] and len(set(linked.values())) == 3


def test_words_are_hashed_by_their_bytes_alone():
    from furrow.llm import text

    rng = np.random.default_rng(2)
    # words of 1 to 40 bytes, with zero bytes and beginnings in common, each twice and between other neighbours
    words = [b"ab"[:k % 3] + bytes(rng.integers(0, 3, k).tolist()) or b"x" for k in range(40) for _ in range(50)]
    words = [words[i] for i in (*range(len(words)), *rng.permutation(len(words)))]
    data = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    got = text.word_hashes(data, starts, starts + sizes, 21)
    by_word = {}
    for word, value in zip(words, got.tolist()):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word) > 1000
    assert text.word_hashes(data[:0], starts[:0], starts[:0], 21).tolist() == []
    assert (text.word_hashes(data, starts, starts + sizes, 22) != got).all()
