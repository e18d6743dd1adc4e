import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from furrow.llm import chat, mixing, neighbours, quality
from furrow.llm.queries import PROBE, grades

SF = "/root/testdata/sf0.001"


def test_turns_read_back(spark):
    odd = ["", None, PROBE, "\\", "\\\\###", "</turn>\n### user: x", "####", "é", "a" * 5000, "</turn></turn>"]
    rows = [(1, k, "assistant" if k % 2 else "us:er", t) for k, t in enumerate(odd)]
    rows += [(None, 1, None, "x"), (2, None, "system", "s"), (2, 0, "user", "u"), (2, 0, "user", "u")]
    rows += [(3, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(100)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    turns = chat.format_turns(table)
    got = {r["conv_id"]: r for r in chat.digests(turns, chat.parse_turn, chat.unescape).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        every = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.plain_template([(a, b) for _, _, a, b in own]))
        assert not r["rewritten"]
    assert chat.format_turns(table.where("false")).collect() == []


def test_templates_that_rewrite_history():
    turns = [("user", "one"), ("assistant", "two"), ("user", "three"), ("assistant", "four")]

    def forgetful(given):
        last = max((i for i, t in enumerate(given) if t[0] == "user"), default=0)
        return "".join(f"<{r}>{x if i >= last else '...'}</{r}>" for i, (r, x) in enumerate(given))

    def closing(given):
        return "".join(f"<{r}>{x}" for r, x in given) + "<end>"

    assert chat.render_incrementally(forgetful, turns).rewritten == 0
    done = chat.render_incrementally(closing, turns)
    assert done.rewritten is None
    assert [done.output[a:b] for a, b in done.texts] == ["one", "two", "three", "four"]


@pytest.mark.parametrize("head,foot", [("<{}>", "<end>"), ("[{}] ", "[us"), ("{}: ", "\n"), ("<{}>", "</s>")])
@pytest.mark.parametrize("preamble", ["", "<s>", "<use"])
def test_spans_of_closed_templates(head, foot, preamble):
    def closed(given):
        return preamble + "".join(head.format(r) + x + "\n" for r, x in given) + foot

    turns = [("user", "hi<"), ("assistant", "<yo"), ("user", ""), ("user", "<end"), ("assistant", "bye")]
    done = chat.render_incrementally(closed, turns)
    assert done.rewritten is None
    parts = [done.output[a:b] for a, b in done.spans]
    want = [head.format(r) + x + "\n" for r, x in turns]
    assert parts == [*want[:-1], want[-1] + foot]
    assert [done.output[a:b] for a, b in done.texts] == [x for _, x in turns]


def test_context_carries_over_pieces(spark):
    def counted(given):
        return "".join(f"[{'same' if i and given[i - 1][0] == r else 'new'} {r}]{x}" for i, (r, x) in enumerate(given))

    rows = [(1, k, "user" if k % 3 else "assistant", f"t{k}") for k in range(50)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = counted([(r, x) for _, _, r, x in rows])
    for context, piece in ((1, 4), (None, 4)):
        got = chat.format_turns(table, counted, context, piece=piece).orderBy("place").collect()
        assert "".join(r["part"] for r in got) == whole


def test_rewriting_is_seen_beyond_a_piece(spark):
    def opened(given):
        return "<start>" * bool(given) + "".join(f"<{r}>{x}" for r, x in given)

    def last_thought(given):  # thoughts stay only after the last user turn
        last = max((i for i, t in enumerate(given) if t[0] == "user"), default=0)
        return "".join(f"<{r}>{x if i > last or r == 'user' else x[:2]}" for i, (r, x) in enumerate(given))

    rows = [(1, k, "user" if k in (0, chat.PIECE) else "assistant", f"t{k:03d}") for k in range(chat.PIECE + 8)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_turns(table, opened).orderBy("place").collect()
    assert "".join(r["part"] for r in got) == opened([(r, x) for _, _, r, x in rows])
    assert not any(r["rewritten"] for r in got)
    got = chat.format_turns(table, last_thought).orderBy("place").collect()
    assert [r["rewritten"] for r in got] == [False] + [True] * (chat.PIECE + 7)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1)
                                  for i, v in rows], "vec_id long, embedding array<float>, shard int")


def nearest_by_hand(rows, top):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in [i for i in good if i % 20 == 0]:
        scored = sorted((-float(np.add.accumulate(a * good[q][0])[-1]), i) for i in good if i != q
                        for a in good[i][:1] if len(a) == len(good[q][0]))
        out[q] = [(i, -s) for s, i in scored[:top]]
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 70])
def test_exact_search(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.2, 1, 5])).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]  # many equal vectors: ties by id
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [1, None, 0, 0, 0, 0]), (2020, [math.nan] * 6),
             (2040, [math.inf, 0, 0, 0, 0, 0]), (None, [1] * 6), (2060, [1.0, 2.0]), (rows[5][0], rows[5][1])]
    got = neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=shard_rows, block_rows=9)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = nearest_by_hand(rows, 20)
    assert {q: w for q, w in want.items() if w} == found


def test_relaxed_search_recall():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    points = centres[rng.integers(0, 40, 6000)] + 0.25 * rng.normal(size=(6000, 32))
    tree, queries = neighbours.VantageTree(points, 64), points[::60] + 0.05 * rng.normal(size=(100, 32))
    true = [set(np.argsort(((points - q) ** 2).sum(axis=1))[:20].tolist()) for q in queries]
    recall = {}
    for slack in (1.0, 1.3):
        search = neighbours.Search(tree, queries, 20, slack)
        search.run()
        recall[slack] = np.mean([len(true[k] & set(search.candidates(k).tolist())) / 20 for k in range(100)])
    assert recall[1.0] == 1.0 and recall[1.3] >= 0.9


def test_nothing_to_search(spark):
    assert neighbours.nearest(vectors(spark, [(1, [1.0])]).where("false"), F.col("vec_id") > 0).collect() == []


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 100), ("a", "x", "s2", 10), ("a", "y", "s3", 400),
                                    ("b", "x", "s4", 1000)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(
        leaves, F.lit(400), 1, {"domain": {"a": 1, "b": 1}, "lang": {"x": 3, "y": 1}}, 1).collect()}
    # a gets 200, its x would get 150 but holds 110, so y gets the other 90; s2's shortage goes to s1
    assert got == {"s1": 100, "s2": 10, "s3": 90, "s4": 200}


def test_mix_equals_sql(spark, documents, corpus):
    rows = [(i, t, (None, "en", "de")[k % 3], (None, "src2", "src7", "src12", "odd", "src99999999999")[k % 6])
            for k, (i, t) in enumerate(corpus)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, slot int")
    con = duckdb.connect()
    con.register("documents", table.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(f"SELECT doc_id, domain, lang, source, n_tokens, copies FROM ({mixing.SQL})").fetchall()
    got = [tuple(r) for r in mixing.mix(table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert mixing.mix(table.where("false")).collect() == []


def test_words_count(spark):
    values = ["", " ", "a", " a\n b\t", "a b c", None, "a  b"]
    table = spark.createDataFrame([(v,) for v in values], "text string")
    assert [r[0] for r in table.select(mixing.words()).collect()] == [0, 0, 1, 2, 2, 0, 2]


def test_pipeline_is_its_stages_over_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        kept = spark.createDataFrame(after.collect(), docs.schema)
    want = sorted(map(str, corpus_pipeline.STAGES[4][1](spark, kept, SF).collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == want
    assert 0 < kept.count() < docs.count()


def test_stages_decide_by_row(spark, tmp_path, documents):
    words = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(None, words(1)), (None, words(1)), (None, words(1) + " more"), (5, words(1)), (None, words(2)),
            (None, words(2) + " end"), (7, words(3)), (7, words(4)), (8, words(4)), (9, None), (10, ""),
            (None, None), (11, words(5)), (11, words(5))]
    got = sorted(map(str, ((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(
        spark, documents(rows), SF).collect())))
    singles = [(5, words(1)), (7, words(3)), (7, words(4)), (9, None), (10, ""), (None, None), (11, words(5))]
    either = [sorted(map(str, [*singles, (None, words(2) + tail)])) for tail in ("", " end")]
    assert got in either

    spark.createDataFrame([(1, words(3)), (None, words(2))], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.no_benchmark(spark, documents(rows), str(tmp_path)).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(
        str(r) for r in rows if r[1] is None or not r[1].startswith((words(2), words(3))))
    empty = documents([])
    for stage in (corpus_pipeline.one_of_each_group, corpus_pipeline.no_benchmark, corpus_pipeline.no_personal_data):
        out = stage(spark, empty, SF)
        assert out.columns == empty.columns and out.collect() == []


def test_a_rated_id_that_repeats_is_gathered_once(spark):
    docs = spark.range(500).selectExpr("if(id < 400, 1, id) AS doc_id", "concat('text ', id % 3) AS text")
    graded = spark.createDataFrame([(1, 2), (450, 1)], "doc_id long, grade int")
    *_, grade = quality.graded_sample(docs, graded)
    assert grade.tolist() == [2, 1]


def test_graded_labels(spark):
    table = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert [r["grade"] for r in grades(table).orderBy("doc_id").collect()] == [2, 1, 0, None]


def test_queries_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert quality.SAMPLE == 12_000
