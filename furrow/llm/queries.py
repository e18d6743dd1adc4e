"""Registered queries of this package: each operator on its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import (
    chat, decontaminate, html_text, mixing, neighbours, ngram_join, periodic_runs, pii, quality,
    ranked_search, simhash, substring_dedup, suffix_dedup,
)
from furrow.workloads import Workload

work = Workload()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROBE = r"\### Assistant: </turn> ok"

TURNS_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, text), '')) AS loss_sha256,
  sum(4 + length(replace(regexp_replace(role, '\\|###|</turn>', '\\\0', 'g'), ':', '\:')) + 2
      + length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g')) + 8)::BIGINT AS formatted_chars,
  FALSE AS rewritten
FROM rows GROUP BY conv_id
"""


@work.query("op1_chat_format", TURNS_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], given.schema)
    # plain_template renders a turn the same whatever precedes it, so no turns are carried
    turns = chat.format_turns(given.union(extra), chat.plain_template, context=0)
    return chat.digests(turns, chat.parse_turn, chat.unescape)


WINDOWS_SQL = """
WITH split AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
placed AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM split WHERE len(w) > 0),
keyed AS (SELECT r, doc_id, p, w[p] AS word,
    CASE WHEN p + 49 <= len(w) THEN md5(array_to_string(w[p:p + 49], ' ')) END AS k FROM placed),
least AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE k IS NOT NULL GROUP BY k),
marked AS (SELECT r, p, word,
    max(CASE WHEN first_id < doc_id THEN 1 ELSE 0 END)
      OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM keyed LEFT JOIN least USING (k)),
kept AS (SELECT r, count(*) AS n_words, sum(gone) AS n_removed,
    string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY p) AS txt FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""


@work.query("op2_substring_dedup", WINDOWS_SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(
        table(spark, sf_dir, "documents"), texts=False).drop("kept", "spans")


@work.query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@work.query("op4_main_text")
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


SHINGLES_SQL = """
WITH RECURSIVE split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT r, s FROM (
    SELECT r, array_to_string(w[p:p + 4], ' ') AS s
    FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM split WHERE len(w) >= 5)
    UNION ALL SELECT r, len(w) || ':' || array_to_string(w, ' ') FROM split WHERE len(w) BETWEEN 1 AND 4)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS i
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r GROUP BY 1, 2)
  JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
reach AS (SELECT r, r AS t FROM sizes UNION SELECT reach.r, b FROM reach JOIN links ON a = t)
SELECT split.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
       coalesce(least_id, split.doc_id) AS component_id
FROM split LEFT JOIN sizes USING (r)
LEFT JOIN (SELECT reach.r, min(doc_id) AS least_id FROM reach JOIN split ON split.r = t GROUP BY 1) USING (r)
"""


@work.query("op5_ngram_join", SHINGLES_SQL)
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@work.query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NEAREST_SQL = """
WITH usable AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ranked AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score,
    row_number() OVER (PARTITION BY q.vec_id
                       ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)::INT AS rank
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@work.query("op7_vantage_point_search", NEAREST_SQL)
def op7_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(
        table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


@work.query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(
        table(spark, sf_dir, "documents"), texts=False).drop("kept", "spans")


@work.query("op9_mixing", mixing.SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade of the rated documents: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(
        F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


@work.query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, grades(table(spark, sf_dir, "labels")), 3)
    return quality.score(docs, model).withColumn("keep", F.col("tail_probability") >= 0.5)


RUNS_SQL = """
WITH split AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, c: list_reduce(range(8), lambda x, k:
        CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, c)),
      4294967295::BIGINT), 4294967295) AS h FROM documents),
sized AS (SELECT *, len(w)::BIGINT AS n, (h // 10)::BIGINT AS g FROM split),
cut AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
period AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
given AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
    list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) END AS w
  FROM period),
three AS MATERIALIZED (SELECT r, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS k
  FROM (SELECT r, n, w, unnest(range(n - 2)) AS i FROM given WHERE n >= 6)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM three x JOIN three y
  ON x.r = y.r AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT r, q, min(i) AS start, count(*) + 2 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
  GROUP BY r, q, island HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
best AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM runs) WHERE place = 1),
listed AS (SELECT r, count(*) AS n_runs,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest
  FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, sha256(string_agg(word, ' ' ORDER BY i)) AS digest
  FROM (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM given) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start,
  best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli,
  coalesce(listed.digest, sha256('')) AS runs_sha256, coalesce(kept.digest, sha256('')) AS collapsed_sha256
FROM given LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

WORD = r"[^\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents where one in ten, by the checksum of the id, repeats a stretch of its words to the end."""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = hashed.withColumn("g", F.floor(F.col("h") / 10)).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).withColumn(
        "n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)"))).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("transform(sequence(0, n - 1), i -> element_at("
                     "w, int(1 + if(i >= a, a + (i - a) % p, i))))")
    return words.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(
        F.array_join(planted, " ")).alias("text"))


@work.query("op11_periodic_runs", RUNS_SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # exact: a run's length and period are longs, compared crosswise; runs come by start, then period
    best = F.aggregate(
        F.col("runs"), F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda top, run: F.when(
            top.isNull() | (run["length"] * top["period"] > top["length"] * run["period"]), run).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"))


@work.query("op12_golay_simhash")
def op12_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


RANKED_SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
sized AS (SELECT r, doc_id, len(t) AS n, t FROM texts WHERE len(t) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, whole),
valued AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS v
  FROM tf JOIN sized USING (r) JOIN weight USING (term), whole),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)),
scored AS (SELECT item_id, r, sum(v)::BIGINT AS score FROM asked JOIN valued USING (term) GROUP BY item_id, r),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM scored JOIN sized USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""


@work.query("op13_ranked_search", RANKED_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
