"""From raw documents to a training mix: five stages, each over all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  ``run`` writes every stage as Parquet to the
shared folder and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import decontaminate, mixing, ngram_join, pii, quality
from furrow.llm.queries import grades, table
from furrow.plans.session import shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is at least as likely as not; a null text is judged as an empty one."""
    model = quality.train(docs, grades(table(spark, sf_dir, "labels")), 3)
    return quality.select_good(docs, model)


def by_row(docs: DataFrame) -> DataFrame:
    """Rows with a number made from all their columns, ``_row``: equal rows share it, ids don't matter."""
    return docs.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: the smallest doc_id, null last; then any one, fixed.

    Groups are made of rows, so rows without an id and different rows of one id
    are judged by their own text.  Rows equal in every column stay once, and so
    does each distinct row without words.
    """
    rows = by_row(docs)
    groups = ngram_join.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("_row"), "component_id").distinct()
    heads = rows.select("_row", "doc_id").distinct().join(groups, "_row").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("head"))
    return rows.join(heads.select("head._row"), "_row", "left_semi").select(*docs.columns).dropDuplicates()


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark item, with or without an id; repeated rows stay repeated."""
    rows = by_row(docs)
    leaks = decontaminate.contaminated(
        rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    held = leaks.select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(held, "_row", "left_anti").select(*docs.columns)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked and disclosing terms taken out."""
    return pii.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each goes in.

    Rows of one doc_id in one leaf take the same place in its order; rows without
    language, source or text make leaves and tokens of their own (see ``mixing``).
    """
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", no_benchmark),
    ("PII", no_personal_data),
    ("mixing sources to target weights", mixed),
]

# a trained model and a random walk are not SQL; tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix over all documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
