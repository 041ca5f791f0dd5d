"""From raw documents to packed training sequences, one operator per stage.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import batches, ngram_join, packing, quality, toxicity
from tidemark.operators.skew import fits_broadcast
from tidemark.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts fail. Rows without a doc_id go too: later stages could not tell them apart. Each row is judged by
    itself, so repeated rows stay or go together. An empty table stays empty.
    """
    judged = quality.judge_rows(docs.filter("doc_id IS NOT NULL")).filter("kept")
    return judged.select("_doc.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 under a model trained on the labels of this stage's documents.

    Null and empty texts score 0 and stay, as does everything when no labels teach a model. Rows are judged one by one.
    """
    batches.bound(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels)
    return docs.filter(toxicity.score_column(F.col("text"), model) < 0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates the row with the smallest doc_id, of rows sharing that id the one read first.

    Rows are told apart by a key of their own, so rows that share a doc_id are judged one by one: each goes only for its own text. Equal rows are copies like
    any others. Documents without words are linked with nothing and stay.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct("*").alias("_doc")), "numbered")
    found = materialize(ngram_join.jaccard_components(
        rows.select(F.col("_key").alias("doc_id"), F.col("_doc.text").alias("text"))), "components")
    groups = found.filter("doc_id <> component_id").select("component_id").distinct()
    members = found.join(groups, "component_id", "left_semi").select(F.col("doc_id").alias("_key"), "component_id")
    members = materialize(members.join(rows.select("_key", F.col("_doc.doc_id").alias("_id")), "_key"), "members")
    kept = members.groupBy("component_id").agg(F.min_by("_key", F.struct("_id", "_key")).alias("_key"))
    gone = members.select("_key").join(kept.select("_key"), "_key", "left_anti")
    gone = materialize(gone, "copies")
    return rows.join(F.broadcast(gone) if fits_broadcast(gone) else gone, "_key", "left_anti").select("_doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 tokens; see :func:`packing.pack_documents` for the columns and missing values."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good_quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("packing", packed),
]

ORACLE_SQL = None  # the stages are models, searches and tokenizers; tests check each against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
