"""Queries of the text and training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import names, packing, provenance, sentences, tokenizer
from chronoweave.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not hand-written source of their repository."""
    return provenance.not_hand_written(table(spark, sf_dir, "file_blobs")).select("repository_name", "path")


def p1_written_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions and deletions of each repository, by who made them: people, or how else the file came about."""
    verdicts = provenance.not_hand_written(table(spark, sf_dir, "file_blobs"))
    changes = table(spark, sf_dir, "file_change_facts").groupBy("repository_name", F.col("file.path").alias("path")).agg(
        F.sum("file.additions").alias("additions"), F.sum("file.deletions").alias("deletions"), F.count(F.lit(1)).alias("n_changes")
    )
    joined = changes.join(verdicts, ["repository_name", "path"], "left")
    return joined.groupBy("repository_name", F.coalesce("verdict", F.lit("written")).alias("origin")).agg(
        F.sum("n_changes").alias("n_changes"), F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of identities that stand for the same person or organisation."""
    return names.identity_pairs(table(spark, sf_dir, "identities"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", tokenizer.token_ids(spark, F.col("text")).alias("ids"))


CONTAINER_TOKENS = 2_048


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of 2,048 tokens."""
    documents = table(spark, sf_dir, "documents")
    lengths = documents.select(F.col("doc_id").alias("item_id"), tokenizer.token_count(spark, F.col("text")).alias("length"))
    return packing.pack(lengths, CONTAINER_TOKENS).withColumnRenamed("item_id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_written_volume, p4_found, p6_ids, p7_containers, p8_found)}
ORACLE: dict[str, str] = {}
