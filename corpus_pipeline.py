"""Stages that turn raw documents into encoded training text.

Quality rules, near duplicates, benchmark decontamination, secrets, tokens. Each stage takes
(spark, docs, sf_dir) and returns what the next one reads. All but the last return the columns of
``documents``: rejected documents, all but one of a class of near duplicates and contaminated
documents go; secrets in the texts of the others are masked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlens.llm import bpe, decontaminate, neardup, quality, secrets
from paperlens.session import ensure_checkpoint_dir, ship

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Language references, sampled signatures and BPE have no form in SQL.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality.good_documents(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest doc_id."""
    ship(spark)
    return neardup.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    ship(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows a changed text."""
    ship(spark)
    length = F.when(F.col("text").eqNullSafe(F.col("_before")), F.col("n_chars")).otherwise(
        F.length("text").cast(docs.schema["n_chars"].dataType))
    masked = secrets.redacted(docs.withColumn("_before", F.col("text")))
    return masked.withColumn("n_chars", length).drop("_before")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with the columns that say where it comes from."""
    ship(spark)
    return bpe.encode(docs, TOKENIZER).select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_quality),
    ("near duplicates", one_of_near_copies),
    ("decontamination", uncontaminated),
    ("secrets", without_secrets),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
