"""Readers of the source tables; columns are bound by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlens.schemas import HINDEX, PAPER_AUTHOR, RAW_PAPER, REFERENCE


def bind_papers(df: DataFrame) -> DataFrame:
    return df.drop("pmid").toDF(*RAW_PAPER.names)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Raw papers; an extra ``pmid`` column is ignored."""
    return bind_papers(spark.read.parquet(path))


def read_extra_papers(spark: SparkSession, path: str) -> DataFrame:
    """A supplementary corpus of exactly the raw columns."""
    return spark.read.parquet(path).toDF(*RAW_PAPER.names)


def read_paper_authors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*PAPER_AUTHOR.names)


def bind_hindex(df: DataFrame) -> DataFrame:
    return df.toDF(*HINDEX.names).dropDuplicates()


def read_hindex(spark: SparkSession, path: str) -> DataFrame:
    return bind_hindex(spark.read.parquet(path))


def read_first_publications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).dropDuplicates()


def bind_references(df: DataFrame) -> DataFrame:
    return df.toDF(*REFERENCE.names).dropDuplicates()


def read_references(spark: SparkSession, path: str) -> DataFrame:
    return bind_references(spark.read.parquet(path))
