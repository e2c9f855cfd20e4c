"""Stored percentile distributions, for all journals or for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlens.sources.catalog import Catalog


def ordered_hindex_percentiles(percentiles: DataFrame) -> DataFrame:
    """(issn, hindex as double, ptile) in order of journal and percentile."""
    return (
        percentiles.select("issn", F.col("hindex").cast("double").alias("hindex"), "ptile")
        .orderBy("issn", "ptile")
    )


def hindex_percentiles(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return ordered_hindex_percentiles(catalog.read(spark, "hindex_percentiles"))


def distribution_of(percentiles: DataFrame, issn: str, value: str) -> DataFrame:
    """(value, ptile) of one journal, ordered; the journal filter reaches the scan."""
    return (
        percentiles.where(F.col("issn") == issn)
        .select(F.col(value).cast("double").alias("value"), "ptile").orderBy("ptile")
    )


def hindex_percentiles_of(spark: SparkSession, catalog: Catalog, issn: str) -> DataFrame:
    return distribution_of(catalog.read(spark, "hindex_percentiles"), issn, "hindex")


def trending_reference_of(spark: SparkSession, catalog: Catalog, issn: str) -> DataFrame:
    return distribution_of(catalog.read(spark, "trending_reference"), issn, "d2_diff")
