"""h-index histories, percentiles within journals, name ambiguity and authority."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlens.functions.percentile import percentile_in
from paperlens.operators.frames import lookup_join


def latest_hindex(*snapshots: DataFrame, distinct: bool = False) -> DataFrame:
    """(auid, hindex) of the newest snapshot an author is in (the last given is newest).

    Of several values there the largest counts; null only where there is no other. Exact copies of
    that row are kept unless ``distinct``. Copies are counted before the shuffle, so they never gather in
    one task, and per snapshot there is a column of one hash aggregate.
    """
    tagged = reduce(DataFrame.unionByName, [
        s.select("auid", F.col("hindex").cast("long").alias("hindex"), F.lit(i).alias("src"))
        for i, s in enumerate(snapshots)
    ])
    counted = tagged.groupBy("auid", "src", "hindex").agg(F.count("*").cast("int").alias("copies"))

    def within(i: int, column: str) -> Column:
        return F.when(F.col("src") == i, F.col(column))

    numbers = range(len(snapshots))
    newest = counted.groupBy("auid").agg(
        F.max("src").alias("newest"),
        *[F.max(within(i, "hindex")).alias(f"value{i}") for i in numbers],
        *[F.max_by(within(i, "copies"), within(i, "hindex")).alias(f"copies{i}") for i in numbers],
        *[F.sum(within(i, "copies")).cast("int").alias(f"rows{i}") for i in numbers],
    )

    def chosen(column: Callable[[int], Column]) -> Column:
        return reduce(lambda found, i: F.when(F.col("newest") == i, column(i)).otherwise(found), numbers, F.lit(None))

    rows = newest.select(
        "auid", chosen(lambda i: F.col(f"value{i}")).alias("hindex"),
        # Where all values are null, all rows are copies.
        chosen(lambda i: F.coalesce(f"copies{i}", f"rows{i}")).alias("copies"),
    )
    if distinct:
        return rows.select("auid", "hindex")
    return rows.select("auid", "hindex", F.explode(F.sequence(F.lit(1), "copies"))).select("auid", "hindex")


def value_percentiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (key, value, ptile) with ``percent_rank`` of the value among the rows of its key.

    Rows are first counted per value, so the window sees the distinct values of a key only;
    meant for metrics with few of them, such as an h-index.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("_count"))
    ordered = Window.partitionBy(key).orderBy(value)
    before = F.coalesce(F.sum("_count").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = F.sum("_count").over(Window.partitionBy(key))
    ptile = F.when(rows > 1, before / (rows - 1)).otherwise(F.lit(0.0))
    return counts.select(key, value, ptile.alias("ptile"))


def hindex_percentiles(journal_authors: DataFrame, hindex: DataFrame) -> DataFrame:
    """(issn, hindex, ptile) over the authors (issn, auid) of a journal; authors without h-index drop out."""
    known = journal_authors.select("issn", "auid").join(hindex.select("auid", "hindex"), "auid")
    return value_percentiles(known, "issn", "hindex")


def as_arrays(distribution: DataFrame, key: str, value: str) -> DataFrame:
    """(key, distribution): array<struct<value, ptile>> by value. One element per distinct value."""
    element = F.struct(F.col(value).cast("double").alias("value"), "ptile")
    return distribution.groupBy(key).agg(F.array_sort(F.collect_set(element)).alias("distribution"))


def academic_authority(requests: DataFrame, hindex: DataFrame, percentiles: DataFrame) -> DataFrame:
    """``requests(auid, issn)`` with ``authority``: percentile of the author's h-index in the journal.

    Null for an unknown author; 1 in a journal without distribution.
    """
    arrays = as_arrays(percentiles, "issn", "hindex")
    none = F.array().cast("array<struct<value: double, ptile: double>>")
    valued = requests.join(hindex.select("auid", "hindex"), "auid", "left")
    # A distribution has one element per distinct value of an h-index.
    return (
        lookup_join(valued, arrays, "issn", how="left", row_bytes=16_000)
        .withColumn("authority", percentile_in(F.col("hindex"), F.coalesce("distribution", none)))
        .select(*requests.columns, "hindex", "authority")
    )


def author_ambiguity(author_names: DataFrame) -> DataFrame:
    """(auid, ambiguity): number of different indexed names less one; no name counts as a name."""
    return (
        author_names.select("auid", "indexed_name").distinct().groupBy("auid")
        .agg((F.count("*") - 1).alias("ambiguity"))
    )


def unambiguous_authors(ambiguity: DataFrame, at_most: int = 1) -> DataFrame:
    return ambiguity.where(F.col("ambiguity") <= at_most).select("auid")
