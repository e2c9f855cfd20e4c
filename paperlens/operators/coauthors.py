"""Pairs of authors with a common paper, pairs of journals with common authors.

``authors`` is a table (eid, issn, auid) with one row per paper and author;
``unambiguous`` a table (auid) that restricts it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from paperlens.operators.frames import pairs_within


def _restricted(authors: DataFrame, unambiguous: DataFrame | None) -> DataFrame:
    return authors if unambiguous is None else authors.join(unambiguous, "auid", "left_semi")


def _both_ways(pairs: DataFrame, *columns: str) -> DataFrame:
    """Unordered pairs to rows in both directions, an element paired with itself to one row."""
    way = F.struct("left", "right")
    back = F.struct(F.col("right").alias("left"), F.col("left").alias("right"))
    ways = F.when(F.col("left") == F.col("right"), F.array(way)).otherwise(F.array(way, back))
    return pairs.select(*columns, F.explode(ways).alias("_way")).select(*columns, "_way.left", "_way.right")


def coauthor_pairs(authors: DataFrame, unambiguous: DataFrame | None = None, *, distinct: bool) -> DataFrame:
    """(left, right) for any two different authors of a paper, in both directions."""
    rows = _restricted(authors.select("eid", "auid"), unambiguous)
    if distinct:
        rows = rows.distinct()
    pairs = pairs_within(rows, "eid", "auid", ordered=lambda a, b: a < b).select("left", "right")
    return _both_ways(pairs.distinct() if distinct else pairs)


def coauthors_with_papers(authors: DataFrame, unambiguous: DataFrame | None = None) -> DataFrame:
    """(eid, issn, left, right) for any two different authors of a paper; issn of the left row."""
    rows = _restricted(authors.select("eid", "issn", "auid"), unambiguous)
    pairs = pairs_within(rows, "eid", "auid", ["issn"], ordered=lambda a, b: a != b)
    return pairs.select("eid", "issn", "left", "right")


def reachable_papers(papers: DataFrame, authors: DataFrame, issns: Sequence[str]) -> DataFrame:
    """Papers by any author who published in one of the journals."""
    roots = authors.where(F.col("issn").isin(list(issns))).select("auid").distinct()
    eids = authors.join(roots, "auid", "left_semi").select("eid").distinct()
    return papers.join(eids, "eid", "left_semi")


def reachable_authors(authors: DataFrame, issns: Sequence[str]) -> DataFrame:
    """(eid, auid) of the papers reachable from the journals."""
    return reachable_papers(authors, authors, issns).select("eid", "auid")


def coauthors_by_journal(
    authors: DataFrame, issns: Sequence[str], unambiguous: DataFrame | None = None, *, distinct: bool
) -> DataFrame:
    """(issn, left, right) of the given journals, whose papers are reachable from them by definition."""
    listed = F.col("issn").isin(list(issns))
    rows = authors.join(authors.where(listed).select("eid").distinct(), "eid", "left_semi")
    pairs = coauthors_with_papers(rows, unambiguous).where(listed).select("issn", "left", "right")
    return pairs.distinct() if distinct else pairs


def cojournal_counts(authors: DataFrame, unambiguous: DataFrame | None = None) -> DataFrame:
    """(left, right, count): authors that published in both journals, the journal with itself included."""
    rows = _restricted(authors.select("issn", "auid"), unambiguous).distinct()
    halves = pairs_within(rows, "auid", "issn", ordered=lambda a, b: a <= b)
    return _both_ways(halves.groupBy("left", "right").count(), "count").select("left", "right", "count")
