"""Mean vectors of journals, by journal or by journal and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperlens.operators.embeddings import centroids
from paperlens.operators.frames import require_columns
from paperlens.session import checkpointed


def vectors_with_papers(papers: DataFrame, vectors: DataFrame, *columns: str | Column) -> DataFrame:
    """Paper vectors (id, embedding) with columns of their papers."""
    columns = columns or ("issn", "subjareas")
    require_columns(vectors, "id", "embedding")
    side = papers.select(F.col("eid").alias("id"), *columns)
    return vectors.select("id", "embedding").join(side, "id")


def journal_centroids(
    papers: DataFrame, vectors: DataFrame, *, dimension: int | None = None, areas: DataFrame | None = None
) -> DataFrame:
    """(id, embedding) per journal; with ``areas(issn, subjareas)`` also its subject areas."""
    means = centroids(vectors_with_papers(papers, vectors, "issn"), "issn", dimension=dimension)
    result = means.select(F.col("issn").alias("id"), "embedding")
    return result if areas is None else with_areas(result, areas)


def journal_year_centroids(
    papers: DataFrame, vectors: DataFrame, *, dimension: int | None = None, areas: DataFrame | None = None
) -> DataFrame:
    """(id, embedding, year) per journal and year; with ``areas`` also the subject areas."""
    rows = vectors_with_papers(papers, vectors, "issn", "year")
    means = centroids(rows, "issn", "year", dimension=dimension)
    result = means.select(F.col("issn").alias("id"), "embedding", "year")
    return result if areas is None else with_areas(result, areas)


def journal_and_year_centroids(
    papers: DataFrame, vectors: DataFrame, *, dimension: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both of the above from one pass over the vectors: years are averaged by their papers."""
    rows = vectors_with_papers(papers, vectors, "issn", "year")
    years = checkpointed(centroids(rows, "issn", "year", total="_papers", dimension=dimension))
    journals = centroids(years, "issn", weight="_papers", dimension=dimension)
    return (
        journals.select(F.col("issn").alias("id"), "embedding"),
        years.select(F.col("issn").alias("id"), "embedding", "year"),
    )


def with_areas(journal_vectors: DataFrame, areas: DataFrame) -> DataFrame:
    """Add the subject areas of the journal, an empty list if it has none."""
    known = areas.select(F.col("issn").alias("id"), "subjareas")
    none = F.array().cast("array<string>")
    return (
        journal_vectors.join(known, "id", "left")
        .withColumn("subjareas", F.coalesce("subjareas", none))
    )
