"""Raw papers to clean papers, exploded authors and areas, and their distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from paperlens.functions.dates import YEAR_PATTERN, is_sort_date, month_of, year_of
from paperlens.operators.frames import require_columns

# Fields that a complete paper has, and source fields that are kept.
CONTENT_COLUMNS = ("eid", "issn", "title", "abstr", "subjareas", "source")
SOURCE_COLUMNS = ("publishername", "sourcetitle", "sourcetitle_abbrev")
# Author fields of the wide author table, in output order.
AUTHOR_COLUMNS = (
    "auid", "orcid", "given_name", "given_name_pn", "surname", "surname_pn",
    "nametext", "indexed_name", "e_address_type",
)


def _complete(with_dates: bool, year_pattern: str) -> Column:
    present = F.lit(True)
    for name in CONTENT_COLUMNS:
        present = present & F.col(name).isNotNull()
    if with_dates:
        present = present & F.col("datesort").isNotNull() & is_sort_date(F.col("datesort"), year_pattern)
    return present


def extract_content(
    papers: DataFrame, *, with_dates: bool = True, year_pattern: str = YEAR_PATTERN
) -> DataFrame:
    """Complete papers with flattened source; ``with_dates`` adds year and month and checks the date."""
    require_columns(papers, *CONTENT_COLUMNS)
    dates = [year_of(F.col("datesort")).alias("year"), month_of(F.col("datesort")).alias("month")]
    return (
        papers.where(_complete(with_dates, year_pattern))
        .select(
            F.col("eid").cast("string").alias("eid"), "issn", "title", "abstr", "subjareas",
            *[F.col(f"source.{name}").alias(name) for name in SOURCE_COLUMNS],
            *(dates if with_dates else []),
        )
        .dropDuplicates()
    )


def titles(papers: DataFrame) -> DataFrame:
    return papers.select("title")


def abstracts(papers: DataFrame) -> DataFrame:
    return papers.select("abstr")


def paper_authors(papers: DataFrame, *columns: str) -> DataFrame:
    """One row per paper and author: ``columns`` of the paper, then auid. Papers without authors drop out."""
    columns = columns or ("eid", "issn")
    return papers.select(*columns, F.explode("au").alias("_au")).select(*columns, F.col("_au.auid").alias("auid"))


def author_columns(papers: DataFrame) -> DataFrame:
    return papers.select("eid", F.explode("au").alias("_au")).select(
        "eid", *[F.col(f"_au.{name}").alias(name) for name in AUTHOR_COLUMNS]
    )


def author_ids(papers: DataFrame, *, distinct: bool = False) -> DataFrame:
    ids = paper_authors(papers, "eid")
    return ids.distinct() if distinct else ids


def issn_author_pairs(papers: DataFrame) -> DataFrame:
    return paper_authors(papers.where(F.col("issn").isNotNull()), "issn").distinct()


def dated_paper_authors(papers: DataFrame, *, year_pattern: str = YEAR_PATTERN) -> DataFrame:
    """Authors of complete, dated papers; one row per paper and author."""
    return (
        papers.where(_complete(True, year_pattern))
        .select(
            "eid", "issn", "subjareas",
            year_of(F.col("datesort")).alias("year"), month_of(F.col("datesort")).alias("month"),
            F.explode(F.array_distinct("au.auid")).alias("auid"),
        )
        .dropDuplicates(["eid", "auid"])
    )


def explode_areas(papers: DataFrame) -> DataFrame:
    return papers.select("eid", F.explode("subjareas").alias("area"))


def having_any(df: DataFrame, column: str, values: Sequence[str] | DataFrame, *, negate: bool = False) -> DataFrame:
    """Rows whose ``column`` is (or is not) among ``values``: a list, or a table with that column."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column).distinct(), column, "left_anti" if negate else "left_semi")
    found = F.col(column).isin(list(values))
    return df.where(~found if negate else found)


def sharing_area(papers: DataFrame, areas: Sequence[str]) -> DataFrame:
    """Papers that have at least one of the given subject areas."""
    return papers.where(F.arrays_overlap("subjareas", F.array(*[F.lit(a) for a in areas])))


def _share_of(papers: DataFrame) -> Column:
    return F.col("freq") * F.lit(100.0) / papers.agg(F.count("*")).scalar()


def area_frequencies(papers: DataFrame) -> DataFrame:
    """Papers per area and their percentage of all papers, most frequent first."""
    return (
        explode_areas(papers).groupBy("area").agg(F.count("*").alias("freq"))
        .select("area", "freq", _share_of(papers).alias("pct")).orderBy(F.desc("freq"), "area")
    )


def journal_distribution(papers: DataFrame) -> DataFrame:
    return (
        papers.groupBy("sourcetitle").agg(F.count("*").alias("freq"))
        .select("sourcetitle", F.col("freq").alias("count"), _share_of(papers).alias("pct"))
        .orderBy(F.desc("count"), "sourcetitle")
    )


def subject_area_histogram(papers: DataFrame) -> DataFrame:
    return (
        papers.select(F.explode("subjareas").alias("subjectarea"))
        .groupBy("subjectarea").count().orderBy(F.desc("count"), "subjectarea")
    )


def journal_areas(papers: DataFrame) -> DataFrame:
    """All subject areas under which a journal has published."""
    return (
        papers.select("issn", F.explode("subjareas").alias("_area")).groupBy("issn")
        .agg(F.array_sort(F.collect_set("_area")).alias("subjareas"))
    )
