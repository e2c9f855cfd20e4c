"""Named datasets under one prefix, stored as parquet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Folder of each named dataset below the prefix.
FOLDERS = {
    "papers": "manuscripts-content-valid-with-sources",
    "abstracts_tokenized": "manuscripts-abstracts-tokenized",
    "titles_tokenized": "manuscripts-titles-tokenized",
    "token_frequencies": "manuscripts-tokens-total-frequencies",
    "token_doc_frequencies": "manuscripts-tokens-doc-frequencies",
    "token_idf_weights": "manuscripts-tokens-idf-weights",
    "tfidf_weights": "manuscripts-tfidf-weights",
    "word_vectors": "wordEmbeddingOnAbstracts",
    "paper_vectors": "manuscriptsEmbedding",
    "journal_vectors": "journalsEmbedding",
    "journal_year_vectors": "journalsEmbeddingPerYear",
    "area_one_hot": "areaOHE4classifData",
    "area_index": "areaOHEIndex",
    "area_performances": "areaOHEModelPerformances",
    "trending_reference": "trendingReference",
    "author_ambiguity": "authorsAmbiguity",
    "hindex": "hindex",
    "hindex_percentiles": "hindexRepartitionPerJournal",
    "coauthors_with_papers": "coAuthorsWithManuscripts",
}
# Fixed value: length of word, paper and journal vectors.
DIMENSION = 100

# Datasets whose stored column names differ from the working ones: bound by position.
_COLUMNS = {"word_vectors": ("word", "embedding"), "paper_vectors": ("id", "embedding")}


def save(df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def copy(df: DataFrame, path: str) -> None:
    """Snapshot of a source table."""
    save(df, path)


@dataclass(frozen=True)
class Catalog:
    """Where each dataset lives. ``overrides`` places single datasets elsewhere, e.g. to embed
    a new corpus with the idf weights and word vectors of another one."""

    prefix: str
    overrides: dict[str, str] = field(default_factory=dict)
    dimension: int = DIMENSION

    def path(self, name: str) -> str:
        if name not in FOLDERS:
            raise KeyError(name)
        return self.overrides.get(name, f"{self.prefix}/{FOLDERS[name]}")

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        df = spark.read.parquet(self.path(name))
        return df.toDF(*_COLUMNS[name]) if name in _COLUMNS else df

    def save(self, df: DataFrame, name: str, *, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
        save(df, self.path(name), mode=mode, partition_by=partition_by)
