"""Builds: each step reads catalog datasets and writes one or more of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from paperlens.operators import (
    authors as au, bow, classifiers, coauthors, embeddings, journals, onehot, papers, tokens,
    trending, vocabulary, wordvectors,
)
from paperlens.sources.catalog import Catalog, save


class CorpusBuild:
    """Clean papers and author pairs from raw papers."""

    def __init__(self, spark: SparkSession, catalog: Catalog, raw: DataFrame, authors_path: str) -> None:
        self.spark, self.catalog, self.raw, self.authors_path = spark, catalog, raw, authors_path

    def content(self) -> None:
        self.catalog.save(papers.extract_content(self.raw), "papers")

    def paper_authors(self) -> None:
        save(papers.paper_authors(self.raw), self.authors_path)

    def run(self) -> None:
        self.content()
        self.paper_authors()


class EmbeddingBuild:
    """Tokens, vocabulary, word vectors, paper vectors, journal vectors and area encodings."""

    def __init__(self, spark: SparkSession, catalog: Catalog, *, min_count: int = wordvectors.MIN_COUNT) -> None:
        self.spark, self.catalog, self.min_count = spark, catalog, min_count

    def _read(self, name: str) -> DataFrame:
        return self.catalog.read(self.spark, name)

    def tokenize(self) -> None:
        source = self._read("papers")
        self.catalog.save(tokens.tokenize_per_sentence(source, "eid", "abstr"), "abstracts_tokenized")
        self.catalog.save(tokens.tokenize_per_sentence(source, "eid", "title"), "titles_tokenized")

    def tokenize_masked(self, path: str) -> None:
        """Masked, lower-cased abstracts to a new folder; refuses to replace one."""
        save(tokens.tokenize_abstracts(self._read("papers")), path, mode="errorifexists")

    def vocabulary(self) -> None:
        frequencies, doc_frequencies, _ = vocabulary.vocabulary(
            self._read("abstracts_tokenized"), self._read("titles_tokenized")
        )
        self.catalog.save(frequencies, "token_frequencies")
        self.catalog.save(doc_frequencies, "token_doc_frequencies")
        idf = vocabulary.idf_weights(
            self._read("token_doc_frequencies"),
            self._read("abstracts_tokenized"), self._read("titles_tokenized"),
        )
        self.catalog.save(idf, "token_idf_weights")

    def word_vectors(self) -> None:
        fitted = wordvectors.fit_word_vectors(
            self._read("abstracts_tokenized"), self.catalog.dimension, min_count=self.min_count
        )
        self.catalog.save(wordvectors.word_vectors(fitted), "word_vectors")

    def tfidf(self) -> None:
        weighted = bow.tf_idf(self._read("abstracts_tokenized"), self._read("token_idf_weights"))
        self.catalog.save(bow.to_maps(weighted), "tfidf_weights")

    def paper_vectors(self) -> None:
        vectors = embeddings.embed_bow(
            bow.from_maps(self._read("tfidf_weights")), self._read("word_vectors"),
            dimension=self.catalog.dimension,
        )
        self.catalog.save(vectors, "paper_vectors")

    def journal_vectors(self) -> None:
        source, vectors, size = self._read("papers"), self._read("paper_vectors"), self.catalog.dimension
        by_journal, by_year = journals.journal_and_year_centroids(source, vectors, dimension=size)
        self.catalog.save(by_journal, "journal_vectors")
        self.catalog.save(by_year, "journal_year_vectors")

    def area_encoding(self) -> None:
        source = self._read("papers")
        self.catalog.save(onehot.area_index(source), "area_index")
        encoded = onehot.area_one_hot(source, self._read("paper_vectors"), self._read("area_index"))
        self.catalog.save(encoded, "area_one_hot")

    def area_models(self) -> None:
        """Not part of ``run``."""
        result = classifiers.all_areas_accuracy(self._read("area_one_hot"), self._read("area_index"))
        self.catalog.save(result, "area_performances")

    def trending(self) -> None:
        """Not part of ``run``."""
        result = trending.trending_reference(
            self._read("papers"), self._read("paper_vectors"), self._read("journal_year_vectors"),
        )
        self.catalog.save(result, "trending_reference")

    def run(self) -> None:
        self.tokenize()
        self.vocabulary()
        self.word_vectors()
        self.tfidf()
        self.paper_vectors()
        self.journal_vectors()
        self.area_encoding()


class AuthorBuild:
    """h-index tables, name ambiguity and co-author pairs."""

    def __init__(self, spark: SparkSession, catalog: Catalog, raw: DataFrame) -> None:
        self.spark, self.catalog, self.raw = spark, catalog, raw

    def hindex(self, *paths: str) -> None:
        """Latest h-index over snapshots given from old to new."""
        snapshots = [self.spark.read.parquet(p).toDF("auid", "hindex") for p in paths]
        self.catalog.save(au.latest_hindex(*snapshots), "hindex")

    def hindex_percentiles(self) -> None:
        result = au.hindex_percentiles(
            papers.issn_author_pairs(self.raw), self.catalog.read(self.spark, "hindex")
        )
        self.catalog.save(result, "hindex_percentiles")

    def ambiguity(self) -> None:
        self.catalog.save(au.author_ambiguity(papers.author_columns(self.raw)), "author_ambiguity")

    def _unambiguous(self, at_most: int) -> DataFrame:
        return au.unambiguous_authors(self.catalog.read(self.spark, "author_ambiguity"), at_most)

    def coauthors_with_papers(self, ambiguity: int = 1) -> None:
        pairs = coauthors.coauthors_with_papers(papers.paper_authors(self.raw), self._unambiguous(ambiguity))
        self.catalog.save(pairs, "coauthors_with_papers")

    def coauthor_pairs(self, path: str, *, ambiguity: int = 1, distinct: bool = True) -> None:
        pairs = coauthors.coauthor_pairs(
            papers.paper_authors(self.raw), self._unambiguous(ambiguity), distinct=distinct
        )
        save(pairs, path)

    def coauthors_by_journal(self, path: str, issns: Sequence[str], *, ambiguity: int = 1, distinct: bool = True) -> None:
        """One folder ``issn=...`` per journal, in a single write."""
        pairs = coauthors.coauthors_by_journal(
            papers.paper_authors(self.raw), issns, self._unambiguous(ambiguity), distinct=distinct
        )
        save(pairs, path, partition_by=("issn",))
