"""Term statistics over token tables (id, terms)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from paperlens.operators.tokens import ids_with_terms, tokenize_texts


def _together(tables: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select("id", "terms") for t in tables])


def term_frequency(*tokenized: DataFrame) -> DataFrame:
    """Occurrences of each token over all given tables."""
    return (
        _together(tokenized).select(F.explode("terms").alias("token"))
        .groupBy("token").agg(F.count("*").alias("freq"))
    )


def doc_frequency(*tokenized: DataFrame, one_row_per_id: bool = False) -> DataFrame:
    """Distinct ids that contain each token.

    The tokens are shuffled once, by id: repeats are dropped in Arrow batches where the tokens of an id are, and tasks
    then send one number per token and not every pair of token and id. With ``one_row_per_id`` (all tables taken
    together) that shuffle is spared, too.
    """
    rows = _together(tokenized)
    if not one_row_per_id:
        return ids_with_terms(rows.where(F.col("id").isNotNull())).groupBy("token").agg(F.sum("_n").alias("freq"))
    tokens = rows.select("id", F.explode(F.array_distinct("terms")).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("freq"))


def idf_weights(doc_freq: DataFrame, *tokenized: DataFrame) -> DataFrame:
    """log(number of ids / ids with the token)."""
    documents = _together(tokenized).agg(F.countDistinct("id")).scalar()
    return doc_freq.select("token", F.log(documents / F.col("freq")).alias("weight"))


def vocabulary(abstracts: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term frequencies, document frequencies and idf weights of abstracts and titles together."""
    doc_freq = doc_frequency(abstracts, titles)
    return term_frequency(abstracts, titles), doc_freq, idf_weights(doc_freq, abstracts, titles)


def vocabulary_of_papers(papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``vocabulary`` straight from the texts of unique papers: title and abstract make one row."""
    both = papers.select("eid", F.concat_ws("\n", "title", "abstr").alias("text"))
    tokenized = tokenize_texts(both, "eid")
    doc_freq = doc_frequency(tokenized, one_row_per_id=True)
    return term_frequency(tokenized), doc_freq, idf_weights(doc_freq, tokenized.where(F.size("terms") > 0))
