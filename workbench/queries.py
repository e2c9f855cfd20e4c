"""The registered queries: each operator over the whole given tables, in long, rounded form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlens.functions.vectors import add, dense, divide, scale
from paperlens.operators.frames import indexed, percent_ranked
from paperlens.operators import (
    authors as au, bow, classifiers, coauthors, embeddings, journals, logistic, neighbors, onehot, originality,
    pagerank, papers as pp, percentiles, scope, tokens, trending, vocabulary, wordvectors,
)
from paperlens.session import checkpointed, ensure_checkpoint_dir, ship, written
from paperlens.plans.builds import AuthorBuild, CorpusBuild, EmbeddingBuild
from paperlens.sources import corpus
from paperlens.sources.catalog import Catalog, copy, save
from paperlens.sources.corpus import bind_hindex, bind_references
from paperlens.sources.distributions import distribution_of, hindex_percentiles, ordered_hindex_percentiles
from workbench.tables import VECTOR_DIMENSION, WORD_DIMENSION, Tables

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}

AREAS = ["A1", "de"]
JOURNALS = ["src1", "src6", "src11"]
ROOT_JOURNAL = ["J7"]
NEIGHBOURS = 20
PAGERANK_ROUNDS = 20


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(Tables(spark, folder))

        return run

    return {name: bound(fn) for name, fn in QUERIES.items()}


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def long_form(df: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", "value")).select(*keys, "pos", r6("value"))


def joined(name: str) -> Column:
    return F.array_join(F.array_sort(name), ",").alias(name)


# --- papers

def _content(df: DataFrame) -> DataFrame:
    dates = [F.col(c).cast("int").alias(c) for c in ("year", "month") if c in df.columns]
    return df.select(
        "eid", "issn", "title", "abstr", joined("subjareas"),
        "publishername", "sourcetitle", "sourcetitle_abbrev", *dates,
    )


@query
def clean_content(t: Tables) -> DataFrame:
    return _content(pp.extract_content(t.raw_papers()))


@query
def clean_content_no_dates(t: Tables) -> DataFrame:
    return _content(pp.extract_content(t.raw_papers(), with_dates=False))


@query
def paper_authors_explode(t: Tables) -> DataFrame:
    return pp.paper_authors(t.raw_papers())


@query
def author_columns_explode(t: Tables) -> DataFrame:
    return pp.author_columns(t.raw_papers())


@query
def author_ids_explode(t: Tables) -> DataFrame:
    return pp.author_ids(t.raw_papers())


@query
def issn_author_pairs(t: Tables) -> DataFrame:
    return pp.issn_author_pairs(t.raw_papers())


@query
def valid_paper_authors(t: Tables) -> DataFrame:
    rows = pp.dated_paper_authors(t.raw_papers())
    return rows.select(
        "eid", "issn", joined("subjareas"), F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"), "auid",
    )


@query
def subject_areas_explode(t: Tables) -> DataFrame:
    return pp.explode_areas(t.papers())


@query
def papers_sharing_area(t: Tables) -> DataFrame:
    return pp.sharing_area(t.papers(), AREAS).select("eid", "issn", joined("subjareas"))


@query
def papers_not_in_journals(t: Tables) -> DataFrame:
    return pp.having_any(t.papers(), "issn", JOURNALS, negate=True).select("eid", "issn")


@query
def area_frequencies(t: Tables) -> DataFrame:
    return pp.area_frequencies(t.papers()).select("area", "freq", r6("pct"))


@query
def journal_distribution(t: Tables) -> DataFrame:
    return pp.journal_distribution(t.papers()).select("sourcetitle", "count", r6("pct"))


@query
def subject_area_histogram(t: Tables) -> DataFrame:
    return pp.subject_area_histogram(t.papers())


@query
def journal_subject_areas(t: Tables) -> DataFrame:
    return pp.journal_areas(t.papers()).select("issn", joined("subjareas"))


@query
def references_dedupe(t: Tables) -> DataFrame:
    return bind_references(t.citations())


@query
def hindex_copies_dropped(t: Tables) -> DataFrame:
    """h-indexes of lines, as a source that repeats its rows."""
    rows = t.given("lineitem").select(F.col("l_suppkey").cast("string"), (F.col("l_partkey") % 50).cast("int"))
    return bind_hindex(rows)


# --- text

def _exploded(tokenized: DataFrame) -> DataFrame:
    return tokenized.select("id", "sentence", F.posexplode("terms").alias("pos", "term"))


@query
def mask_numeric_expressions(t: Tables) -> DataFrame:
    return tokens.mask_texts(t.papers().select("eid", "abstr"), "abstr")


@query
def tokenize_sentences(t: Tables) -> DataFrame:
    return _exploded(tokens.tokenize_per_sentence(t.papers(), "eid", "abstr", with_position=True))


@query
def mask_lower_tokenize(t: Tables) -> DataFrame:
    return _exploded(tokens.tokenize_per_sentence(
        t.papers(), "eid", "abstr", masked=True, lower=True, with_position=True
    ))


@query
def tokenize_texts_lower(t: Tables) -> DataFrame:
    rows = tokens.tokenize_texts(t.submissions(), "query_id", token_fn=F.lower)
    return rows.select("id", F.posexplode("terms").alias("pos", "term"))


def _abstracts(t: Tables) -> DataFrame:
    return tokens.tokenize_per_sentence(t.papers(), "eid", "abstr")


def _titles(t: Tables) -> DataFrame:
    return tokens.tokenize_per_sentence(t.papers(), "eid", "title")


def _stored_abstracts(t: Tables) -> DataFrame:
    """Tokens as a stored table, as the jobs that use them more than once would find them."""
    return written(_abstracts(t), "abstracts")


def _idf(t: Tables, abstracts: DataFrame | None = None) -> DataFrame:
    stored = _stored_abstracts(t) if abstracts is None else abstracts
    return checkpointed(vocabulary.vocabulary(stored, written(_titles(t), "titles"))[2])


@query
def term_frequency(t: Tables) -> DataFrame:
    return vocabulary.term_frequency(_abstracts(t), _titles(t))


@query
def doc_frequency(t: Tables) -> DataFrame:
    return vocabulary.doc_frequency(_abstracts(t), _titles(t))


@query
def doc_frequency_of_papers(t: Tables) -> DataFrame:
    return vocabulary.vocabulary_of_papers(t.papers())[1]


@query
def idf_weights_of_papers(t: Tables) -> DataFrame:
    return vocabulary.vocabulary_of_papers(t.papers())[2].select("token", r6("weight"))


@query
def idf_weights(t: Tables) -> DataFrame:
    return _idf(t).select("token", r6("weight"))


@query
def tfidf_bow(t: Tables) -> DataFrame:
    abstracts = _stored_abstracts(t)
    return bow.tf_idf(abstracts, _idf(t, abstracts)).select("id", "term", F.round("weight", 9).alias("weight"))


@query
def tfidf_maps(t: Tables) -> DataFrame:
    abstracts = _stored_abstracts(t)
    maps = bow.to_maps(bow.tf_idf(abstracts, _idf(t, abstracts)))
    return bow.from_maps(maps).select("id", "term", F.round("weight", 9).alias("weight"))


@query
def submission_bow(t: Tables) -> DataFrame:
    texts = tokens.tokenize_texts(t.submissions(), "query_id")
    rows = bow.submission_bow(texts, _idf(t), one_row_per_id=True)
    return rows.select("id", "term", F.round("weight", 9).alias("weight"))


def _paper_word_vectors(t: Tables, words: DataFrame) -> DataFrame:
    """From stored bags of words."""
    abstracts = _stored_abstracts(t)
    maps = written(bow.to_maps(bow.tf_idf(abstracts, _idf(t, abstracts))), "bags")
    return embeddings.embed_bow(bow.from_maps(maps), words, dimension=WORD_DIMENSION)


@query
def paper_embedding_weighted_mean(t: Tables) -> DataFrame:
    return long_form(_paper_word_vectors(t, checkpointed(t.word_vectors())), "id")


@query
def paper_embedding_from_texts(t: Tables) -> DataFrame:
    words = checkpointed(t.word_vectors())
    return long_form(embeddings.embed_texts(
        t.papers(), words, _idf(t), id="eid", text="abstr", dimension=WORD_DIMENSION
    ), "id")


@query
def submission_embedding(t: Tables) -> DataFrame:
    words = checkpointed(t.word_vectors())
    return long_form(embeddings.embed_submissions(
        t.submissions(), words, _idf(t), dimension=WORD_DIMENSION
    ), "query_id")


@query
def word2vec_vectors(t: Tables) -> DataFrame:
    """Which words get a vector, and its length; the values come from random starts."""
    fitted = wordvectors.fit_word_vectors(_abstracts(t), VECTOR_DIMENSION)
    return wordvectors.word_vectors(fitted).select("word", F.size("embedding").alias("dimension"))


# --- vectors and journals

def _centroids(t: Tables) -> DataFrame:
    return journals.journal_centroids(t.papers(), t.vectors(), dimension=VECTOR_DIMENSION)


def _year_centroids(t: Tables) -> DataFrame:
    return journals.journal_year_centroids(t.papers(), t.vectors(), dimension=VECTOR_DIMENSION)


def _journal_queries(t: Tables) -> DataFrame:
    return _centroids(t).withColumnRenamed("id", "query_id")


@query
def vector_arithmetic(t: Tables) -> DataFrame:
    """Three times a vector and itself, divided by eight."""
    v = F.col("embedding")
    return long_form(t.vectors().select("id", divide(add(scale(v, F.lit(3)), v), F.lit(8)).alias("embedding")), "id")


@query
def l2_all_pairs_to_queries(t: Tables) -> DataFrame:
    return neighbors.l2_distances(_journal_queries(t), t.vectors()).select("query_id", "id", r6("d2"))


@query
def knn_papers(t: Tables) -> DataFrame:
    queries = t.vectors().withColumnRenamed("id", "query_id")
    return neighbors.nearest(queries, t.vectors(), 5).select("query_id", "id", r6("d2"), "rank")


@query
def knn_papers_by_index(t: Tables) -> DataFrame:
    """As for queries too many to broadcast: through the blocks of the pivot index."""
    queries = t.vectors().withColumnRenamed("id", "query_id")
    return neighbors.nearest(queries, t.vectors(), 5, broadcast_queries=0).select("query_id", "id", r6("d2"), "rank")


@query
def knn_to_journals(t: Tables) -> DataFrame:
    return neighbors.nearest(_journal_queries(t), t.vectors(), 10).select("query_id", "id", r6("d2"), "rank")


@query
def k_farthest(t: Tables) -> DataFrame:
    return neighbors.nearest(_journal_queries(t), t.vectors(), 10, farthest=True).select(
        "query_id", "id", r6("d2"), "rank"
    )


@query
def k_best_by_order(t: Tables) -> DataFrame:
    """Caller's order: whole distances first, then falling id."""
    order = [(pc.floor(pc.multiply(pc.field("d2"), pc.scalar(10.0))), "ascending"), (pc.field("id"), "descending")]
    return neighbors.best_under(_journal_queries(t), t.vectors(), 7, order).select("query_id", "id", r6("d2"), "rank")


@query
def journal_centroids(t: Tables) -> DataFrame:
    return long_form(_centroids(t), "id")


@query
def journal_year_centroids(t: Tables) -> DataFrame:
    rows = _year_centroids(t).withColumn("year", F.col("year").cast("int"))
    return long_form(rows, "id", "year")


def _area_table(t: Tables) -> DataFrame:
    return pp.journal_areas(t.papers())


@query
def journal_centroids_with_areas(t: Tables) -> DataFrame:
    rows = journals.with_areas(_centroids(t), _area_table(t)).withColumn("subjareas", joined("subjareas"))
    return long_form(rows, "id", "subjareas")


@query
def journal_year_centroids_with_areas(t: Tables) -> DataFrame:
    rows = journals.with_areas(_year_centroids(t), _area_table(t)).withColumn("subjareas", joined("subjareas"))
    return long_form(rows.withColumn("year", F.col("year").cast("int")), "id", "year", "subjareas")


@query
def journal_centroids_from_years(t: Tables) -> DataFrame:
    by_journal, _ = journals.journal_and_year_centroids(t.papers(), t.vectors(), dimension=VECTOR_DIMENSION)
    return long_form(by_journal, "id")


@query
def area_index(t: Tables) -> DataFrame:
    return onehot.area_index(t.papers())


@query
def area_onehot(t: Tables) -> DataFrame:
    """All slots as one text, all features as rows."""
    rows = onehot.area_one_hot(t.papers(), t.vectors()).withColumn("flags", F.array_join("ohe", ""))
    return long_form(rows, "id", "flags", vector="features")


@query
def issn_freq_for_areas(t: Tables) -> DataFrame:
    return onehot.issn_frequency(t.papers(), AREAS)


@query
def journal_index(t: Tables) -> DataFrame:
    return onehot.journal_index(t.papers(), AREAS)


@query
def journal_onehot(t: Tables) -> DataFrame:
    """Written out from the sparse form."""
    rows = onehot.journal_one_hot(t.papers(), AREAS)
    return rows.select("id", F.posexplode(dense(F.col("ohe"))).alias("slot", "flag"))


@query
def journal_onehot_sparse(t: Tables) -> DataFrame:
    return onehot.journal_one_hot(t.papers(), AREAS).select("id", "ohe.size", "ohe.slot")


# --- classifiers

# A number of gradient steps that SQL can state, too; Newton's method is the default.
STEPS = logistic.Gradient(steps=20, rate=2.0)


@query
def area_lr_accuracy(t: Tables) -> DataFrame:
    hits, total = classifiers.area_accuracy(0, onehot.area_one_hot(t.papers(), t.vectors()), solver=STEPS)
    return t.spark.createDataFrame([(0, hits, total)], "areaIndex int, fitcount long, totalcount long")


@query
def all_areas_lr(t: Tables) -> DataFrame:
    index = onehot.area_index(t.papers())
    data = onehot.area_one_hot(t.papers(), t.vectors(), index)
    rows = classifiers.all_areas_accuracy(data, index, slots=index.count(), solver=STEPS)
    return rows.select("label", "fitcount", "totalcount", r6("accuracy"))


@query
def area_lr_evaluation(t: Tables) -> DataFrame:
    data = onehot.area_one_hot(t.papers(), t.vectors())
    model, training, testing = classifiers.train_area_model(0, data, solver=STEPS)
    rows = classifiers.evaluate_model(model, training=training, testing=testing)
    rates = ("accuracy", "prevalence", "recall", "specificity", "ppv", "npv")
    return rows.select(*[r6(c) if c in rates else c for c in rows.columns])


@query
def journal_one_vs_others(t: Tables) -> DataFrame:
    return classifiers.one_journal_against_others(t.papers(), t.vectors(), AREAS, JOURNALS, solver=STEPS)


@query
def classifier_metrics(t: Tables) -> DataFrame:
    labels = t.given("labels").select(
        (F.col("doc_id") % 4).alias("set"), F.col("quality").cast("double").alias("label"),
        F.col("toxic").cast("double").alias("prediction"),
    )
    rows = classifiers.evaluate(labels, "set")
    rates = ("accuracy", "prevalence", "recall", "specificity", "ppv", "npv")
    return rows.select(*[r6(c) if c in rates else c for c in rows.columns])


@query
def merged_evaluations(t: Tables) -> DataFrame:
    """Sums of the evaluations of classifier_metrics over all sets."""
    labels = t.given("labels").select(
        (F.col("doc_id") % 4).alias("part"), (F.col("doc_id") % 2).alias("set"),
        F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("prediction"),
    )
    rows = classifiers.merge_evaluations(classifiers.evaluate(labels, "set", "part"), "set")
    rates = ("accuracy", "prevalence", "recall", "specificity", "ppv", "npv")
    return rows.select(*[r6(c) if c in rates else c for c in rows.columns])


# --- authors

def _hindex(t: Tables) -> DataFrame:
    return au.latest_hindex(*t.hindex_snapshots())


@query
def latest_hindex(t: Tables) -> DataFrame:
    return _hindex(t)


@query
def journal_hindex_percent_rank(t: Tables) -> DataFrame:
    """One row per author: the form for values too many to list by journal."""
    rows = t.journal_authors().join(_hindex(t), "auid")
    return percent_ranked(rows, "issn", "hindex").select("issn", "auid", "hindex", r6("ptile"))


@query
def hindex_percentile_by_journal(t: Tables) -> DataFrame:
    return au.hindex_percentiles(t.journal_authors(), _hindex(t)).select("issn", "hindex", r6("ptile"))


@query
def academic_authority(t: Tables) -> DataFrame:
    """Suppliers ask for the authority of customers of their number, some of whom are unknown authors."""
    known = checkpointed(_hindex(t))
    ptiles = au.hindex_percentiles(t.journal_authors(), known)
    return au.academic_authority(t.authority_requests(), known, ptiles).select("issn", "auid", "hindex", r6("authority"))


@query
def percentile_normalize(t: Tables) -> DataFrame:
    """Balances in hundreds against the h-index distribution of the segment."""
    requests = t.given("customer").select(
        "c_custkey", F.col("c_mktsegment").alias("issn"), (F.col("c_acctbal") / 100).alias("x")
    )
    ptiles = au.hindex_percentiles(t.journal_authors(), _hindex(t))
    return percentiles.normalize(requests, ptiles, "issn", "x", "hindex").select(
        "c_custkey", "issn", r6("normalized")
    )


@query
def author_ambiguity(t: Tables) -> DataFrame:
    return au.author_ambiguity(t.author_names())


def _unambiguous(t: Tables) -> DataFrame:
    return au.unambiguous_authors(au.author_ambiguity(t.author_names()), 1)


@query
def unambiguous_authors(t: Tables) -> DataFrame:
    return _unambiguous(t)


@query
def coauthor_pairs(t: Tables) -> DataFrame:
    return coauthors.coauthor_pairs(t.paper_authors(), distinct=False)


@query
def coauthor_pairs_distinct(t: Tables) -> DataFrame:
    return coauthors.coauthor_pairs(t.paper_authors(), _unambiguous(t), distinct=True)


@query
def coauthors_with_papers(t: Tables) -> DataFrame:
    return coauthors.coauthors_with_papers(t.paper_authors(), _unambiguous(t))


@query
def coauthors_by_journal(t: Tables) -> DataFrame:
    return coauthors.coauthors_by_journal(t.paper_authors(), ["J7", "J8"], _unambiguous(t), distinct=True)


@query
def papers_reachable_from_journal(t: Tables) -> DataFrame:
    """Authors of the text papers: two per paper."""
    authors = t.dated_authors()
    return coauthors.reachable_papers(t.papers(), authors, JOURNALS[:1]).select("eid", "issn")


@query
def authors_reachable(t: Tables) -> DataFrame:
    return coauthors.reachable_authors(t.dated_authors(), JOURNALS[:1])


@query
def cojournal_counts(t: Tables) -> DataFrame:
    return coauthors.cojournal_counts(t.paper_authors(), _unambiguous(t))


@query
def coauthor_pagerank_fixed(t: Tables) -> DataFrame:
    ranks = pagerank.coauthor_pagerank(
        t.paper_authors(), ROOT_JOURNAL, _unambiguous(t), distinct=True, rounds=PAGERANK_ROUNDS
    )
    return ranks.select("auid", r6("pageRank"))


@query
def coauthor_pagerank_repeated_fixed(t: Tables) -> DataFrame:
    ranks = pagerank.coauthor_pagerank(
        t.paper_authors(), ROOT_JOURNAL, distinct=False, rounds=PAGERANK_ROUNDS
    )
    return ranks.select("auid", r6("pageRank"))


@query
def coauthor_pagerank_converged(t: Tables) -> DataFrame:
    """Rounds until the ranks stand still; the given number of decimals is far above the tolerance."""
    ranks = pagerank.coauthor_pagerank(t.paper_authors(), ROOT_JOURNAL, distinct=False, tolerance=1e-7)
    return ranks.select("auid", F.round("pageRank", 4).alias("pageRank"))


@query
def ordered_hindex_distribution(t: Tables) -> DataFrame:
    """Places in the order of the loader, which rows alone do not show."""
    ptiles = au.hindex_percentiles(t.journal_authors(), _hindex(t))
    return indexed(ordered_hindex_percentiles(ptiles), ["issn", "ptile"], "place").select(
        "place", "issn", "hindex", r6("ptile"))


@query
def distribution_of_one_journal(t: Tables) -> DataFrame:
    ptiles = au.hindex_percentiles(t.journal_authors(), _hindex(t))
    return distribution_of(ptiles, "BUILDING", "hindex").select("value", r6("ptile"))


@query
def coauthors_written_by_journal(t: Tables) -> DataFrame:
    """One folder per journal in a single write, read back."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/coauthors-{uuid.uuid4().hex}"
    pairs = coauthors.coauthors_by_journal(t.paper_authors(), ["J7", "J8"], _unambiguous(t), distinct=True)
    save(pairs, folder, partition_by=("issn",))
    return t.spark.read.parquet(folder).select("issn", "left", "right")


# --- dimensions

@query
def originality_pairs(t: Tables) -> DataFrame:
    pairs = originality.originality_pairs(t.dated_authors(), t.vectors())
    both = F.arrays_zip(F.col("embedding").alias("a"), F.col("embedding_asc").alias("b"))
    elements = pairs.select("eid", "issn", "eid_asc", F.posexplode(both).alias("pos", "x"))
    return elements.select(
        "eid", "issn", "eid_asc", "pos", F.round("x.a", 6).alias("value"), F.round("x.b", 6).alias("value_asc"))


@query
def originality_pairs_strict(t: Tables) -> DataFrame:
    return originality.earlier_paper_pairs(t.dated_authors(), t.vectors(), strict=True)


@query
def originality_distances(t: Tables) -> DataFrame:
    pairs = originality.originality_pairs(t.dated_authors(), t.vectors())
    distances = originality.originality_distances(pairs)
    return distances.select("eid", "issn", "eid_asc", r6("d2"))


@query
def originality_distances_by_author(t: Tables) -> DataFrame:
    return originality.author_distances(t.dated_authors(), t.vectors()).select("eid", "issn", "eid_asc", r6("d2"))


@query
def trending_reference(t: Tables) -> DataFrame:
    rows = trending.trending_reference(t.papers(), t.vectors(), _year_centroids(t))
    return rows.select("eid", "issn", r6("d2_diff"), r6("ptile"))


@query
def trending_reference_of_one_journal(t: Tables) -> DataFrame:
    rows = trending.trending_reference(t.papers(), t.vectors(), _year_centroids(t))
    return distribution_of(rows, "src1", "d2_diff").select(r6("value"), r6("ptile"))


@query
def trending_scores(t: Tables) -> DataFrame:
    centroids = checkpointed(_year_centroids(t))
    reference = trending.trending_reference(t.papers(), t.vectors(), centroids)
    submissions = trending.paper_submissions(t.papers(), t.vectors())
    rows = trending.trending_scores(submissions, centroids, reference)
    return rows.select("query_id", "issn", r6("d2_diff"), r6("trending"))


def _scope_papers(t: Tables) -> DataFrame:
    return scope.paper_submissions(t.papers(), t.vectors())


@query
def reference_histogram(t: Tables) -> DataFrame:
    rows = scope.reference_histograms(_scope_papers(t), t.papers())
    return rows.select("query_id", "issn", "n_ref", r6("share_ref"))


@query
def neighbor_histogram(t: Tables) -> DataFrame:
    rows = scope.neighbour_histograms(_scope_papers(t), t.papers(), t.vectors(), NEIGHBOURS)
    return rows.select("query_id", "issn", "n_test", r6("share_test"))


@query
def neighbor_histogram_by_index(t: Tables) -> DataFrame:
    """Areas decide which blocks of the index a paper visits."""
    rows = scope.neighbour_histograms(_scope_papers(t), t.papers(), t.vectors(), NEIGHBOURS, broadcast_queries=0)
    return rows.select("query_id", "issn", "n_test", r6("share_test"))


@query
def scope_match_scores(t: Tables) -> DataFrame:
    rows = scope.scope_scores(_scope_papers(t), t.papers(), t.vectors(), NEIGHBOURS)
    return rows.select(
        "query_id", "target_issn", "issn", "n_ref", "total_ref", "n_test", "total_test", r6("score")
    )


@query
def scope_match_value(t: Tables) -> DataFrame:
    submissions = _scope_papers(t)
    scores = scope.scope_scores(submissions, t.papers(), t.vectors(), NEIGHBOURS)
    return scope.scope_values(submissions, t.papers(), scores).select("query_id", "target_issn", r6("value"))


@query
def scope_match_histograms(t: Tables) -> DataFrame:
    rows = scope.scope_histograms(_scope_papers(t), t.papers(), t.vectors(), NEIGHBOURS)
    return rows.select("query_id", "issn", "n_ref", r6("share_ref"), "n_test", r6("share_test"), r6("score"))


@query
def scope_contrast_papers(t: Tables) -> DataFrame:
    return scope.contrast_papers(t.papers(), t.vectors(), _centroids(t)).select("eid", "id", r6("d2"), "rank")


def _text_vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Vectors of all papers and of the submissions from their texts."""
    idf, words = _idf(t), checkpointed(t.word_vectors())
    papers = checkpointed(embeddings.embed_texts(
        t.papers(), words, idf, id="eid", text="abstr", dimension=WORD_DIMENSION
    ))
    sent = embeddings.embed_submissions(t.submissions(), words, idf, dimension=WORD_DIMENSION)
    return papers, t.submissions().drop("text").join(sent, "query_id")


@query
def scope_match_for_texts(t: Tables) -> DataFrame:
    vectors, submissions = _text_vectors(t)
    scores = scope.scope_scores(submissions, t.papers(), vectors, NEIGHBOURS)
    return scope.scope_values(submissions, t.papers(), scores).select("query_id", "target_issn", r6("value"))


@query
def trending_for_texts(t: Tables) -> DataFrame:
    vectors, submissions = _text_vectors(t)
    centroids = checkpointed(journals.journal_year_centroids(t.papers(), vectors, dimension=WORD_DIMENSION))
    reference = trending.trending_reference(t.papers(), vectors, centroids)
    sent = submissions.withColumnRenamed("target_issn", "issn")
    rows = trending.trending_scores(sent, centroids, reference)
    return rows.select("query_id", "issn", r6("d2_diff"), r6("trending"))


# --- sources, sinks and builds: what they store in the shared folder, read back

def _new_folder(t: Tables) -> str:
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/build-{uuid.uuid4().hex}"


def _corpus_build(t: Tables) -> tuple[CorpusBuild, str]:
    """From raw papers as the source stores them, with the column that readers ignore."""
    folder = _new_folder(t)
    save(t.full_raw_papers().withColumn("pmid", F.lit("x")), f"{folder}/raw")
    build = CorpusBuild(t.spark, Catalog(f"{folder}/std"), corpus.read_papers(t.spark, f"{folder}/raw"), f"{folder}/authors")
    build.run()
    return build, folder


@query
def corpus_build_content(t: Tables) -> DataFrame:
    build, _ = _corpus_build(t)
    return _content(build.catalog.read(t.spark, "papers"))


@query
def corpus_build_authors(t: Tables) -> DataFrame:
    _, folder = _corpus_build(t)
    return corpus.read_paper_authors(t.spark, f"{folder}/authors")


@query
def extra_papers_content(t: Tables) -> DataFrame:
    folder = _new_folder(t)
    save(t.full_raw_papers(), folder)
    return _content(pp.extract_content(corpus.read_extra_papers(t.spark, folder), with_dates=False))


@query
def titles_and_abstracts(t: Tables) -> DataFrame:
    titles = pp.titles(t.papers()).select(F.lit("title").alias("kind"), F.col("title").alias("body"))
    return titles.union(pp.abstracts(t.papers()).select(F.lit("abstract"), "abstr"))


@query
def first_publications_deduped(t: Tables) -> DataFrame:
    folder = _new_folder(t)
    save(t.dated_authors().select("auid", F.col("year").cast("int").alias("year")), folder)
    return corpus.read_first_publications(t.spark, folder)


@query
def hindex_snapshot_copied(t: Tables) -> DataFrame:
    """A snapshot is written over an older copy."""
    folder = _new_folder(t)
    older, newer = t.raw_hindex_snapshots()
    copy(older, folder)
    copy(newer, folder)
    return corpus.read_hindex(t.spark, folder)


def _embedding_build(t: Tables, *steps: str) -> EmbeddingBuild:
    """Steps of the build over all papers, with the given word vectors in place of trained ones."""
    catalog = Catalog(_new_folder(t), dimension=WORD_DIMENSION)
    catalog.save(t.papers(), "papers")
    build = EmbeddingBuild(t.spark, catalog)
    for step in steps:
        if step == "word_vectors":
            catalog.save(t.word_vectors(), "word_vectors")
        else:
            getattr(build, step)()
    return build


@query
def masked_abstracts_stored_once(t: Tables) -> DataFrame:
    """The second write is refused and leaves the first."""
    build = _embedding_build(t)
    folder = f"{build.catalog.prefix}/masked"
    build.tokenize_masked(folder)
    try:
        build.tokenize_masked(folder)
    except AnalysisException as refused:
        if "exist" not in str(refused).lower():
            raise
    else:
        raise AssertionError("an existing folder was replaced")
    return t.spark.read.parquet(folder).select("id", F.posexplode("terms").alias("pos", "term"))


@query
def embedding_build_vectors(t: Tables) -> DataFrame:
    build = _embedding_build(t, "tokenize", "vocabulary", "word_vectors", "tfidf", "paper_vectors")
    return long_form(build.catalog.read(t.spark, "paper_vectors"), "id")


@query
def embedding_build_journals(t: Tables) -> DataFrame:
    build = _embedding_build(t, "tokenize", "vocabulary", "word_vectors", "tfidf", "paper_vectors", "journal_vectors")
    return long_form(build.catalog.read(t.spark, "journal_vectors"), "id")


@query
def embedding_build_areas(t: Tables) -> DataFrame:
    build = _embedding_build(t)
    build.catalog.save(t.vectors(), "paper_vectors")
    build.area_encoding()
    rows = build.catalog.read(t.spark, "area_one_hot").withColumn("flags", F.array_join("ohe", ""))
    return long_form(rows, "id", "flags", vector="features")


def _author_build(t: Tables) -> AuthorBuild:
    folder = _new_folder(t)
    save(t.full_raw_papers(), f"{folder}/raw")
    return AuthorBuild(t.spark, Catalog(f"{folder}/std"), corpus.read_papers(t.spark, f"{folder}/raw"))


@query
def author_build_percentiles(t: Tables) -> DataFrame:
    build = _author_build(t)
    paths = [f"{build.catalog.prefix}/snapshot-{i}" for i in (0, 1)]
    for snapshot, path in zip(t.raw_hindex_snapshots(), paths, strict=True):
        save(snapshot, path)
    build.hindex(*paths)
    build.hindex_percentiles()
    return hindex_percentiles(t.spark, build.catalog).select("issn", "hindex", r6("ptile"))


@query
def author_build_pairs(t: Tables) -> DataFrame:
    build = _author_build(t)
    build.ambiguity()
    build.coauthor_pairs(f"{build.catalog.prefix}/pairs", ambiguity=4)
    return t.spark.read.parquet(f"{build.catalog.prefix}/pairs").select("left", "right")


@query
def author_build_pairs_with_papers(t: Tables) -> DataFrame:
    build = _author_build(t)
    build.ambiguity()
    build.coauthors_with_papers(ambiguity=4)
    return build.catalog.read(t.spark, "coauthors_with_papers").select("eid", "issn", "left", "right")
