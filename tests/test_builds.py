"""Catalog, sources and builds from raw parquet to every named dataset."""

import pytest
from pyspark.sql import functions as F

from paperlens.operators import (
    authors as au, bow, coauthors, embeddings, journals, onehot, papers as pp, tokens, trending, vocabulary,
)
from paperlens.plans.builds import AuthorBuild, CorpusBuild, EmbeddingBuild
from paperlens.schemas import AFFILIATION, AUTHOR_AFFILIATION, PAPER_TERM, RAW_PAPER
from paperlens.sources import catalog as cat, corpus, distributions
from workbench.tables import Tables


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("corpus"))


@pytest.fixture(scope="module")
def raw(spark, folder):
    partial = Tables(spark, "/root/testdata/sf0.001").raw_papers()
    full = partial.select(*[
        F.col(f.name) if f.name in partial.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in RAW_PAPER.fields
    ])
    full.withColumn("pmid", F.lit("x")).write.parquet(f"{folder}/raw")
    return corpus.read_papers(spark, f"{folder}/raw")


@pytest.fixture(scope="module")
def catalog(folder):
    return cat.Catalog(f"{folder}/out", dimension=8)


def test_schemas(raw):
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    assert raw.columns == RAW_PAPER.names
    assert [kinds[c].elementType for c in ("af", "au_af", "terms")] == [AFFILIATION, AUTHOR_AFFILIATION, PAPER_TERM]


def test_builds(spark, folder, raw, catalog, rows):
    CorpusBuild(spark, catalog, raw, f"{folder}/authors").run()
    papers = catalog.read(spark, "papers")
    assert papers.count() == 167
    assert corpus.read_paper_authors(spark, f"{folder}/authors").count() == 400

    build = EmbeddingBuild(spark, catalog, min_count=2)
    build.run()
    build.tokenize_masked(f"{folder}/masked")
    with pytest.raises(Exception, match="(?i)already exists"):
        build.tokenize_masked(f"{folder}/masked")
    build.trending()
    expected = {
        "abstracts_tokenized": ["id", "terms"], "titles_tokenized": ["id", "terms"],
        "token_frequencies": ["token", "freq"], "token_doc_frequencies": ["token", "freq"],
        "token_idf_weights": ["token", "weight"], "tfidf_weights": ["id", "weights"],
        "word_vectors": ["word", "embedding"], "paper_vectors": ["id", "embedding"],
        "journal_vectors": ["id", "embedding"], "journal_year_vectors": ["id", "embedding", "year"],
        "area_one_hot": ["id", "ohe", "features"], "area_index": ["area", "areaIndex"],
        "trending_reference": ["eid", "issn", "d2_diff", "ptile"],
    }
    for name, columns in expected.items():
        df = catalog.read(spark, name)
        assert (name, df.columns) == (name, columns) and df.count() > 0
    # Every stored dataset holds the rows of its operator.
    stored = {name: catalog.read(spark, name) for name in expected}
    abstracts, titles = (tokens.tokenize_per_sentence(papers, "eid", c) for c in ("abstr", "title"))
    frequencies, doc_frequencies, idf = vocabulary.vocabulary(abstracts, titles)
    weighted = bow.tf_idf(abstracts, idf)
    vectors = embeddings.embed_bow(weighted, stored["word_vectors"], dimension=8)
    by_journal, by_year = journals.journal_and_year_centroids(papers, vectors, dimension=8)
    index = onehot.area_index(papers)
    wanted = {
        "abstracts_tokenized": abstracts, "titles_tokenized": titles, "token_frequencies": frequencies,
        "token_doc_frequencies": doc_frequencies, "token_idf_weights": idf, "paper_vectors": vectors,
        "journal_vectors": by_journal, "journal_year_vectors": by_year, "area_index": index,
        "area_one_hot": onehot.area_one_hot(papers, vectors, index),
        "trending_reference": trending.trending_reference(papers, vectors, by_year),
    }
    for name, df in wanted.items():
        assert (name, rows(stored[name].select(df.columns), 4)) == (name, rows(df, 4))
    assert rows(bow.from_maps(stored["tfidf_weights"])) == rows(weighted)
    assert rows(papers.select("eid", "issn", "title", "year")) == rows(
        pp.extract_content(raw).select("eid", "issn", "title", "year"))
    assert rows(corpus.read_paper_authors(spark, f"{folder}/authors")) == rows(pp.paper_authors(raw))
    assert rows(spark.read.parquet(f"{folder}/masked")) == rows(tokens.tokenize_abstracts(papers))
    often = frequencies.where("freq >= 2").join(abstracts.select(F.explode("terms").alias("token")).groupBy("token").count(), "token")
    assert {r.word for r in stored["word_vectors"].collect()} == {r.token for r in often.where("count >= 2").collect()}
    assert catalog.read(spark, "paper_vectors").select(F.max(F.size("embedding"))).first()[0] == 8
    assert catalog.read(spark, "area_one_hot").select(F.max(F.size("ohe"))).first()[0] == 27

    issn = catalog.read(spark, "trending_reference").first().issn
    one = distributions.trending_reference_of(spark, catalog, issn).collect()
    assert [r.ptile for r in one] == sorted(r.ptile for r in one)


def test_author_builds(spark, folder, raw, catalog, rows):
    for name, given in {"h1": [("a1", 3), ("a2", 5)], "h2": [("a1", 4), ("b3", 9)]}.items():
        spark.createDataFrame(given, "id string, h long").write.parquet(f"{folder}/{name}")
    build = AuthorBuild(spark, catalog, raw)
    build.hindex(f"{folder}/h1", f"{folder}/h2")
    build.hindex_percentiles()
    build.ambiguity()
    build.coauthors_with_papers(ambiguity=10)
    build.coauthor_pairs(f"{folder}/pairs", ambiguity=10)
    build.coauthors_by_journal(f"{folder}/by_journal", ["src1", "src2"], ambiguity=10)
    hindex = {(r.auid, r.hindex) for r in catalog.read(spark, "hindex").collect()}
    assert hindex == {("a1", 4), ("a2", 5), ("b3", 9)}
    loaded = distributions.hindex_percentiles(spark, catalog)
    assert loaded.schema["hindex"].dataType.simpleString() == "double" and loaded.count() > 0
    issn = loaded.first().issn
    assert distributions.hindex_percentiles_of(spark, catalog, issn).columns == ["value", "ptile"]
    authors, stored = pp.paper_authors(raw), catalog.read(spark, "author_ambiguity")
    names = au.author_ambiguity(pp.author_columns(raw))
    clear = au.unambiguous_authors(names, 10)
    assert rows(stored.select(names.columns)) == rows(names)
    with_papers = coauthors.coauthors_with_papers(authors, clear)
    assert rows(catalog.read(spark, "coauthors_with_papers").select(with_papers.columns)) == rows(with_papers)
    pairs = coauthors.coauthor_pairs(authors, clear, distinct=True)
    assert rows(spark.read.parquet(f"{folder}/pairs").select("left", "right")) == rows(pairs) != []
    of_journals = coauthors.coauthors_by_journal(authors, ["src1", "src2"], clear, distinct=True)
    assert rows(spark.read.parquet(f"{folder}/by_journal").select("issn", "left", "right")) == rows(of_journals)
    ptiles = au.hindex_percentiles(pp.issn_author_pairs(raw), catalog.read(spark, "hindex"))
    assert rows(loaded) == rows(ptiles.withColumn("hindex", F.col("hindex").cast("double")))
    journals = {r.issn for r in spark.read.parquet(f"{folder}/by_journal").select("issn").distinct().collect()}
    assert journals == {"src1", "src2"}


def test_area_models_build(spark, folder, catalog, monkeypatch):
    other = cat.Catalog(f"{folder}/models", overrides={})
    rows = [(f"p{i}", [i % 2] + [0] * 26, [float(i % 2), i / 40]) for i in range(40)]
    other.save(spark.createDataFrame(rows, "id string, ohe array<int>, features array<double>"), "area_one_hot")
    other.save(spark.createDataFrame([("odd", 0)], "area string, areaIndex int"), "area_index")
    monkeypatch.setattr("paperlens.operators.classifiers.AREA_SLOTS", 27)
    EmbeddingBuild(spark, other).area_models()
    row = other.read(spark, "area_performances").first()
    assert (row.label, row.accuracy) == ("odd", 100.0)


def test_catalog_paths(spark):
    frozen = cat.Catalog("new", overrides={"word_vectors": "old/wordEmbeddingOnAbstracts"})
    assert frozen.path("word_vectors") == "old/wordEmbeddingOnAbstracts"
    assert frozen.path("hindex") == "new/hindex" and frozen.dimension == 100
    assert len(cat.FOLDERS) == 19
    with pytest.raises(KeyError):
        frozen.path("nothing")


def test_source_tables(spark, folder, rows):
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "x string, y long").write.parquet(f"{folder}/hindex0")
    hindex = corpus.read_hindex(spark, f"{folder}/hindex0")
    assert rows(hindex) == [("a", 1), ("b", 2)] and hindex.columns == ["auid", "hindex"]
    cat.copy(hindex, f"{folder}/copy")
    cat.copy(hindex, f"{folder}/copy")
    assert rows(spark.read.parquet(f"{folder}/copy")) == rows(hindex)
    spark.createDataFrame([("a", "2001")] * 2, "auid string, first_published string").write.parquet(f"{folder}/first")
    assert rows(corpus.read_first_publications(spark, f"{folder}/first")) == [("a", "2001")]
    spark.createDataFrame([("d", "i", "e", "r")] * 2, "a string, b string, c string, d string").write.parquet(f"{folder}/refs")
    references = corpus.read_references(spark, f"{folder}/refs")
    assert references.columns == ["datesort", "issn", "eid", "reference"] and references.count() == 1
    spark.read.parquet(f"{folder}/raw").drop("pmid").write.parquet(f"{folder}/extra")
    assert corpus.read_extra_papers(spark, f"{folder}/extra").columns == RAW_PAPER.names
