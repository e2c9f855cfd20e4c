import pytest

from paperlens import schemas
from paperlens.operators import papers as pp
from paperlens.operators import authors as au
from paperlens.sources.corpus import bind_papers


def author(auid, name="N"):
    return {f.name: {"auid": auid, "indexed_name": name}.get(f.name) for f in schemas.AUTHOR.fields}


def paper(**changes):
    base = {f.name: None for f in schemas.RAW_PAPER.fields}
    base.update(
        datesort="20150101", eid="1", issn="J", title="T", abstr="A", subjareas=["X"], au=[author("a")],
        source={f.name: {"publishername": "P", "sourcetitle": "S"}.get(f.name) for f in schemas.PAPER_SOURCE.fields},
    )
    base.update(changes)
    return base


@pytest.fixture
def raw(spark):
    def make(*dicts):
        return spark.createDataFrame([paper(**d) for d in dicts], schemas.RAW_PAPER)

    return make


def test_content(raw, rows):
    df = raw(
        {}, {}, {"title": "U"}, *[{"eid": f"n{c}", c: None} for c in
                                  ("issn", "title", "abstr", "subjareas", "source", "datesort")],
        {"eid": None}, {"eid": "2", "datesort": "20150231"}, {"eid": "3", "datesort": "2015-01-01"},
        {"eid": "4", "datesort": "20150131\n"}, {"eid": "5", "datesort": "20200101"},
    )
    content = pp.extract_content(df)
    assert content.schema.simpleString() == schemas.CLEAN_PAPER.simpleString()
    assert [(r[0], r[2], r[8], r[9]) for r in rows(content)] == [
        ("1", "T", 2015, 1), ("1", "U", 2015, 1), ("2", "T", 2015, 2)]
    undated = pp.extract_content(df, with_dates=False)
    assert undated.columns == schemas.CLEAN_PAPER.names[:-2]
    assert {r.eid for r in undated.collect()} == {"1", "2", "3", "4", "5", "ndatesort"}
    wider = pp.extract_content(df, year_pattern="20[0-9]{2}")
    assert {r.eid for r in wider.collect()} == {"1", "2", "5"}


def test_positional_binding(raw, spark):
    df = raw({}).withColumnsRenamed({"abstr": "abstract_text"}).withColumn("pmid", pp.F.lit("x"))
    assert bind_papers(df).columns == schemas.RAW_PAPER.names


def test_exploded_authors(raw, rows):
    df = raw(
        {"au": [author("a"), author("a"), author("b")]}, {"eid": "2", "au": None}, {"eid": "3", "au": []},
        {"eid": "4", "issn": None, "au": [author("c"), author(None)]},
    )
    assert rows(pp.paper_authors(df)) == [
        ("1", "J", "a"), ("1", "J", "a"), ("1", "J", "b"), ("4", None, "c"), ("4", None, None)]
    assert len(rows(pp.author_ids(df))) == 5 and len(rows(pp.author_ids(df, distinct=True))) == 4
    assert rows(pp.issn_author_pairs(df)) == [("J", "a"), ("J", "b")]
    assert pp.author_columns(df).columns == ["eid", *pp.AUTHOR_COLUMNS]
    assert rows(pp.dated_paper_authors(df).select("eid", "auid", "year", "month")) == [
        ("1", "a", 2015, 1), ("1", "b", 2015, 1)]


def test_only_needed_fields_are_read(raw, tmp_path, spark, plan):
    path = str(tmp_path / "raw")
    raw({}).write.parquet(path)
    text = plan(pp.paper_authors(spark.read.parquet(path)))
    assert "ReadSchema: struct<eid:string,issn:string,au:array<struct<auid:string>>>" in text
    text = plan(pp.extract_content(spark.read.parquet(path)))
    assert "PushedFilters: [IsNotNull(eid)" in text and "citations" not in text


def test_areas(raw, rows):
    df = raw({"subjareas": ["X", "Y"]}, {"eid": "2", "subjareas": ["Y"]}, {"eid": "3", "subjareas": None}, {"eid": "4", "subjareas": []})
    assert rows(pp.explode_areas(df)) == [("1", "X"), ("1", "Y"), ("2", "Y")]
    assert rows(pp.area_frequencies(df)) == [("X", 1, 25.0), ("Y", 2, 50.0)]
    assert pp.area_frequencies(df).first().area == "Y"
    assert [tuple(r) for r in pp.subject_area_histogram(df).collect()] == [("Y", 2), ("X", 1)]
    assert rows(pp.journal_areas(df)) == [("J", ("X", "Y"))]
    assert [r.eid for r in pp.sharing_area(df, ["X"]).collect()] == ["1"]


def test_membership(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    listed = spark.createDataFrame([("a",), ("a",)], "k string")
    assert rows(pp.having_any(df, "k", ["a"])) == [("a",)]
    assert rows(pp.having_any(df, "k", ["a"], negate=True)) == [("b",)]
    assert rows(pp.having_any(df, "k", listed)) == [("a",)]


def test_views(raw):
    df = raw({})
    assert pp.titles(df).columns == ["title"] and pp.abstracts(df).columns == ["abstr"]


def test_latest_hindex(spark, rows):
    def snap(*data):
        return spark.createDataFrame(list(data), "auid string, hindex long")

    old = snap(("old", 9), ("a", 50))
    new = snap(("a", 3), ("a", 4), ("b", 7), ("b", 7), ("c", 1))
    assert rows(au.latest_hindex(old, new)) == [("a", 4), ("b", 7), ("b", 7), ("c", 1), ("old", 9)]
    assert rows(au.latest_hindex(old, new, distinct=True)) == [("a", 4), ("b", 7), ("c", 1), ("old", 9)]


def test_authority(spark, rows):
    pairs = spark.createDataFrame([("J", "a"), ("J", "b"), ("J", "c"), ("K", "a"), ("J", "x")], "issn string, auid string")
    hindex = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 9)], "auid string, hindex long")
    ptiles = au.hindex_percentiles(pairs, hindex)
    assert rows(ptiles) == [("J", 1, 0.0), ("J", 2, 0.5), ("K", 1, 0.0)]
    requests = spark.createDataFrame(
        [("a", "J"), ("b", "J"), ("d", "J"), ("d", "nowhere"), ("unknown", "J")], "auid string, issn string")
    assert rows(au.academic_authority(requests, hindex, ptiles)) == [
        ("a", "J", 1, 0.0), ("b", "J", 2, 0.0), ("d", "J", 9, 1.0), ("d", "nowhere", 9, 1.0),
        ("unknown", "J", None, None)]


def test_ambiguity(spark, rows):
    names = spark.createDataFrame(
        [("a", "n"), ("a", "n"), ("b", "n"), ("b", None), ("c", "x"), ("c", "y"), ("c", "z")],
        "auid string, indexed_name string")
    ambiguity = au.author_ambiguity(names)
    assert rows(ambiguity) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(au.unambiguous_authors(ambiguity)) == [("a",), ("b",)]
    assert rows(au.unambiguous_authors(ambiguity, 0)) == [("a",)]


def test_newest_snapshot_counts_even_without_value(spark, rows):
    old = spark.createDataFrame([("a", 9), ("b", 3), ("c", None)], "auid string, hindex long")
    new = spark.createDataFrame([("a", None), ("b", 5), ("b", None), ("d", None), ("d", None)], "auid string, hindex long")
    assert rows(au.latest_hindex(old, new)) == rows(spark.createDataFrame(
        [("a", None), ("b", 5), ("c", None), ("d", None), ("d", None)], "auid string, hindex long"))
    assert au.latest_hindex(old, new, distinct=True).count() == 4
    huge = spark.createDataFrame([("a", 1 << 60), ("b", -(1 << 60))], "auid string, hindex long")
    assert rows(au.latest_hindex(old, huge)) == [("a", 1 << 60), ("b", -(1 << 60)), ("c", None)]
