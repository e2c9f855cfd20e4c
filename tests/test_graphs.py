import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paperlens.functions.vectors import sq_l2
from paperlens.operators import coauthors, frames, originality, pagerank


@pytest.fixture(scope="module")
def authors(spark):
    return spark.createDataFrame([
        ("1", "J", "a"), ("1", "J", "b"), ("1", "J", "a"), ("2", "K", "a"), ("2", "K", "b"), ("2", "K", "c"),
        ("3", "L", "d"), ("4", "L", "c"), ("4", "L", "e"), ("5", "M", "f"), ("5", "M", "g"), ("5", "M", None),
    ], "eid string, issn string, auid string")


def test_pairs(spark, authors, rows):
    pairs = rows(coauthors.coauthor_pairs(authors, distinct=False))
    assert pairs.count(("a", "b")) == 3 and pairs.count(("b", "a")) == 3
    assert sorted((b, a) for a, b in pairs) == pairs
    assert all(a != b for a, b in pairs)
    distinct = coauthors.coauthor_pairs(authors, distinct=True)
    assert rows(distinct) == sorted(set(pairs))
    only = spark.createDataFrame([("a",), ("b",)], "auid string")
    assert rows(coauthors.coauthor_pairs(authors, only, distinct=True)) == [("a", "b"), ("b", "a")]


def test_pairs_with_papers(authors, rows):
    pairs = rows(coauthors.coauthors_with_papers(authors))
    assert pairs.count(("1", "J", "a", "b")) == 2 and ("4", "L", "c", "e") in pairs
    by_journal = rows(coauthors.coauthors_by_journal(authors, ["J", "L"], distinct=True))
    assert by_journal == [("J", "a", "b"), ("J", "b", "a"), ("L", "c", "e"), ("L", "e", "c")]


def test_reachable(spark, authors, rows):
    papers = authors.select("eid", "issn").distinct()
    assert [r[0] for r in rows(coauthors.reachable_papers(papers, authors, ["J"]))] == ["1", "2"]
    assert rows(coauthors.reachable_authors(authors, ["L"]).distinct()) == [
        ("2", "a"), ("2", "b"), ("2", "c"), ("3", "d"), ("4", "c"), ("4", "e")]


def test_cojournals(authors, rows):
    wanted = {("J", "J"): 2, ("J", "K"): 2, ("K", "J"): 2, ("K", "K"): 3, ("K", "L"): 1, ("L", "K"): 1,
              ("L", "L"): 3, ("M", "M"): 2}
    assert {(a, b): n for a, b, n in rows(coauthors.cojournal_counts(authors))} == wanted


PATH = [("x", "1"), ("x", "2"), ("y", "2"), ("y", "3")]


def test_pagerank_of_a_path(spark, rows):
    listed = spark.createDataFrame(PATH + [("alone", "9")], "eid string, auid string")
    middle = (0.15 + 2 * 0.85 * 0.15) / (1 - 0.85 * 0.85)
    end = 0.15 + 0.85 * middle / 2
    wanted = [("1", round(end, 5)), ("2", round(middle, 5)), ("3", round(end, 5))]
    pairs = coauthors.coauthor_pairs(listed, distinct=True)
    assert rows(pagerank.pagerank_of_edges(pairs, tolerance=1e-8), 5) == wanted
    assert rows(pagerank.pagerank_of_papers(listed, tolerance=1e-8), 5) == wanted


def test_pagerank_counts_repeated_links(authors, rows):
    listed = authors.where(F.col("auid").isNotNull()).select("eid", "auid")
    by_pairs = pagerank.pagerank_of_edges(coauthors.coauthor_pairs(listed, distinct=False), rounds=7)
    by_papers = pagerank.pagerank_of_papers(listed, rounds=7)
    assert rows(by_papers) == rows(by_pairs)
    assert {r[0] for r in rows(by_papers)} == {"a", "b", "c", "e", "f", "g"}
    assert sum(r[1] for r in rows(by_papers)) == pytest.approx(6, abs=1e-5)


def test_pagerank_with_a_sink(spark, rows):
    ranks = dict(rows(pagerank.pagerank_of_edges(spark.createDataFrame([("a", "b")], "left string, right string"), rounds=3)))
    assert ranks["a"] < ranks["b"] and sum(ranks.values()) == pytest.approx(2, abs=1e-5)


def test_pagerank_of_nothing(authors, spark):
    none = authors.where("false")
    assert pagerank.coauthor_pagerank(none, ["J"], distinct=False).count() == 0
    assert pagerank.coauthor_pagerank(none, ["J"], distinct=True).count() == 0


def test_pagerank_of_a_journal(authors, spark):
    got = pagerank.coauthor_pagerank(authors, ["M"], distinct=True)
    assert {(r.auid, r.pageRank) for r in got.collect()} == {("f", 1.0), ("g", 1.0)}
    only = spark.createDataFrame([("a",), ("b",)], "auid string")
    got = pagerank.coauthor_pagerank(authors, ["J"], only, distinct=False)
    assert {r.auid for r in got.collect()} == {"a", "b"}


def test_originality(spark, rows):
    authors = spark.createDataFrame([
        ("1", "J", 2015, 5, "a"), ("2", "J", 2015, 3, "a"), ("3", "K", 2016, 1, "a"), ("3", "K", 2016, 1, "b"),
        ("1", "J", 2015, 5, "b"), ("4", "K", 2017, 1, "c"), ("5", "K", 2018, 1, None), ("9", "K", 2019, 1, "a"),
    ], "eid string, issn string, year short, month short, auid string")
    vectors = spark.createDataFrame(
        [("1", [0.0]), ("2", [3.0]), ("3", [5.0]), ("4", [1.0]), ("5", [1.0])], "id string, embedding array<double>")
    pairs = originality.originality_pairs(authors, vectors)
    assert rows(originality.originality_distances(pairs)) == [
        ("1", "J", "1", 0.0), ("1", "J", "2", 9.0), ("2", "J", "1", 9.0), ("2", "J", "2", 0.0),
        ("3", "K", "1", 25.0), ("3", "K", "2", 4.0), ("3", "K", "3", 0.0), ("4", "K", "4", 0.0)]
    assert rows(originality.earlier_paper_pairs(authors, vectors, strict=True)) == [
        ("1", "J", "2"), ("3", "K", "1"), ("3", "K", "2")]
    assert ("9", "K", "1") in rows(originality.earlier_paper_pairs(authors))
    assert rows(originality.author_distances(authors, vectors)) == rows(originality.originality_distances(pairs))
    strict = originality.originality_pairs(authors, vectors, strict=True)
    assert rows(originality.author_distances(authors, vectors, strict=True)) == rows(
        originality.originality_distances(strict))
    halved = originality.originality_distances(pairs, lambda x, y: F.abs(x[0] - y[0]) / 2)
    assert ("3", "K", "1", 2.5) in rows(halved)


@pytest.mark.parametrize("strict", [False, True])
def test_vectors_that_are_not_broadcast_meet_in_cells(spark, rows, plan, monkeypatch, strict):
    """Keys and slices of several blocks, papers with several vectors, null ones and null elements: no pair is shuffled."""
    monkeypatch.setattr(frames, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(originality, "CELL_ROWS", 4)
    monkeypatch.setattr(originality, "_LEFTS", 3)
    monkeypatch.setattr(originality, "_RIGHTS", 2)
    given = [(str(i % 50), "J" if i % 4 else None, 2015 + i * 7 % 3, None if i % 13 == 0 else i % 5, f"a{i * i % 6}") for i in range(90)]
    authors = spark.createDataFrame(given, "eid string, issn string, year short, month short, auid string")
    vector = {str(i): [[i / 3, 1.0]] for i in range(45)} | {"3": [[1.0, 2.0], [5.0, 0.1]], "4": [None], "5": [[None, 1.0]]}
    vectors = spark.createDataFrame([(k, v) for k, vs in vector.items() for v in vs], "id string, embedding array<double>")
    late = (lambda r: (r[2], -1 if r[3] is None else r[3])) if strict else (lambda r: r[2])
    wanted = {(a[0], a[1], b[0]) for a in given for b in given if a[0] in vector and b[0] in vector
              and a[4] == b[4] and (late(b) < late(a) if strict else late(b) <= late(a))}
    pairs = originality.originality_pairs(authors, vectors, strict=strict)
    assert "Exchange" not in plan(pairs).split("MapInArrow")[0]
    both = [(a, i, b, x and tuple(x), y and tuple(y)) for a, i, b in wanted for x in vector[a] for y in vector[b]]
    assert sorted(map(repr, rows(pairs, 12))) == sorted(repr(tuple(r)) for r in rows(spark.createDataFrame(
        both, "a string, i string, b string, x array<double>, y array<double>"), 12))
    by_kernel = rows(originality.originality_distances(pairs, lambda x, y: sq_l2(x, y)))
    assert rows(originality.originality_distances(pairs)) == by_kernel
    least = rows(pairs.select("eid", "issn", "eid_asc", sq_l2(F.col("embedding"), F.col("embedding_asc")).alias("d"))
                 .groupBy("eid", "issn", "eid_asc").agg(F.min("d")))
    assert rows(originality.author_distances(authors, vectors, strict=strict)) == least


def test_distances_want_vectors_of_one_length(spark):
    authors = spark.createDataFrame([("1", "J", 2015, 1, "a"), ("2", "J", 2016, 1, "a")], "eid string, issn string, year short, month short, auid string")
    vectors = spark.createDataFrame([("1", [1.0]), ("2", [1.0, 2.0])], "id string, embedding array<double>")
    pairs = originality.originality_pairs(authors, vectors)
    assert pairs.count() == 3
    for distances in (originality.originality_distances(pairs), originality.author_distances(authors, vectors)):
        with pytest.raises(PySparkException, match="vectors differ in length"):
            distances.collect()


def test_rounds_go_on_until_ranks_stand_still(spark, rows):
    """The same rule, and so the same ranks, whether pairs or author lists carry the rounds."""
    lists = spark.createDataFrame([(str(i), a) for i in range(12) for a in (f"n{i}", f"n{i + 1}")], "eid string, auid string")
    pairs = coauthors.coauthor_pairs(lists.withColumn("issn", F.lit("J")), distinct=True)
    for tolerance in (0.1, 1e-9):
        by_edges = pagerank.pagerank_of_edges(pairs, tolerance=tolerance)
        assert rows(by_edges) == rows(pagerank.pagerank_of_papers(lists, tolerance=tolerance))
    assert rows(by_edges) == rows(pagerank.pagerank_of_edges(pairs, rounds=200))


def test_ranks_that_stand_still_are_not_sent(spark, rows):
    """A long path hangs on a group of authors of one paper: the group settles first, and its links rest."""
    lists = [("hub", f"h{i}") for i in range(40)] + [(str(i), a) for i in range(30) for a in (f"p{i}", f"p{i + 1}")] + [("x", "h0"), ("x", "p0")]
    authors = spark.createDataFrame(lists, "eid string, auid string")
    links = authors.join(authors.groupBy("eid").agg((F.count("*") - 1).alias("n")), "eid")
    out = links.groupBy("auid").agg((F.lit(1.0) / F.sum("n")).alias("_per"))
    placed = links.join(out, "auid").select("eid", "auid", F.lit(1).alias("_m"), "_per")
    spread = pagerank._some_authors(placed)
    ranks, sent = pagerank._settled(out.select("auid"), spread, 1e-4, 0.15)
    assert sent[-1] == 0 and len(sent) > 8
    rounds = len(sent) - 1
    assert sum(sent[rounds // 2:]) < 0.5 * sum(sent[:rounds // 2]) and sum(sent) < 0.7 * 71 * rounds
    names = sorted({a for _, a in lists})
    pairs = np.zeros((len(names), len(names)))
    for paper in {p for p, _ in lists}:
        members = [names.index(a) for p, a in lists if p == paper]
        for a in members:
            pairs[a, [b for b in members if b != a]] += 1
    exact = np.linalg.solve(np.eye(len(names)) - 0.85 * (pairs / pairs.sum(axis=1, keepdims=True)).T, np.full(len(names), 0.15))
    exact = dict(zip(names, exact / exact.mean(), strict=True))
    scaled = dict(rows(pagerank._scaled(ranks)))
    assert scaled == pytest.approx(exact, abs=1e-3)


def test_rounds_shuffle_ranks_only(spark, plan, monkeypatch):
    links = pagerank._placed(spark.createDataFrame([("a", "b"), ("b", "a")], "left string, right string"), "left")
    ranks = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "left string, rank double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(links.join(ranks, "left"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        links.unpersist()
    above = text.split("InMemoryTableScan")[0]
    assert above.count("Exchange") == 0 and text.count("ENSURE_REQUIREMENTS") == 1


@pytest.mark.parametrize("limits", [{"rounds": 2}, {"tolerance": 0.2}])
@pytest.mark.parametrize("by", ["papers", "edges"])
def test_rounds_shuffle_no_links_where_ranks_fit(spark, rows, plan, monkeypatch, by, limits):
    """Ranks are broadcast to links that stand by what they are summed by; the same ranks come where they do not fit."""
    listed = [(str(i), f"a{a}") for i in range(40) for a in (i % 7, i * i % 11, i % 7)] + [("1", None), (None, "a1")]
    authors = spark.createDataFrame(listed, "eid string, auid string")
    rank = pagerank.pagerank_of_papers if by == "papers" else lambda lists, **kw: pagerank.pagerank_of_edges(
        coauthors.coauthor_pairs(lists, distinct=False), **kw)
    plans, store = [], pagerank.checkpointed

    def seen(df):
        if "rank" in df.columns:
            plans.append(plan(df))
        return store(df)

    monkeypatch.setattr(pagerank, "checkpointed", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rows(rank(authors, **limits))
        wide = [p for p in plans if "InMemoryTableScan" in p]
        monkeypatch.setattr(pagerank.frames, "BROADCAST_BYTES", 0)
        assert rows(rank(authors, **limits)) == found and len(found) >= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert wide and all("BroadcastHashJoin" in p for p in wide)
    links = "eid" if by == "papers" else "right"
    assert not any(f"Exchange hashpartitioning({links}" in p.split("InMemoryRelation")[0] for p in wide)


@pytest.mark.parametrize("listed, strict, fits", [(16, False, True), (2, True, True), (2, False, False)])
def test_originality_shuffles_no_pair(spark, rows, plan, monkeypatch, listed, strict, fits):
    """Papers that share several authors, rows that repeat with other years, journals and vectors, null authors."""
    monkeypatch.setattr(originality, "LISTED_AUTHORS", listed)
    monkeypatch.setattr(originality, "_fits", lambda vectors: fits)
    given = [(str(i % 9), "J" if i % 4 else None, 2015 + i * 7 % 3, i % 5, None if i % 11 == 0 else f"a{i * i % 6}") for i in range(60)]
    given += [("x", "J", 2015, None, "a1"), ("x", "J", None, 3, "a2")]
    authors = spark.createDataFrame(given, "eid string, issn string, year short, month short, auid string")
    vectors = spark.createDataFrame(
        [(str(i), [float(i), 1.0]) for i in range(8)] + [("x", [3.0, 3.0]), ("2", [9.0, 9.0])], "id string, embedding array<double>")
    known = [r for r in given if r[0] != "8" and r[4] is not None and (strict or r[2] is not None)]
    late = lambda r: (-1 if r[2] is None else r[2], -1 if r[3] is None else r[3]) if strict else r[2]
    wanted = {(a[0], a[1], b[0]) for a in known for b in known if a[4] == b[4] and (late(b) < late(a) if strict else late(b) <= late(a))}
    found = originality.earlier_paper_pairs(authors, vectors, strict=strict)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == wanted and len(got) == len(wanted)
    pairs = originality.originality_pairs(authors, vectors, strict=strict)
    distances = originality.author_distances(authors, vectors, strict=strict)
    assert {r[:3] for r in rows(distances)} == wanted and distances.count() == len(wanted)
    best = originality.originality_distances(pairs).groupBy("eid", "issn", "eid_asc").min("d2")
    assert rows(best) == rows(distances)
    if listed == 16 and fits:
        joins = plan(pairs)
        assert joins.count("BroadcastHashJoin") >= 2 and "Exchange hashpartitioning(eid" not in joins


@pytest.mark.parametrize("strict", [False, True])
def test_originality_asks_no_function_per_pair_where_papers_have_one_time(spark, rows, plan, strict):
    given = [(str(i), "J", 2015 + i % 3, i % 5, f"a{a}") for i in range(30) for a in {i % 4, i % 3, 5}]
    authors = spark.createDataFrame(given, "eid string, issn string, year short, month short, auid string")
    late = (lambda r: (r[2], r[3])) if strict else (lambda r: r[2])
    wanted = {(a[0], a[1], b[0]) for a in given for b in given if a[4] == b[4] and (late(b) < late(a) if strict else late(b) <= late(a))}
    found = originality.earlier_paper_pairs(authors, strict=strict)
    assert "exists(" not in plan(found)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == wanted and len(got) == len(wanted)
