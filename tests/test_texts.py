import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlens.functions.text import NUMERIC_MASKS, mask
from paperlens.operators import bow, embeddings, frames, tokens, vocabulary, wordvectors


@pytest.fixture(scope="module")
def tokenized(spark):
    return spark.createDataFrame(
        [("1", ["a", "b", "a"]), ("1", ["a", "d"]), ("2", ["b", "b"]), ("3", ["a", "b"])], "id string, terms array<string>")


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("y", [8.0, 8.0]), ("z", [9.0, 9.0])], "word string, embedding array<float>")


def test_sentence_rows(spark, rows):
    df = spark.createDataFrame([("1", "It cost 1.3% ok? Yes."), ("2", ""), ("3", "..."), ("4", None)], "id string, text string")
    got = tokens.tokenize_per_sentence(df, with_position=True)
    assert rows(got) == [
        ("1", 0, ("It", "cost", "1.3", "%", "ok", "?")), ("1", 1, ("Yes", ".")), ("3", 0, (".", ".", "."))]
    assert rows(tokens.tokenize_texts(df, token_fn=F.lower).where("id = '1'")) == [
        ("1", ("it", "cost", "1.3", "%", "ok", "?", "yes", "."))]


def test_masked_lower_abstracts(spark, rows):
    df = spark.createDataFrame([("1", "Rose by 3 % (n=4). OK")], "eid string, abstr string")
    assert rows(tokens.tokenize_abstracts(df)) == [
        ("1", ("ok",)), ("1", ("rose", "by", "sodadpct", "."))]


def test_vocabulary(spark, tokenized, rows):
    titles = spark.createDataFrame([("1", ["t", "a"]), ("9", ["t"])], "id string, terms array<string>")
    tf, df, idf = vocabulary.vocabulary(tokenized, titles)
    assert rows(tf) == [("a", 5), ("b", 4), ("d", 1), ("t", 2)]
    assert rows(df) == [("a", 2), ("b", 3), ("d", 1), ("t", 2)]
    assert rows(idf) == [
        ("a", round(math.log(2), 6)), ("b", round(math.log(4 / 3), 6)), ("d", round(math.log(4), 6)), ("t", round(math.log(2), 6))]


def test_tf_idf(spark, tokenized, rows):
    idf = spark.createDataFrame([("a", 2.0), ("b", 5.0)], "token string, weight double")
    weighted = bow.tf_idf(tokenized, idf)
    assert rows(weighted) == [
        ("1", "a", 1.2), ("1", "b", 1.0), ("1", "d", 1.0), ("2", "b", 5.0), ("3", "a", 1.0), ("3", "b", 2.5)]
    assert rows(bow.from_maps(bow.to_maps(weighted))) == rows(weighted)
    assert ("1", "d", 0.0) in rows(bow.submission_bow(tokenized, idf))
    whole = tokenized.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    assert rows(bow.tf_idf(whole, idf, one_row_per_id=True)) == rows(weighted)
    negative = idf.withColumn("weight", -F.col("weight"))
    assert ("1", "d", 0.0) in rows(bow.tf_idf(tokenized, negative))


@pytest.mark.parametrize("dimension, limit", [(None, 10**9), (2, 10**9), (None, 3000), (2, 350), (2, 0)])
def test_weighted_means(spark, words, rows, dimension, limit, monkeypatch):
    """The small limits split even this vocabulary in frequent and rare terms."""
    monkeypatch.setattr(frames, "BROADCAST_BYTES", limit)
    weighted = spark.createDataFrame(
        [("1", "a", 1.0), ("1", "b", 3.0), ("1", "unknown", 9.0), ("2", "unknown", 1.0), ("3", "a", 0.0), ("4", "b", 2.0),
         ("5", "z", 1.0)],
        "id string, term string, weight double")
    got = embeddings.embed_bow(weighted, words, dimension=dimension)
    assert rows(got) == [("1", (0.25, 1.5)), ("4", (0.0, 2.0)), ("5", (9.0, 9.0))]


@pytest.mark.parametrize("limit", [10**9, 3000, 0])
def test_weighted_means_of_many_runs(spark, limit, monkeypatch):
    """Ids spread over batches, partitions and runs, repeated and null ids, words without a vector."""
    monkeypatch.setattr(frames, "BROADCAST_BYTES", limit)
    vectors = {f"w{i}": [float((i * j) % 7 - 3) for j in range(1, 6)] for i in range(60)}
    words = spark.createDataFrame([*vectors.items(), ("none", None)], "word string, embedding array<double>")
    counted = [(None if i % 11 == 0 else f"d{i * i % 40}", f"w{i % 90}", float(i % 5) - 1) for i in range(25_000)]
    counted += [("d0", "none", 5.0), ("only", "none", 1.0), ("d1", None, 2.0)]
    sums = {}
    for key, term, weight in counted:
        if term in vectors:
            total, row = sums.get(key, (0.0, [0.0] * 5))
            sums[key] = total + weight, [a + weight * b for a, b in zip(row, vectors[term])]
    bow_rows = spark.createDataFrame(counted, "id string, term string, weight double").repartition(4)
    got = {r["id"]: r["embedding"] for r in embeddings.embed_bow(bow_rows, words).collect()}
    assert set(got) == {key for key, (total, _) in sums.items() if total}
    for key, vector in got.items():
        assert vector == pytest.approx([v / sums[key][0] for v in sums[key][1]])


@pytest.mark.parametrize("dimension", [None, 2])
def test_weighted_means_of_nothing(spark, words, dimension):
    none = spark.createDataFrame([], "id string, term string, weight double")
    assert embeddings.embed_bow(none, words, dimension=dimension).count() == 0
    some = spark.createDataFrame([("1", "a", 1.0)], "id string, term string, weight double")
    got = embeddings.embed_bow(some, words.where("false"), dimension=dimension)
    assert got.columns == ["id", "embedding"] and got.count() == 0
    with pytest.raises(ValueError, match="length"):
        embeddings.embed_bow(some, words, dimension=3)


def test_token_vectors_equal_bow_vectors(spark, tokenized, words, rows):
    idf = spark.createDataFrame([("a", 2.0), ("d", 7.0)], "token string, weight double")
    by_bow = embeddings.embed_bow(bow.tf_idf(tokenized, idf), words, dimension=2)
    assert rows(embeddings.embed_tokens(tokenized, words, idf, dimension=2)) == rows(by_bow)
    texts = spark.createDataFrame([("q", "a b new"), ("r", "b b"), ("s", "?")], "query_id string, text string")
    got = embeddings.embed_submissions(texts, words, idf, dimension=2)
    assert rows(got) == [("q", (1.0, 0.0))]


def test_token_vectors_do_not_shuffle_tokens(spark, tokenized, words, plan, tmp_path):
    idf = spark.createDataFrame([("a", 2.0)], "token string, weight double")
    text = plan(embeddings.embed_tokens(tokenized, words, idf, dimension=2))
    assert "BroadcastHashJoin [term" in text and "hashpartitioning(id" in text and "hashpartitioning(term" not in text


@pytest.mark.parametrize("dimension", [None, 2])
def test_centroids(spark, rows, dimension):
    df = spark.createDataFrame(
        [("x", [1.0, 2.0]), ("x", [3.0, 6.0]), ("y", [5.0, 5.0]), ("z", None)], "k string, embedding array<double>")
    assert rows(embeddings.centroids(df, "k", dimension=dimension)) == [("x", (2.0, 4.0)), ("y", (5.0, 5.0))]


def test_word_vectors(spark):
    df = spark.createDataFrame([("1", ["red", "green", "blue"] * 4)] * 5 + [("2", ["rare"])], "id string, terms array<string>")
    fitted = wordvectors.word_vectors(wordvectors.fit_word_vectors(df, 8, partitions=2))
    assert fitted.dtypes == [("word", "string"), ("embedding", "array<float>")]
    found = {r.word: len(r.embedding) for r in fitted.collect()}
    assert found == {"red": 8, "green": 8, "blue": 8}
    with pytest.raises(ValueError, match="min_count"):
        wordvectors.fit_word_vectors(df, 8, max_weights=16)


def test_tf_idf_shuffles_tokens_by_id_only(spark, tokenized, plan):
    idf = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "token string, weight double")
    text = plan(bow.tf_idf(tokenized, idf, unknown_weight=0.0))
    assert text.count("Exchange hashpartitioning(id") == 1 and "hashpartitioning(term" not in text


def test_word_vectors_do_not_follow_the_cores(spark, tokenized, rows):
    """Parts are a parameter; each is trained by itself and averaged, so values are equal but for rounding."""
    one, other = (
        dict(wordvectors.word_vectors(wordvectors.fit_word_vectors(df, 4, min_count=1)).collect())
        for df in (tokenized.coalesce(1), tokenized.coalesce(1)))
    assert wordvectors.PARTITIONS == 8 and set(one) == set(other) == {"a", "b", "d"}
    assert all(a == pytest.approx(b, abs=1e-2) for w in one for a, b in zip(one[w], other[w], strict=True))


def test_huffman_codes_are_shortest():
    """Runs of equal counts give the code lengths that merging two words or nodes at a time gives."""
    random = np.random.default_rng(1)
    for size in (1, 2, 3, 7, 40, 300):
        counts = np.sort(random.integers(1, 15, size) ** int(random.integers(1, 4)))
        heap, shortest = counts.tolist(), 0
        while len(heap) > 1:
            merged = heapq.heappop(heap) + heapq.heappop(heap)
            heapq.heappush(heap, merged)
            shortest += merged
        values, numbers = np.unique(counts, return_counts=True)
        starts, nodes, bits = wordvectors.paths(
            wordvectors.huffman(list(zip(values.tolist(), numbers.tolist(), strict=True))), np.arange(size))
        assert (np.diff(starts) * counts).sum() == shortest
        codes = {tuple(zip(nodes[a:b].tolist(), bits[a:b].tolist(), strict=True)) for a, b in zip(starts, starts[1:])}
        assert len(codes) == size and len(np.unique(nodes)) == size - 1


def test_word_vectors_are_no_local_rows(spark, plan, monkeypatch):
    """Vectors are stored by the tasks; parts follow the tokens, and a part and group of any size gives all words."""
    random = np.random.default_rng(2)
    some = [(str(i), [f"t{i % 4}_{j}" for j in random.integers(0, 5, 8)] + ["the", None]) for i in range(2_000)]
    df = spark.createDataFrame([*some, ("x", ["rare", "rarer"]), (None, []), ("y", ["the"])], "id string, terms array<string>")
    monkeypatch.setattr(wordvectors, "PART_WEIGHTS", 30_000, raising=False)
    monkeypatch.setattr(wordvectors, "_GROUP_WEIGHTS", 1_000, raising=False)
    fitted = wordvectors.word_vectors(wordvectors.fit_word_vectors(df, 16, partitions=2, iterations=6))
    assert "LocalTableScan" not in plan(fitted) and "FileScan" in plan(fitted)
    found = {r.word: np.array(r.embedding) for r in fitted.collect()}
    assert set(found) == {f"t{t}_{j}" for t in range(4) for j in range(5)} | {"the", None}
    names = sorted(n for n in found if n not in ("the", None))
    near = np.array([found[n] / np.linalg.norm(found[n]) for n in names])
    near = near @ near.T - 9 * np.eye(len(names))
    assert np.mean([names[i][:2] == names[j][:2] for i, j in enumerate(near.argmax(1))]) > 0.9


def test_repeated_words_do_not_overshoot(spark):
    """A junk line of one word, over and over, and words that alternate: vectors stay finite and small."""
    df = spark.createDataFrame(
        [("1", ["x"] * 3_000), ("2", ["x", "y"] * 2_000), ("3", ["a", "b", "c", "x"] * 500)] * 6, "id string, terms array<string>")
    norms = [np.linalg.norm(r.embedding) for r in wordvectors.fit_word_vectors(df, 8, partitions=1).collect()]
    assert len(norms) == 5 and all(0 < n < 10 for n in norms)


def test_vectors_are_averaged_over_the_parts_that_moved_them(spark, rows):
    df = spark.createDataFrame(
        [(0, 0, 5, "a", [1.0, 2.0], True), (1, 0, 5, "a", [3.0, 6.0], True), (2, 0, 5, "a", [9.0, 9.0], False),
         (1, 0, 6, "b", [7.0, 8.0], False), (2, 0, 6, "b", [7.0, 8.0], False), (0, 1, 5, None, [4.0, 4.0], True)],
        "part int, kind int, key bigint, word string, embedding array<float>, touched boolean")
    got = df.withColumn("_group", F.lit(1)).groupBy("_group").applyInArrow(wordvectors._averaged, "kind int, key bigint, word string, embedding array<float>")
    assert rows(got) == [(0, 5, "a", (2.0, 4.0)), (0, 6, "b", (7.0, 8.0)), (1, 5, None, (4.0, 4.0))]


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_counts_of_ids_that_span_batches(spark, batch):
    """Null ids are one id of ``term_counts``, null terms a term; documents are counted over ids that are not null."""
    some = [("x", ["a", "b", "a"]), (None, ["a", None]), ("y", []), ("x", ["a", "c"]), (None, ["a"]), ("z", None), ("w", ["b"]), ("x", ["b"])]
    df = spark.createDataFrame(some * 2, "id string, terms array<string>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        counts = {(r.id, r.term): (r._count, r._total) for r in tokens.term_counts(df).collect()}
        documents = dict(vocabulary.doc_frequency(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert counts == {
        ("x", "a"): (6, 12), ("x", "b"): (4, 12), ("x", "c"): (2, 12), (None, "a"): (4, 6), (None, None): (2, 6), ("w", "b"): (2, 2)}
    assert documents == {"a": 1, "b": 2, "c": 1}


def test_large_vocabularies_count_tokens_once(spark, tokenized, rows, plan, monkeypatch):
    """With an idf too large to broadcast, the counts are stored and not formed again for each part of the lookup."""
    idf = spark.createDataFrame([("a", 2.0), ("b", 5.0)], "token string, weight double")
    wanted = rows(bow.tf_idf(tokenized, idf))
    monkeypatch.setattr(frames, "BROADCAST_BYTES", 100)
    weighted = bow.tf_idf(tokenized, idf)
    assert rows(weighted) == wanted
    assert "hashpartitioning(id" not in plan(weighted) and "MapInArrow" not in plan(weighted)


def test_rare_vectors_travel_once_for_many_ids(spark, words, rows, plan, monkeypatch):
    """Rare terms do not make a row with a vector each: they meet their vectors by parts of the ids."""
    idf = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "token string, weight double")
    df = spark.createDataFrame([(f"d{i % 50}", ["a", "b", "y", "y"]) for i in range(100)], "id string, terms array<string>")
    wanted = rows(embeddings.embed_tokens(df, words, idf, dimension=2))
    monkeypatch.setattr(frames, "BROADCAST_BYTES", 100)
    got = embeddings.embed_tokens(df, words, idf, dimension=2)
    assert rows(got) == wanted and len(wanted) == 50
    assert "FlatMapCoGroupsInArrow" in plan(got)


@pytest.mark.parametrize("known", [20, 60])
def test_vectors_go_out_by_slices_of_their_elements(spark, plan, monkeypatch, known):
    """A vocabulary above the limit of a broadcast: several slices, with and without rare words beside them, weighed by word or row."""
    vectors = {f"w{i}": [float((i * j) % 7 - 3) for j in range(1, 41)] for i in range(known)}
    words = spark.createDataFrame([*vectors.items(), ("none", None)], "word string, embedding array<float>")
    texts = [(None if i % 11 == 0 else f"d{i * i % 9}", [f"w{(i * j) % 70}" for j in range(i % 5, 40)] + [None, "none"]) for i in range(60)]
    df = spark.createDataFrame(texts, "id string, terms array<string>").repartition(3)
    idf = spark.createDataFrame([(f"w{i}", 1.0 + i % 3) for i in range(50)], "token string, weight double")
    bow_rows = df.select("id", F.explode("terms").alias("term")).withColumn("weight", F.length("term").cast("double"))
    wanted = [embeddings.embed_tokens(df, words, idf, dimension=40), embeddings.embed_bow(bow_rows, words)]
    wanted = [{r["id"]: r["embedding"] for r in frame.collect()} for frame in wanted]
    monkeypatch.setattr(embeddings, "_TOKENS", 7)
    sent = []
    packed = embeddings._run_sums
    monkeypatch.setattr(embeddings, "_run_sums", lambda runs, out, width: sent.append(width) or packed(runs, out, width))
    monkeypatch.setattr(frames, "BROADCAST_BYTES", 2_500)
    for frame, means in zip((embeddings.embed_tokens(df, words, idf, dimension=40), embeddings.embed_bow(bow_rows, words)), wanted):
        got = {r["id"]: r["embedding"] for r in frame.collect()}
        assert got.keys() == means.keys()
        assert all(got[i] == pytest.approx(means[i]) for i in means)
        assert ("FlatMapCoGroupsInArrow" in plan(frame)) == (known > 25)
    assert sum(sent) == 80 and len(sent) == 4


def test_an_id_is_shuffled_once_with_its_terms(spark, rows, plan):
    """Rows of an id in several tasks, null ids and terms, numbers as ids: blocks of counts travel, and no row a sentence."""
    given = [(None if i % 7 == 0 else i * i % 10, ["a", f"b{i % 4}", None]) for i in range(60)]
    for kind in ("string", "bigint", "double"):
        df = spark.createDataFrame(given, "id bigint, terms array<string>").withColumn("id", F.col("id").cast(kind)).repartition(5)
        wanted = rows(df.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*")))
        assert rows(tokens.term_counts(df).select("id", "term", "_count")) == wanted
        weighted = df.select("id", F.explode("terms").alias("term")).distinct().where("term is not null").withColumn("weight", F.lit(0.5))
        maps = bow.to_maps(weighted)
        assert maps.count() == weighted.select("id").distinct().count() and rows(bow.from_maps(maps)) == rows(weighted)
        assert ("id_part" in plan(maps)) == ("id_part" in plan(tokens.term_counts(df))) == (kind != "double")
        assert rows(tokens.ids_with_terms(df.where("id is not null")).groupBy("token").sum("_n")) == rows(
            df.where("id is not null").select("id", F.explode("terms").alias("t")).distinct().groupBy("t").count())


def test_masks_ask_for_the_start_of_a_number_first(spark, plan):
    """The same texts as by the plain patterns, on signs, spaces and comparisons in any order."""
    parts = ["a", " 1.5 %", "+/- 3", ">= -2", "7 <", "\n\t4%", " 5", "+-", "-", " ", "(x 1)", "٣", "9.9.9", "+ /-6", None, ""]
    texts = spark.createDataFrame([(a if a is None else a + (b or "") + a,) for a in parts for b in parts], "text string")
    plain = F.col("text")
    for pattern, tag in NUMERIC_MASKS:
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(tag))
    assert texts.where(~mask(F.col("text")).eqNullSafe(plain)).count() == 0
    assert plan(texts.select(mask(F.col("text")).alias("x"))).count("(?=[-+") == 3
