import hashlib

import pytest
from pyspark.sql import functions as F

from paperlens.llm import exactdup


def brute(rows, keep="smallest"):
    """Sorted (doc_id, keep_id, group_size, kept, digest) of (doc_id, text) rows."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    found = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        first = None if not known else known[0] if keep == "smallest" else known[-1]
        digest = hashlib.sha256(text.encode()).hexdigest()
        stays = [i for i in ids if i == first][:1]
        for i in ids:
            found.append((i, first, len(ids), i in stays, digest))
            stays = stays if i not in stays else []
    return sorted(found, key=repr)


def plain(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_documents(spark, keep):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert plain(exactdup.exact_classes(documents, keep=keep)) == brute(rows, keep)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_edges(edges, none, keep):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert plain(exactdup.exact_classes(edges.repartition(4), keep=keep)) == brute(rows, keep)
    assert plain(exactdup.exact_classes(edges.coalesce(1), keep=keep)) == brute(rows, keep)
    assert exactdup.exact_classes(none).count() == 0
    assert exactdup.one_of_each(none).columns == none.columns


def test_group_over_batches_and_partitions(spark):
    # More copies of a text than an Arrow batch or a step holds, in several partitions.
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("a" * 100), F.col("id") % 5000)).alias("text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert plain(exactdup.exact_classes(docs.repartition(5))) == brute(rows)


def test_a_hot_text_is_a_row_per_partition(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")).repartition(6)
    found = exactdup.exact_classes(docs)
    assert found.agg(F.sum(F.col("kept").cast("int")), F.max("group_size"), F.max("keep_id")).first()[:] == (1, 20_000, 0)
    merged = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "rangepartitioning" in line]
    assert merged and "_start" in merged[0]


def test_normalised_texts_and_whole_rows(spark):
    docs = spark.createDataFrame(
        [(3, "One  two", "x"), (1, "one two", "y"), (2, "ONE TWO", "z"), (4, "three", None), (4, "three", None)],
        "doc_id long, text string, _part string")

    def words(text):
        return F.lower(F.regexp_replace(text, r"\s+", " "))

    assert sorted(map(tuple, exactdup.one_of_each(docs, normalise=words).collect())) == [
        (1, "one two", "y"), (4, "three", None)]
    assert sorted(map(tuple, exactdup.one_of_each(docs, keep="largest", normalise=words).collect())) == [
        (3, "One  two", "x"), (4, "three", None)]
    assert [r["text_sha256"] for r in exactdup.exact_classes(docs, normalise=words).where("doc_id = 2").collect()] == [
        hashlib.sha256(b"one two").hexdigest()]


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t"), (None, "u")], "name string, body string")
    found = exactdup.exact_classes(docs, "name", "body").collect()
    assert sorted((str(r["name"]), str(r["keep_id"]), r["kept"]) for r in found) == [
        ("None", "None", True), ("None", "a", False), ("a", "a", True), ("b", "a", False)]


def test_wrong_side(documents):
    with pytest.raises(ValueError):
        exactdup.exact_classes(documents, keep="first")
