import zlib

import pytest

from paperlens.llm import sharding


def check(rows, found, shards=8, spread=None):
    assert len(found) == len(rows)
    texts = sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, str(i)) for i, t in rows)
    assert sorted((r["text_crc32"], r["size"], str(r["doc_id"])) for r in found) == texts
    for s in range(shards):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(shards)]
    if spread:
        assert max(sizes) - min(sizes) <= spread
    return sizes


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_documents(spark, folder):
    documents = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in documents.collect()]
    found = sharding.shard(documents).collect()
    check(rows, found, spread=2 * max(r["size"] for r in found))
    of_text = {}
    for r in found:
        of_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())


def test_a_text_that_fills_shards_is_cut(spark):
    rows = [(i, "hot text") for i in range(700)] + [(i, f"text {i}") for i in range(700, 1_300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sharding.shard(docs, slice_rows=50).collect(), spread=60)
    check(rows, sharding.shard(docs, ranges=32, slice_rows=30).collect(), spread=800)


def test_rows_that_are_all_equal(spark):
    rows = [(1, "same")] * 800
    check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), slice_rows=50).collect(), spread=15)


def test_range_search(spark):
    lows = [0, 5, 6, 100, 1 << 40]
    keys = spark.createDataFrame([(k,) for k in (0, 4, 5, 6, 99, 100, 1 << 39, 1 << 40, 1 << 50)], "k long")
    found = [r[0] for r in keys.select(sharding._range_of(keys["k"], lows)).collect()]
    assert found == [0, 0, 1, 2, 2, 3, 3, 4, 4]


def test_plan_has_no_python(documents, plan):
    assert "Python" not in plan(sharding.shard(documents)) and "Arrow" not in plan(sharding.shard(documents))


def test_edges(edges, none):
    check([(r["doc_id"], r["text"]) for r in edges.collect()], sharding.shard(edges).collect())
    assert sharding.shard(none).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sharding.shard(none).count() == 0
