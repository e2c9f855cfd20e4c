import collections

import numpy as np
import pyarrow as pa
import pytest

from paperlens.llm import neardup
from paperlens.llm.graph import components


def brute_classes(ids, texts, weights):
    """Components of all pairs with weighted Jaccard similarity of 0.8 or more."""
    sets = [neardup._features(own, weights) for own in neardup.shingles(pa.array(texts, pa.string()))]
    sets = [dict(zip(np.frombuffer(f, "<u8").tolist(), np.frombuffer(w, np.uint8).tolist(), strict=True)) for f, w in sets]
    totals = [sum(s.values()) for s in sets]
    where = collections.defaultdict(list)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        common = collections.Counter()
        for f, w in own.items():
            for j in where[f]:
                common[j] += w
            where[f].append(i)
        for j, w in common.items():
            if 9 * w >= 4 * (totals[i] + totals[j]):
                parent[root(j)] = root(i)
    groups = collections.defaultdict(list)
    for i in range(len(sets)):
        groups[root(i) if sets[i] else ("alone", i)].append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


def test_classes_of_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = documents.collect()
    wanted = brute_classes([r[0] for r in rows], [r[1] for r in rows], neardup.weights_of(documents, "text"))
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_classes(documents).collect()} == wanted
    assert len(set(wanted.values())) < len(rows)


def test_large_family_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in rng.integers(0, 120, i % 4):
            words[at] = f"x{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 20)
    wanted = brute_classes(list(range(90)), texts, neardup.weights_of(docs, "text"))
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_classes(docs).collect()} == wanted


def test_frequent_shingles_are_exact(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = neardup.weights_of(documents.repartition(5), "text")
    texts = [r["text"] for r in documents.select("text").collect()]
    hashes, counts = np.unique(np.concatenate([h for h, _ in neardup.shingles(pa.array(texts))]), return_counts=True)
    assert np.array_equal(weights.hashes, hashes[counts >= 2])
    assert weights.idf.min() >= neardup.UNIT and weights.idf.max() <= neardup.CEILING


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_bands_collide_as_the_similarity_says(similarity):
    rng, none = np.random.default_rng(1), neardup.Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sampler, met = neardup.Sampler(), []
    size = 300
    common = int(size * 2 * similarity / (1 + similarity))
    for _ in range(100):
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        b = np.concatenate([a[:common], rng.integers(0, 1 << 63, size - common).astype(np.uint64)])
        one, two = sampler.bands([(np.sort(x), np.ones(size, int)) for x in (a, b)], none)
        met.append((one == two).mean())
    assert np.mean(met) == pytest.approx(similarity ** neardup.ROWS, abs=0.04)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 120), (120, 110), (7, 7), (None, 3)]
    found = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in found} == {**{i: 0 for i in range(41)}, 100: 100, 120: 100, 110: 100}


def test_edges(edges, none):
    found = neardup.near_classes(edges).collect()
    assert len(found) == edges.count()
    classes = collections.defaultdict(list)
    for r in found:
        classes[r["class_id"]].append(r["doc_id"])
    assert sorted(classes[4], key=str) == [4, 5, 5, None]
    assert sorted(classes[7]) == [7, 8]
    assert classes[1] == [1] and classes[2] == [2] and classes[3] == [3]
    kept = neardup.one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, None, 6, 7, 9, 10], key=str)
    assert neardup.near_classes(none).count() == 0 and neardup.one_of_each(none).count() == 0


def test_equal_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x y")], "doc_id long, text string")
    assert sorted(neardup.one_of_each(docs).collect(), key=str) == sorted([(1, "a b c d e f"), (None, "x y")], key=str)


def test_null_and_repeated_ids_join_no_classes(spark):
    def text(n):
        return " ".join(f"w{n}x{i}" for i in range(40))

    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (6, text(5)), (7, text(5) + " end"),
            (6, text(6)), (None, text(7)), (None, text(7) + " end"), (None, " "), (None, " "), (8, "\t"), (9, "\t")]
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lost = {(7, text(5) + " end")}
    near = {rows[8], rows[9]}
    found = [tuple(r) for r in kept]
    assert len(near & set(found)) == 1
    assert sorted((r for r in found if r not in near), key=str) == sorted((r for r in rows if r not in lost | near), key=str)
