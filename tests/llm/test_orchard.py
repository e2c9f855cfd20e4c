import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlens.llm import orchard


def brute(rows, k=40, rounds=5, dimension=64):
    """Every vector against every centroid, in Python integers."""
    def number(x):
        scaled = x * 256.0
        return int(np.floor(scaled)) if np.isfinite(scaled) else int(x) * 256

    kept = [(i, [number(float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    names = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in names[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        points = [[sum(col) // len(members[c]) for col in zip(*members[c])] if c in members else p for c, p in enumerate(points)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = {}
    for _, c, d in placed:
        own[c] = own.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, c, d, own[c], sum(own.values()), digest[c]) for i, c, d in placed), key=repr)


def plain(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def test_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    assert plain(orchard.cluster(vectors.repartition(5))) == brute(rows)


def test_walk_is_exact_and_spares_comparisons():
    rng = np.random.default_rng(5)
    # Few values, so that ties and equal centroids abound.
    points = rng.integers(0, 4, (60, 3)).astype(np.int64)
    x = rng.integers(0, 4, (500, 3)).astype(np.int64)
    best, distance, _ = orchard.Centroids.of(points.tolist()).nearest(x)
    every = ((x[:, None] - points[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    # Well separated groups: most centroids are ruled out by the lists.
    centres = rng.integers(-10_000, 10_000, (200, 8)).astype(np.int64)
    x = centres[rng.integers(0, 200, 1_000)] + rng.integers(-20, 20, (1_000, 8))
    best, distance, compared = orchard.Centroids.of(centres.tolist()).nearest(x)
    every = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert compared.mean() < 60


def test_walk_ends_only_strictly_beyond_twice_the_distance():
    # The tie lies at exactly twice the distance from the centroid the walk is at.
    lists = orchard.Centroids.of([[50], [4], [0]])
    assert [v.tolist() for v in lists.nearest(np.array([[2]]))[:2]] == [[1], [4]]
    lists = orchard.Centroids.of([[0], [4], [9]])
    assert [v.tolist() for v in lists.nearest(np.array([[2], [4], [7]]))[:2]] == [[0, 1, 2], [4, 0, 4]]


EDGES = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (2, [0.5, 1.0]), (2, [0.25, 1.0]), (None, [-0.001, 3.0]), (3, None), (4, [1.0]),
         (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [-7.3, 2.2]), (9, []), (10, [0.0, 0.0]),
         (11, [100.1, -100.1])]


@pytest.mark.parametrize("k", [1, 3, 40])
def test_edges(spark, k):
    vectors = spark.createDataFrame([(i, v, "x", "y") for i, v in EDGES], "vec_id long, embedding array<double>, cluster string, _key string")
    found = orchard.cluster(vectors.repartition(3), centroids=k, dimension=2)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"]
    assert plain(found) == brute(EDGES, k, dimension=2)


def test_components_beyond_64_bit_arithmetic(spark):
    rows = [(1, [1e7, 1.0]), (2, [-1e7, 2.5]), (3, [3.0, 1e6])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert plain(orchard.cluster(vectors, centroids=2, dimension=2)) == brute(rows, 2, dimension=2)
    assert orchard.whole(np.array([[1e306, 0.3]]), 256)[0, 0] == int(1e306) * 256
    assert [int(v) for v in orchard.whole(np.array([[1e300, -0.3]]), 256)[0]] == [int(1e300 * 256), -77]


def test_nothing_kept(spark):
    for rows in ([], [(1, None)], [(1, [2.0])]):
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        found = orchard.cluster(vectors)
        assert found.count() == 0 and found.columns[0] == "vec_id"


def test_rounds_send_sums_only(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(4_000)], "vec_id long, embedding array<float>")
    placed = orchard.cluster(vectors.repartition(4), centroids=5, dimension=2)
    assert placed.count() == 4_000
    assert placed.agg(F.sum("distance")).first()[0] == placed.first()["inertia"]


def test_wrong_settings(spark):
    vectors = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    for given in ({"centroids": 0}, {"centroids": 5_000}, {"scale": 100}):
        with pytest.raises(ValueError):
            orchard.cluster(vectors, **given)
