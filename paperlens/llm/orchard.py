"""Clusters around centroids, every vector placed by Orchard's search.

Each centroid has the list of all others by distance from it. A vector walks the list of the
nearest centroid it knows; on meeting a nearer one it goes over to the list of that one. Centroids already
met are not compared again, and the walk ends where the list is strictly beyond twice the distance of the
vector: by the triangle inequality nothing further on is as near. Distances are squared and exact
integers, so the walk ends beyond four times the squared distance, and ties are decided, not rounded.

The vectors stay distributed: a round is one pass that sends the sums of each task, and the driver holds only
the centroids and their lists, whose number is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperlens.llm.arrow import steps
from paperlens.session import checkpointed

CENTROIDS, ROUNDS, SCALE = 40, 5, 256
# The lists of all centroids are sent to every task: 2,000 of them are 64 MB.
MAX_CENTROIDS = 2_000
# Below this, four times a squared distance of 64 components fits in 64 bits; larger components are Python integers.
_PLAIN = 1 << 26
_STEP_ROWS = 2_000


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=1)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers, of any size; ``scale`` is a power of two, so the product is exact."""
    with np.errstate(over="ignore"):
        floors = np.floor(x * float(scale))
    if len(x) == 0 or np.abs(floors).max() < _PLAIN:
        return floors.astype(np.int64)
    exact = [[int(f) if np.isfinite(f) else int(v) * scale for f, v in zip(*pair)] for pair in zip(floors, x)]
    return np.array(exact, dtype=object)


@dataclass
class Centroids:
    """Centroids with the neighbours of each by distance, ties by number."""

    points: np.ndarray
    near: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, rows: list[list[int]]) -> "Centroids":
        large = any(abs(v) >= _PLAIN for row in rows for v in row)
        points = np.array(rows, dtype=object if large else np.int64)
        near, gaps = [], []
        for at in range(len(points)):
            away = _sq(points, points[at])
            order = [int(j) for j in np.lexsort((np.arange(len(points)), away)) if j != at]
            near.append(order)
            gaps.append(away[order])
        return cls(points, np.array(near, dtype=np.int64).reshape(len(points), -1), np.array(gaps).reshape(len(points), -1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller), squared distance and number of
        comparisons of each row. All rows walk at once, each in its own list and place."""
        points, near, gaps = self.points, self.near, self.gaps
        if points.dtype == object:
            x = x.astype(object)
        at, place = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        distance, compared = _sq(x, points[at]), np.ones(len(x), dtype=np.int64)
        best = at.copy()
        met = np.zeros((len(x), len(points)), dtype=bool)
        met[:, 0] = True
        live = np.arange(len(x))
        while True:
            live = live[place[live] < near.shape[1]]
            live = live[(gaps[at[live], place[live]] <= 4 * distance[live]).astype(bool)]
            if not len(live):
                return best, distance, compared
            seen = near[at[live], place[live]]
            place[live] += 1
            fresh = ~met[live, seen]
            rows, seen = live[fresh], seen[fresh]
            met[rows, seen] = True
            compared[rows] += 1
            away = _sq(x[rows], points[seen])
            tied = (away == distance[rows]).astype(bool)
            best[rows[tied]] = np.minimum(best[rows[tied]], seen[tied])
            nearer = (away < distance[rows]).astype(bool)
            to = rows[nearer]
            at[to], best[to], distance[to], place[to] = seen[nearer], seen[nearer], away[nearer], 0


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def _sums(kept: DataFrame, centroids: Centroids, dimension: int, scale: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(cluster, place) -> (sum of the components there, vectors); a task sends one row for each."""
    schema = T.StructType([
        T.StructField("cluster", T.IntegerType()), T.StructField("place", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("total", T.DecimalType(38, 0)),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        count: dict[int, int] = {}
        for batch in steps(batches, rows=_STEP_ROWS):
            x = whole(_matrix(batch.column("_vector"), dimension), scale)
            cluster, _, _ = centroids.nearest(x)
            for c in np.unique(cluster):
                rows = x[cluster == c]
                sums = [int(v) for v in rows.sum(axis=0)]
                total[c] = [a + b for a, b in zip(total[c], sums)] if c in total else sums
                count[c] = count.get(c, 0) + len(rows)
        if total:
            cells = [(int(c), p, count[c], v) for c, sums in total.items() for p, v in enumerate(sums)]
            columns = list(zip(*cells))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                 pa.array([Decimal(v) for v in columns[3]], pa.decimal128(38, 0))], schema=arrow)

    added = kept.select("_vector").mapInArrow(run, schema).groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))
    return {(r["cluster"], r["place"]): (int(r["total"]), r["n"]) for r in added.collect()}


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *, centroids: int = CENTROIDS,
    rounds: int = ROUNDS, dimension: int = 64, scale: int = SCALE, seed: str = "2:",
) -> DataFrame:
    """(``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared) of every vector kept.

    Kept are vectors of ``dimension`` components, none null or not finite; components become floor(``scale`` * x).
    The first centroids are the vectors whose sha256 of ``seed`` and key is smallest, in that order (a null key
    counts as empty there; of equal keys the smaller vector goes first; fewer vectors are fewer centroids). In each
    round all vectors go to the nearest centroid (squared Euclidean distance, ties: smaller number), which then
    moves to floor(sum / count); one without vectors stays. Then vectors are placed once more.
    compared is the number of centroids a vector was measured against. Repeated rows are vectors each. A
    table without kept vectors gives no rows. A component that is too large for 64-bit arithmetic is worked with as
    a whole number of any size; a distance or inertia beyond 64 bits, or a sum of components beyond 38 digits, is an error.
    """
    if not 0 < centroids <= MAX_CENTROIDS:
        raise ValueError(f"1 to {MAX_CENTROIDS} centroids")
    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale is a power of two")
    x = F.col("_vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = checkpointed(
        vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_vector"))
        .where(x.isNotNull() & (F.size(x) == dimension) & finite)
    )
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("_key").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(name, "_vector").limit(centroids).collect()
    schema = T.StructType([
        T.StructField("_key", kept.schema["_key"].dataType), T.StructField("cluster", T.IntegerType()),
        T.StructField("distance", T.LongType()), T.StructField("compared", T.LongType()),
    ])
    columns = [F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"]
    if not first:
        sums = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
        none = vectors.sparkSession.createDataFrame([], schema)
        return none.join(vectors.sparkSession.createDataFrame([], sums), "cluster").select(*columns)
    points = [[int(v) for v in row] for row in whole(np.array([r["_vector"] for r in first], dtype=np.float64), scale)]
    for _ in range(rounds):
        sums = _sums(kept, Centroids.of(points), dimension, scale)
        points = [
            [sums[c, p][0] // sums[c, p][1] if (c, p) in sums else v for p, v in enumerate(row)]
            for c, row in enumerate(points)
        ]
    last, arrow = Centroids.of(points), to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, rows=_STEP_ROWS):
            number, distance, compared = last.nearest(whole(_matrix(batch.column("_vector"), dimension), scale))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(number, pa.int32()), pa.array([int(d) for d in distance], pa.int64()),
                 pa.array(compared, pa.int64())], schema=arrow)

    placed = checkpointed(kept.mapInArrow(place, schema))
    # One row per centroid.
    inertia = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in points]
    rows = [(c, d, sum(inertia.values()), digests[c]) for c, d in inertia.items()]
    known = vectors.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select(*columns)
