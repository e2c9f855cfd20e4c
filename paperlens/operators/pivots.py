"""Exact search for many queries: vectors in blocks around pivots, visited nearest first.

Every vector belongs to its nearest pivot and, where areas count, to its set of areas; pivot and set make a
block, of which the least and largest distance from the pivot and all areas are known. By the triangle
inequality no vector of a block is nearer to a query than the query's distance to the pivot less that radius.
A query visits its nearest block first, then a few more, then all that can still hold one of its k
best; the distance of its k-th best so far travels with it from round to round. Blocks that share no area
with a query are never visited. What cannot be skipped is visited, so the result is that of comparing all.
In the last round neighbouring blocks are met together, up to a slice of vectors: where nothing can be ruled out, a
query is then sent once for each slice of all vectors and not once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperlens.functions.areas import WORD, area_mask
from paperlens.session import checkpointed

# Vectors of a pivot aimed at; pivots, and sets of areas with blocks of their own (the rarer ones share
# blocks), at most. So the driver knows 2^18 blocks at most.
PIVOT_ROWS = 4_000
MAX_PIVOTS, MAX_SETS = 1 << 10, 1 << 8
# Vectors and queries that meet in one group; larger blocks and more queries are split.
SLICE_ROWS = 20_000
# Blocks visited in the rounds before the last one.
VISITS = (1, 8)
_CELLS = 2_000_000  # entries of one matrix of queries by pivots or blocks


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if column.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors must be present and of equal length")
    return flat.reshape(len(column), int(lengths[0]))


def area_masks(column: pa.ChunkedArray | pa.Array, areas: pa.Array) -> np.ndarray:
    """Rows x words: the bits of the listed areas that ``areas`` knows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    masks = np.zeros((len(column), -(-len(areas) // WORD)), dtype=np.int64)
    if len(areas):
        positions = pc.index_in(column.flatten(), value_set=areas)
        known = pc.is_valid(positions).to_numpy(zero_copy_only=False)
        at = positions.drop_null().to_numpy().astype(np.int64)
        rows = pc.list_parent_indices(column).to_numpy()[known]
        np.bitwise_or.at(masks, (rows, at // WORD), np.int64(1) << at % WORD)
    return masks


def disjoint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """True where a mask of ``left`` and one of ``right`` share no bit."""
    none = np.ones((len(left), len(right)), dtype=bool)
    for word in range(left.shape[1] if none.size else 0):
        none &= (left[:, word, None] & right[None, :, word]) == 0
    return none


def _lists(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1]) if values.size else np.zeros(len(values) + 1)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.reshape(-1)))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if x.shape[1] != pivots.shape[1]:
        raise ValueError("vectors differ in length")
    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _finite(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows whose vector is finite, and their vectors: no other has a distance that ranks."""
    x = matrix(batch.column("embedding")).astype(np.float64, copy=False)
    whole = np.isfinite(x).all(axis=1)
    return (batch, x) if whole.all() else (batch.filter(pa.array(whole)), x[whole])


@dataclass
class Blocks:
    """What is known of each block: its pivot, the distances from it, all areas and the number of vectors."""

    pivots: np.ndarray
    areas: list[str] | None
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    masks: np.ndarray
    sizes: np.ndarray

    def grouped(self, rows: int) -> np.ndarray:
        """Number of the group of each block: blocks in order, of one set of areas after the other, up to ``rows`` vectors."""
        groups, group, held = np.zeros(len(self.sizes), dtype=np.int32), 0, 0
        for block, size in enumerate(self.sizes):
            if held and held + size > rows:
                group, held = group + 1, 0
            groups[block], held = group, held + int(size)
        return groups

    def to_visit(self, x: np.ndarray, masks: np.ndarray, bound: np.ndarray, seen: list, farthest: bool, most: int | None):
        """For each query the blocks to visit next: at most ``most``, nearest pivots first, of those not yet
        seen that share an area and can hold a vector within the bound."""
        away = _distances(x, self.pivots)
        # Distances to pivots come from a product that rounds; what is skipped is beyond that.
        slack = 1e-6 * (1.0 + np.sqrt((x * x).sum(axis=1))[:, None] + np.abs(self.pivots).max(initial=0.0) * x.shape[1] ** 0.5)
        to = away[:, self.pivot]
        reach = np.sqrt(bound)[:, None]
        if farthest:
            open_ = to + self.high + slack >= reach
        else:
            open_ = np.maximum(to - self.high, self.low - to) - slack <= reach
        if self.areas is not None:
            open_ &= ~disjoint(masks, self.masks)
        for row, numbers in enumerate(seen):
            open_[row, numbers] = False
        order = np.where(open_, -to if farthest else to, np.inf)
        if most is not None and most < order.shape[1]:
            chosen = np.argpartition(order, most - 1, axis=1)[:, :most]
            return [row[open_[at, row]] for at, row in enumerate(chosen)]
        return [np.flatnonzero(row) for row in open_]

@dataclass
class PivotIndex:
    """Vectors (id, embedding, _mask, _block, _salt) by block."""

    rows: DataFrame
    blocks: Blocks

    @classmethod
    def build(cls, vectors: DataFrame, areas: Sequence[str] | None = None, *, pivot_rows: int | None = None) -> "PivotIndex":
        """``vectors(id, embedding[, areas])``. With ``areas`` given, vectors with none of them are left out."""
        spark = vectors.sparkSession
        stored = checkpointed(vectors.withColumn("_salt", F.monotonically_increasing_id()))
        wanted = min(MAX_PIVOTS, -(-stored.count() // (pivot_rows or PIVOT_ROWS)))
        finite = ~F.exists("embedding", lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
        sample = stored.where(finite).orderBy(F.xxhash64("id", "_salt")).limit(wanted).select("embedding").toArrow()
        pivots = matrix(sample["embedding"]).astype(np.float64)
        known = None if areas is None else pa.array(areas, pa.string())
        words = 0 if known is None else -(-len(known) // WORD)
        placed = T.StructType([
            stored.schema["id"], stored.schema["embedding"], stored.schema["_salt"],
            T.StructField("_mask", T.ArrayType(T.LongType())), T.StructField("_pivot", T.IntegerType()),
            T.StructField("_distance", T.DoubleType()),
        ])
        arrow = to_arrow_schema(placed)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch, x = _finite(batch)
                masks = np.zeros((len(x), 0), dtype=np.int64) if known is None else area_masks(batch.column("areas"), known)
                if known is not None:
                    met = masks.any(axis=1)
                    batch, x, masks = batch.filter(pa.array(met)), x[met], masks[met]
                step = max(1, _CELLS // max(1, len(pivots)))
                for start in range(0, len(x), step):
                    part = slice(start, start + step)
                    away = _distances(x[part], pivots)
                    nearest = away.argmin(axis=1)
                    kept = batch.slice(start, step)
                    yield pa.RecordBatch.from_arrays([
                        kept.column("id"), kept.column("embedding"), kept.column("_salt"), _lists(masks[part]),
                        pa.array(nearest, pa.int32()), pa.array(away[np.arange(len(nearest)), nearest]),
                    ], schema=arrow)

        rows = checkpointed(stored.mapInArrow(place, placed))
        if known is None:
            rows = rows.withColumn("_set", F.lit(0))
        else:
            # Sets that make up 1/MAX_SETS of the vectors have blocks of their own.
            every = rows.count()
            often = rows.groupBy("_mask").agg(F.count("*").alias("n")).where(F.col("n") * MAX_SETS >= every).orderBy("_mask").collect()
            sets = spark.createDataFrame([(r["_mask"], at + 1) for at, r in enumerate(often)], "_mask array<long>, _set int")
            rows = rows.join(F.broadcast(sets), "_mask", "left").withColumn("_set", F.coalesce("_set", F.lit(0)))
        union = F.array(*[F.bit_or(F.col("_mask")[w]) for w in range(words)]) if words else F.array().cast("array<long>")
        blocks = rows.groupBy("_set", "_pivot").agg(
            F.min("_distance").alias("low"), F.max("_distance").alias("high"), F.count("*").alias("size"),
            union.alias("mask")).orderBy("_set", "_pivot").toArrow()
        number = spark.createDataFrame(
            pa.table({"_set": blocks["_set"], "_pivot": blocks["_pivot"], "_block": pa.array(range(len(blocks)), pa.int32())})
        ) if len(blocks) else spark.createDataFrame([], "_set int, _pivot int, _block int")
        dealt = rows.join(F.broadcast(number), ["_set", "_pivot"]).select("id", "embedding", "_mask", "_block", "_salt")
        return cls(dealt, Blocks(
            pivots, None if areas is None else list(areas),
            blocks["_pivot"].to_numpy(), blocks["low"].to_numpy(), blocks["high"].to_numpy(),
            matrix(blocks["mask"]).astype(np.int64).reshape(len(blocks), words),
            blocks["size"].to_numpy(),
        ))

    def _planned(self, queries: DataFrame, farthest: bool, most: int | None, groups: np.ndarray) -> DataFrame:
        """``queries`` with the groups of blocks of the next round as ``_visit``, and its blocks added to ``_seen`` unless
        it is the last."""
        blocks = T.ArrayType(T.IntegerType())
        kept = [f for f in queries.schema if f.name not in ("_seen", "_bound")]
        schema = T.StructType([*kept, T.StructField("_bound", T.DoubleType()), T.StructField("_seen", blocks), T.StructField("_visit", blocks)])
        arrow, none, known = to_arrow_schema(schema), 0.0 if farthest else np.inf, self.blocks
        step = max(1, _CELLS // max(1, len(known.sizes), len(known.pivots)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                whole, _ = _finite(whole)
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    x = matrix(batch.column("embedding")).astype(np.float64, copy=False)
                    masks = None if known.areas is None else matrix(batch.column("_mask"))
                    bound = batch.column("_bound").fill_null(none).to_numpy()
                    seen = [np.array(s, dtype=np.int32) for s in batch.column("_seen").to_pylist()]
                    visit = known.to_visit(x, masks, bound, seen, farthest, most)
                    if most is not None:
                        seen = [np.concatenate([s, v]).astype(np.int32) for s, v in zip(seen, visit)]
                    yield pa.RecordBatch.from_arrays([
                        *[batch.column(f.name) for f in kept], pa.array(bound),
                        pa.array(seen, arrow.field("_seen").type),
                        pa.array([np.unique(groups[v]) for v in visit], arrow.field("_visit").type),
                    ], schema=arrow)

        return queries.mapInArrow(run, schema)

    def with_masks(self, queries: DataFrame) -> DataFrame:
        """``queries`` with ``_mask`` in place of ``areas``."""
        if self.blocks.areas is None:
            return queries
        return queries.withColumn("_mask", area_mask("areas", self.blocks.areas)).drop("areas")

    def search(
        self, queries: DataFrame, k: int, meet: Callable[[pa.Table, pa.Table], pa.Table], out: T.StructType, *,
        farthest: bool = False, visits: Sequence[int] = VISITS, slice_rows: int | None = None,
    ) -> tuple[DataFrame, list[int]]:
        """The k best (query_id, id, d2) of ``queries(query_id, embedding[, areas][, exclude_id])``, and the pairs
        of query and block, or group of blocks in the last round, that each round visited.

        ``meet`` finds the best of a table of queries in a table of vectors.
        """
        rows = slice_rows or SLICE_ROWS
        state = self.with_masks(queries).withColumns({
            "_bound": F.lit(None).cast("double"), "_seen": F.array().cast("array<int>")})
        spark, counts = queries.sparkSession, []
        best = spark.createDataFrame([], out)
        for most in (*visits, None):
            groups = self.blocks.grouped(rows if most is None else 1)
            planned = checkpointed(self._planned(state, farthest, most, groups))
            pairs = planned.withColumn("_block", F.explode("_visit")).drop("_seen", "_visit")
            asked = pairs.groupBy("_block").agg(F.count("*").alias("n")).collect()
            counts.append(sum(r["n"] for r in asked))
            if not asked:
                state = planned.drop("_visit")
                continue
            state = planned.drop("_visit", "_bound")
            sizes = np.bincount(groups, weights=self.blocks.sizes)
            cells = F.broadcast(spark.createDataFrame(
                [(r["_block"], -(-int(sizes[r["_block"]]) // rows), -(-r["n"] // rows)) for r in asked],
                "_block int, _slices int, _parts int"))
            places = F.broadcast(spark.createDataFrame(pa.table(
                {"_block": pa.array(range(len(groups)), pa.int32()), "_group": pa.array(groups, pa.int32())})))

            def every(name: str) -> Column:
                return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

            def dealt(name: str, *by: str) -> Column:
                return F.pmod(F.xxhash64(*by), F.col(name)).cast("int")

            key = ["_block", "_slice", "_part"]
            left = pairs.join(cells, "_block").withColumn("_part", dealt("_parts", "query_id", "embedding")).withColumn(
                "_slice", every("_slices")).drop("_slices", "_parts")
            placed = self.rows.join(places, "_block").drop("_block").withColumnRenamed("_group", "_block")
            right = placed.join(cells, "_block").withColumn("_slice", dealt("_slices", "_salt")).withColumn(
                "_part", every("_parts")).drop("_slices", "_parts", "_salt")
            found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, out)
            best = checkpointed(k_best(best.unionByName(found), k, farthest).drop("rank"))
            last = best.groupBy("query_id").agg(
                F.count("*").alias("_n"), (F.min("d2") if farthest else F.max("d2")).alias("_bound"))
            state = state.join(last.where(F.col("_n") >= k).drop("_n"), "query_id", "left")
        return best, counts


def k_best(found: DataFrame, k: int, farthest: bool) -> DataFrame:
    """Of (query_id, id, d2) the k best of each query with their rank, an id counting once, ties in order of id."""
    best = found.groupBy("query_id", "id").agg((F.max("d2") if farthest else F.min("d2")).alias("d2"))
    window = Window.partitionBy("query_id").orderBy(F.desc("d2") if farthest else F.asc("d2"), "id")
    return best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
