"""Shards of near equal bytes by sampled splitters.

Rows are ordered by a hash of their text, so copies are neighbours, and by a hash of the row
within the copies. A sample in which a row counts by its size gives quantile splitters of this order;
rows are counted per range, and ranges with too many rows or bytes are subdivided evenly by key.
Positions in the whole order come from sums per range, sums per slice and a window inside each
slice, and a row's shard is where the middle of its bytes falls. Copies of a text stay together,
unless they alone fill several ranges; then they are cut where a shard is full.

DataFrame functions only. The driver sees the sample and the ranges, both of fixed size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlens.operators.frames import broadcast_if_small
from paperlens.session import checkpointed

SHARDS = 8
# Splitters, and sampled rows per splitter.
RANGES, SAMPLES_PER_RANGE = 1024, 32
# Rows of a slice, the group of the one window.
SLICE_ROWS = 50_000
# Bits of the key that tell rows of one text apart; 40 bits tell texts apart.
_ROW_BITS = 23
_ROW_SPAN = 1 << _ROW_BITS
_KEYS = 1 << 63


def _constants(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(key: Column, lows: list[int]) -> Column:
    """Number of the range of a key, by binary search in the sorted lower bounds."""
    bits = [1 << b for b in range(len(lows).bit_length() - 1, -1, -1)]
    bounds = _constants(lows)

    def step(low: Column, bit: Column) -> Column:
        inside = low + bit < len(lows)
        return F.when(inside & (F.get(bounds, low + bit) <= key), low + bit).otherwise(low)

    return F.aggregate(F.array(*[F.lit(b) for b in bits]), F.lit(0), step)


def splitters(sample: list[tuple[int, int]], ranges: int) -> list[int]:
    """Lower bounds of ranges of equal weight, from (key, weight) rows; the first is 0.

    A bound is moved to the first key of its text, unless the text holds several bounds.
    """
    total, seen, quantiles = sum(w for _, w in sample), 0, []
    for key, weight in sorted(sample):
        # The key where the share of the weight passes the next quantile.
        if (seen + weight) * ranges // total > seen * ranges // total:
            quantiles.append(key)
        seen += weight
    texts = [key >> _ROW_BITS for key in quantiles]
    bounds = {0}
    for key, text in zip(quantiles, texts, strict=True):
        if bisect_right(texts, text) - bisect_left(texts, text) > 1:
            bounds |= {key, text << _ROW_BITS, (text + 1) << _ROW_BITS}
        else:
            bounds.add(text << _ROW_BITS)
    return sorted(b for b in bounds if b < _KEYS)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, *,
          ranges: int = RANGES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``key``, size, text_crc32, shard and slot.

    size is the UTF-8 bytes of the text plus 1; null texts count as empty. slot counts from 0
    without gaps in each shard. Repeated rows are all placed, each in a slot of its own; a null key
    is a key. An empty table gives no rows. Other columns of ``docs`` do not matter.
    """
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = checkpointed(
        docs.select(
            F.col(f"`{key}`").alias("_id"), (F.octet_length(words) + 1).cast("long").alias("_size"),
            F.crc32(words.cast("binary")).alias("_crc"), F.xxhash64(words).alias("_text"),
            F.monotonically_increasing_id().alias("_row"),
        ).select(
            "_id", "_size", "_crc", "_row",
            F.shiftleft(F.shiftrightunsigned("_text", 64 - 40), _ROW_BITS).bitwiseOR(
                F.xxhash64("_id", "_row").bitwiseAND(_ROW_SPAN - 1)).alias("_key"),
        )
    )
    result = [F.col("_id").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32")]
    total = rows.agg(F.sum("_size")).first()[0]
    if total is None:
        return rows.select(*result, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    # Rows enter the sample in proportion to their size; a weight makes up for sizes above the step.
    wanted = ranges * SAMPLES_PER_RANGE
    step = max(1, total // wanted)
    chance = F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.where(chance * step < F.col("_size")).select(
        "_key", F.greatest("_size", F.lit(step)).alias("weight"))
    lows = splitters([(r["_key"], r["weight"]) for r in sample.collect()], ranges)

    ranged = rows.withColumn("_range", _range_of(F.col("_key"), lows))
    sums = {
        r["_range"]: (r["n"], r["bytes"]) for r in
        ranged.groupBy("_range").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes")).collect()
    }
    highs = [*lows[1:], _KEYS]
    widths, whole, rows_before, bytes_before, n, size = [], [], [], [], 0, 0
    for at, (low, high) in enumerate(zip(lows, highs, strict=True)):
        count, weight = sums.get(at, (0, 0))
        parts = max(1, -(-count // slice_rows), -(-weight * ranges // (2 * total)))
        # Slices of a range of several texts end between texts.
        unit = 1 if high - low <= _ROW_SPAN else _ROW_SPAN
        width = -(-(high - low) // parts)
        widths.append(-(-width // unit) * unit)
        whole.append(int(unit > 1))
        rows_before.append(n)
        bytes_before.append(size)
        n, size = n + count, size + weight

    def of_range(values: list[int]) -> Column:
        return F.get(_constants(values), F.col("_range"))

    sliced = (
        ranged.withColumn("_low", of_range(lows)).withColumn("_width", of_range(widths))
        .withColumn("_slice", F.expr("(_key - _low) div _width")).drop("_low", "_width")
    )
    slices = sliced.groupBy("_range", "_slice").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes"))
    earlier = Window.partitionBy("_range").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        "_range", "_slice",
        (of_range(rows_before) + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_rows_before"),
        (of_range(bytes_before) + F.coalesce(F.sum("_bytes").over(earlier), F.lit(0))).alias("_bytes_before"),
    )
    inside = Window.partitionBy("_range", "_slice").orderBy("_key", "_row")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    copies = Window.partitionBy("_range", "_slice", "_text")
    placed = (
        sliced.withColumn("_text", F.shiftright("_key", _ROW_BITS))
        .withColumn("_rank", F.row_number().over(inside) - 1)
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_first", F.min("_start").over(copies)).withColumn("_all", F.sum("_size").over(copies))
        .join(broadcast_if_small(offsets), ["_range", "_slice"])
    )
    middle = F.when(of_range(whole) == 1, F.col("_first") + F.col("_all") / 2).otherwise(
        F.col("_start") + F.col("_size") / 2) + F.col("_bytes_before")
    placed = checkpointed(placed.select(
        "_id", "_size", "_crc", (F.col("_rows_before") + F.col("_rank")).alias("_position"),
        F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int").alias("shard"),
    ))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("_position").alias("first")).collect()}
    starts = _constants([first.get(s, 0) for s in range(shards)])
    return placed.select(*result, "shard", (F.col("_position") - F.get(starts, F.col("shard"))).alias("slot"))
