"""Exact duplicates by sorting the texts.

Every input partition is sorted by the bytes of its texts (Spark's external sort), so equal texts are
neighbours; a comparison of whole neighbouring texts numbers them. What a partition has of a text is
thereby one row, so a text that is a third of all rows is no more rows than there are partitions.
Those rows are placed by ranges, whose splitters Spark draws from a sample, and sorted again; a second
comparison of neighbours gives each text its smallest (or largest) identifier and its number of rows. The rows
of the table learn these by (partition, number in it), which is never hot.

The order is that of the first 64 bytes, of a hash of the text, and of the whole bytes: equal texts are
adjacent in it like in the plain order, but texts that share a long beginning can still be
divided between ranges, and the sample on the driver holds 72 bytes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperlens.llm.arrow import steps
from paperlens.llm.store import written

SPLIT_BYTES = 64


def starts_of_runs(texts: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """True where a text differs from the one before it; ``last`` is the one before the first."""
    new = np.ones(len(texts), dtype=bool)
    if len(texts):
        new[0] = last is None or texts[0] != last
        new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
    return new


def _copy(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
    return batch.take(pa.array(rows))


def _number_texts(out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (_id, carried, _bytes) to a row for each with the number of its text, and after the last
    row of a text one with its bytes, first id and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, last = TaskContext.get().partitionId(), -1, None
        head, count = None, 0  # first row of the open text, and its rows so far

        def filled(given: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [given.get(f.name, pa.nulls(rows, f.type)).cast(f.type) for f in out], schema=out)

        def texts(heads: pa.RecordBatch, numbers: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            rows = heads.num_rows
            return filled({
                "_id": heads.column("_id"), "_bytes": heads.column("_bytes"), "_part": pa.array(np.full(rows, part)),
                "_number": pa.array(numbers), "_count": pa.array(counts),
            }, rows)

        for batch in steps(batches, "_bytes"):
            new = starts_of_runs(batch.column("_bytes"), last)
            last = batch.column("_bytes")[batch.num_rows - 1]
            numbers, at = number + np.cumsum(new), np.flatnonzero(new)
            carried = {c: batch.column(c) for c in batch.schema.names if c != "_bytes"}
            yield filled(carried | {
                "_part": pa.array(np.full(batch.num_rows, part)), "_number": pa.array(numbers), "_first": pa.array(new),
            }, batch.num_rows)
            if not len(at):
                count += batch.num_rows
                continue
            if head is not None:
                yield texts(head, np.array([number]), np.array([count + at[0]]))
            if len(at) > 1:
                yield texts(_copy(batch, at[:-1]), numbers[at[:-1]], np.diff(at))
            head, count, number = _copy(batch, at[-1:]), batch.num_rows - at[-1], int(numbers[-1])
        if head is not None:
            yield texts(head, np.array([number]), np.array([count]))

    return run


def _merge_texts(out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows of texts to (_part, _number, first id, rows of the text, whether it holds the first id, digest)."""
    kept = ["_part", "_number", "_id", "_count", "_sha"]

    def finished(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        """``rows`` are whole texts."""
        at, run = np.flatnonzero(new), np.cumsum(new) - 1
        sizes = np.add.reduceat(rows["_count"].to_numpy(), at)
        columns = [rows["_part"], rows["_number"], rows["_id"].take(pa.array(at[run])), pa.array(sizes[run]),
                   pa.array(new), rows["_sha"]]
        arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The open text: its rows so far, at most one per input partition, without their bytes.
        last, held = None, []
        for batch in steps(batches, "_bytes"):
            new = starts_of_runs(batch.column("_bytes"), last)
            last = batch.column("_bytes")[batch.num_rows - 1]
            rows, at = batch.select(kept), np.flatnonzero(new)
            if not len(at):
                held.append(_copy(rows, np.arange(batch.num_rows)))
                continue
            whole = pa.Table.from_batches([*held, rows.slice(0, at[-1])])
            before = whole.num_rows - at[-1]
            if whole.num_rows:
                flags = np.concatenate([np.zeros(before, dtype=bool), new[:at[-1]]])
                flags[0] = True
                yield finished(whole, flags)
            held = [_copy(rows, np.arange(at[-1], batch.num_rows))]
        if held:
            rest = pa.Table.from_batches(held)
            yield finished(rest, np.arange(rest.num_rows) == 0)

    return run


def exact_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``carry``, ``key``, keep_id, group_size, kept and text_sha256.

    Texts are equal when their bytes after ``normalise`` (none by default) are; null counts as empty. Of
    equal texts the row with the ``smallest`` or ``largest`` key stays, null keys coming last; of rows that
    agree in key, too, exactly one. keep_id is the key of the row that stays, group_size the number of rows with the
    text, text_sha256 the digest of the normalised text. Empty, very long and repeated texts are texts
    like others. An empty table gives no rows. Columns of ``docs`` that are not named do not matter.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.select(
        F.col(f"`{key}`").alias("_id"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)],
        (normalise(words) if normalise else words).cast("binary").alias("_bytes"),
    )
    order = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    numbered = T.StructType([
        *source.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_number", T.LongType()),
        T.StructField("_first", T.BooleanType()), T.StructField("_count", T.LongType()),
    ])
    numbered = T.StructType([T.StructField(f.name, f.dataType, True) for f in numbered])
    rows = written(
        source.sortWithinPartitions("_bytes", order).mapInArrow(_number_texts(to_arrow_schema(numbered)), numbered),
        "exactdup")
    merged = T.StructType([
        T.StructField("_part", T.IntegerType()), T.StructField("_number", T.LongType()),
        T.StructField("keep_id", source.schema["_id"].dataType), T.StructField("group_size", T.LongType()),
        T.StructField("_holds", T.BooleanType()), T.StructField("text_sha256", T.StringType()),
    ])
    sorting = [F.substring("_bytes", 1, SPLIT_BYTES).alias("_start"), F.xxhash64("_bytes").alias("_hash")]
    classes = (
        rows.where(F.col("_count").isNotNull())
        .select("_part", "_number", "_id", "_count", "_bytes", F.sha2("_bytes", 256).alias("_sha"), *sorting)
        .repartitionByRange("_start", "_hash").sortWithinPartitions("_start", "_hash", "_bytes", order, "_part", "_number")
        .drop("_start", "_hash").mapInArrow(_merge_texts(to_arrow_schema(merged)), merged)
    )
    return rows.where(F.col("_count").isNull()).join(classes, ["_part", "_number"]).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.col("_id").alias(key),
        "keep_id", "group_size", (F.col("_first") & F.col("_holds")).alias("kept"), "text_sha256",
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", *, keep: str = "smallest",
                normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, whole and unchanged."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, of = names.index(key), names.index(text)
    found = exact_classes(
        plain.withColumn("id", F.col(f"c{at}")), "id", f"c{of}", keep=keep, normalise=normalise, carry=plain.columns)
    return found.where("kept").select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
