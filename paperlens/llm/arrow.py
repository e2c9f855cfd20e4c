"""Map Arrow batches in small steps, so that a task holds few texts at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Rows and text bytes that one step works on; a single longer row is a step of its own.
STEP_ROWS = 2_000
STEP_BYTES = 16_000_000


def steps(batches: Iterator[pa.RecordBatch], column: str | None = None,
          rows: int = STEP_ROWS, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in their order, cut where either limit is reached."""
    for batch in batches:
        start = total = 0
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist() if column else []
        for at, length in enumerate(lengths):
            if at > start and (at - start >= rows or total + (length or 0) > size):
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += length or 0
        if column is None:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, min(rows, batch.num_rows - start))
        elif batch.num_rows:
            yield batch.slice(start)


def map_texts(df: DataFrame, text: str, added: dict[str, pa.DataType], schema: str,
              work: Callable[..., list[list]], keep_text: bool = False, also: str | None = None,
              raw: bool = False) -> DataFrame:
    """Add the columns that ``work`` makes of the texts (null counts as empty) of a step.

    ``added`` and ``schema`` give the new columns for Arrow and for Spark, in one order.
    ``also`` names a string column whose values ``work`` gets as second argument (null: empty);
    ``raw`` hands over Arrow arrays, nulls included, in place of lists.
    Columns of the same name are replaced.
    """
    kept = [c for c in df.columns if c not in added]
    source = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text, *([also] if also else [])])])
    kept = [c for c in kept if keep_text or c != text]
    out = StructType([df.schema[c] for c in kept]).simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in steps(batches, text):
            given = [batch.column(c) for c in ([text, also] if also else [text])]
            given = given if raw else [[t or "" for t in column.to_pylist()] for column in given]
            made = work(*given)
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array(values, kind) for values, kind in zip(made, added.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *added])

    return source.mapInArrow(run, ", ".join(x for x in (out, schema) if x))
