"""Rows brought together by id in compressed blocks, so a shuffle of text takes a fraction of its bytes on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# Rows and bytes of a task that are dealt to the blocks at once.
_ROWS, _BYTES = 4_000_000, 64 << 20
_OUT_ROWS = 100_000
_SPREAD = 3
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def can_gather(df: DataFrame) -> bool:
    """Whether equal ids are equal as strings."""
    kind = df.schema["id"].dataType
    return isinstance(kind, T.IntegralType) or kind == T.StringType()


def _blocks(table: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    """(id_part, _block): the rows of each part, those of an id next to each other."""
    ids = table["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    code = ids.indices.to_numpy()
    names = ids.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False)
    part = (pd.util.hash_array(names.astype(object), categorize=False) % np.uint64(parts)).astype(np.int32)[code]
    order = np.lexsort((code, part))
    table, part = table.take(pa.array(order)), part[order]
    starts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
    blocks = []
    for low, high in zip(starts, starts[1:]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=_ZSTD) as writer:
            writer.write_table(table.slice(low, high - low).combine_chunks())
        blocks.append(sink.getvalue().to_pybytes())
    yield pa.RecordBatch.from_arrays([pa.array(part[starts[:-1]]), pa.array(blocks, pa.binary())], ["id_part", "_block"])


def gathered(
    df: DataFrame, prepare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]],
    finish: Callable[[pa.Table], pa.Table | None], schema: T.StructType | str,
) -> DataFrame:
    """``finish`` of all rows of some ids together, every id in one call.

    ``prepare`` makes tables with a column id of the batches of ``df``. What it makes is dealt by id, compressed
    and shuffled as one row for each part that a task has rows of.
    """
    # More parts than tasks, as several parts can fall to one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = tasks * _SPREAD

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for made in prepare(batches):
            waiting.append(made)
            if sum(map(len, waiting)) >= _ROWS or sum(t.nbytes for t in waiting) >= _BYTES:
                yield from _blocks(pa.concat_tables(waiting), parts)
                waiting = []
        if any(map(len, waiting)):
            yield from _blocks(pa.concat_tables(waiting), parts)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for part, block in zip(batch.column("id_part").to_pylist(), batch.column("_block")):
                met.setdefault(part, []).append(pa.ipc.open_stream(block.as_buffer()).read_all())
        for part in list(met):
            made = finish(pa.concat_tables(met.pop(part)))
            if made is not None:
                yield from made.combine_chunks().to_batches(max_chunksize=_OUT_ROWS)

    return df.mapInArrow(pack, "id_part int, _block binary").repartition(tasks, "id_part").mapInArrow(unpack, schema)


def by_id(table: pa.Table) -> tuple[pa.Array, pa.Table]:
    """The ids, and the rows with the place of their id as ``run`` instead, by it."""
    ids = table["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    run = ids.indices.to_numpy()
    table = table.drop_columns(["id"]).append_column("run", pa.array(run))
    return ids.dictionary, table if (np.diff(run) >= 0).all() else table.take(pa.array(np.argsort(run, kind="stable")))


def sums_by_term(table: pa.Table) -> tuple[pa.Array, pa.Table]:
    """The ids, and (run, term, n): ``n`` summed for each term of an id."""
    ids, rows = by_id(table)
    sums = rows.group_by(["run", "term"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["run", "term", "n"])
    return ids, sums
