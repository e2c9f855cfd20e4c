"""Token tables: one row per sentence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperlens.functions.text import NUMERIC_MASKS, TokenFn, mask, sentences, tokens
from paperlens.operators.frames import computed_once
from paperlens.operators.gathered import can_gather, gathered, sums_by_term


def mask_texts(df: DataFrame, text: str = "text", masks: Sequence[tuple[str, str]] = NUMERIC_MASKS) -> DataFrame:
    return df.withColumn(text, mask(F.col(text), masks))


def tokenize_per_sentence(
    df: DataFrame, id: str = "id", text: str = "text", *,
    token_fn: TokenFn | None = None, masked: bool = False, lower: bool = False,
    with_position: bool = False,
) -> DataFrame:
    """(id, terms) per sentence that has a token; ``with_position`` adds the sentence number."""
    body = F.col(text)
    if masked:
        body = mask(body)
    if lower:
        body = F.lower(body)
    position = ["sentence"] if with_position else []
    return (
        df.select(F.col(id).alias("id"), F.posexplode(sentences(body)).alias("sentence", "_sentence"))
        .select("id", *position, computed_once(tokens(F.col("_sentence"), token_fn)).alias("terms"))
        .where(F.size("terms") > 0)
    )


def tokenize_texts(df: DataFrame, id: str = "id", text: str = "text", *, token_fn: TokenFn | None = None) -> DataFrame:
    """(id, terms) per text: the tokens of all its sentences in order."""
    per_sentence = F.transform(sentences(F.col(text)), lambda s: tokens(s, token_fn))
    return df.select(F.col(id).alias("id"), computed_once(F.flatten(per_sentence)).alias("terms"))


def tokenize_abstracts(papers: DataFrame) -> DataFrame:
    """Masked and lower-cased abstracts."""
    return tokenize_per_sentence(papers, "eid", "abstr", masked=True, lower=True)


def _counted_by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Table]]:
    """Ids, and (run, term, n) with the number of each term in all rows of an id; ``run`` is its place among the ids.

    An id whose rows stand together comes once: the counts of the last id of a batch wait for the next one.
    """
    ids = waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names, terms = batch.column("id"), batch.column("terms")
        if waiting is not None:
            names = pa.concat_arrays([ids, names])
        names = pc.dictionary_encode(names, null_encoding="encode")
        run = names.indices.to_numpy()[-batch.num_rows:]
        every = pa.table({"run": run[pc.list_parent_indices(terms).to_numpy()], "term": pc.list_flatten(terms)})
        counts = every.group_by(["run", "term"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["run", "term", "n"])
        if waiting is not None:
            first = pa.concat_tables([waiting, counts.filter(pc.equal(counts["run"], 0))])
            first = first.group_by(["run", "term"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["run", "term", "n"])
            counts = pa.concat_tables([first, counts.filter(pc.greater(counts["run"], 0))])
        last = int(run[-1])
        yield names.dictionary, counts.filter(pc.not_equal(counts["run"], last))
        waiting = counts.filter(pc.equal(counts["run"], last))
        waiting = waiting.set_column(0, "run", pa.array(np.zeros(len(waiting), run.dtype)))
        ids = names.dictionary.slice(last, 1)
    if waiting is not None:
        yield ids, waiting


def _together(tokenized: DataFrame) -> DataFrame:
    """Rows of an id in one task and next to each other; the tokens are shuffled once."""
    return tokenized.select("id", "terms").repartition("id").sortWithinPartitions("id")


def _long_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """(id, term, n): the counts of ``_counted_by_id``, of any rows."""
    for ids, counts in _counted_by_id(batches):
        if len(counts):
            run = counts["run"].combine_chunks()
            yield pa.table({"id": ids.take(run), "term": counts["term"], "n": counts["n"]})


def term_counts(tokenized: DataFrame) -> DataFrame:
    """(id, term, _count, _total): occurrences of each term among the tokens of an id, and the number of these tokens.

    Tasks send the counts of each id and not its tokens."""
    schema = T.StructType([
        tokenized.schema["id"], T.StructField("term", T.StringType()),
        T.StructField("_count", T.LongType()), T.StructField("_total", T.LongType())])
    arrow = to_arrow_schema(schema)

    def table(ids: pa.Array, counts: pa.Table) -> pa.Table:
        run, n = counts["run"].to_numpy(), counts["n"].to_numpy()
        total = np.bincount(run, n).astype(np.int64)
        return pa.table([ids.take(pa.array(run)), counts["term"], pa.array(n), pa.array(total[run])], schema.names).cast(arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts in _counted_by_id(batches):
            if len(counts):
                yield from table(ids, counts).combine_chunks().to_batches()

    if can_gather(tokenized):
        return gathered(tokenized.select("id", "terms"), _long_counts, lambda rows: table(*sums_by_term(rows)), schema)
    return _together(tokenized).mapInArrow(count, schema)


def ids_with_terms(tokenized: DataFrame) -> DataFrame:
    """(token, _n): in how many ids each token occurs, several rows for a token."""
    def found(counts: pa.Table) -> pa.Table:
        made = counts.group_by("term", use_threads=False).aggregate([([], "count_all")])
        return made.rename_columns(["token", "_n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, counts in _counted_by_id(batches):
            if len(counts):
                yield from found(counts).combine_chunks().to_batches()

    schema = "token string, _n long"
    if can_gather(tokenized):
        return gathered(tokenized.select("id", "terms"), _long_counts, lambda rows: found(sums_by_term(rows)[1]), schema)
    return _together(tokenized).mapInArrow(count, schema)
