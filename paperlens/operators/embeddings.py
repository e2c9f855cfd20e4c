"""Vectors of papers from word vectors, and mean vectors per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperlens.functions.text import TokenFn
from paperlens.operators import frames
from paperlens.operators.bow import unknown_term_weight
from paperlens.operators.frames import has_at_most
from paperlens.operators.pivots import matrix
from paperlens.operators.tokens import tokenize_texts
from paperlens.session import written
from paperlens.sources.catalog import DIMENSION

_ROW_BYTES = 100  # a broadcast word apart from its vector
_PART_ROWS = 100_000  # rows of rare terms whose vectors meet in a task
_SLICE = 1_000  # ids that are added up at once
_TOKENS = 1 << 16  # that are added up at once


def _element_sums(
    df: DataFrame, keys: Sequence[str], vector: str, weight: Column, dimension: int | None,
    total: str | None = None,
) -> DataFrame:
    """Per key: sum of weight * vector by element, over the sum of weights. Keys of total 0 drop out.
    ``total`` names a column for the sum of weights.

    With a known dimension every element is a column of one hash aggregate, so tasks
    combine their rows before the shuffle; otherwise elements are exploded first. Vectors come
    from ``_checked``.
    """
    kept = [F.col("_n").alias(total)] if total else []
    if dimension is None:
        exploded = df.select(*keys, weight.alias("_w"), F.posexplode(vector).alias("_pos", "_x"))
        means = exploded.groupBy(*keys, "_pos").agg(
            F.sum(F.col("_x") * F.col("_w")).alias("_s"), F.sum("_w").alias("_n"), F.count("*").alias("_rows")
        )
        packed = F.array_sort(F.collect_list(F.struct("_pos", F.try_divide("_s", "_n").alias("_x"))))
        packed = F.when(F.min("_rows") == F.max("_rows"), packed).otherwise(
            F.raise_error(F.lit("vectors differ in length")).cast("array<struct<_pos:int,_x:double>>"))
        return means.groupBy(*keys).agg(packed.alias("_packed"), F.max("_n").alias("_n")).where(F.col("_n") != 0).select(
            *keys, F.transform("_packed", lambda e: e["_x"]).alias("embedding"), *kept
        )
    weighted = df.select(*keys, weight.alias("_w"), F.col(vector).alias("_v"))
    sums = [F.sum(F.col("_v")[i] * F.col("_w")).alias(f"_s{i}") for i in range(dimension)]
    summed = weighted.groupBy(*keys).agg(F.sum("_w").alias("_n"), *sums)
    return summed.where(F.col("_n") != 0).select(
        *keys, F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(dimension)]).alias("embedding"), *kept
    )


def _checked(vector: Column, dimension: int | None) -> Column:
    """``vector`` as doubles; one of another length than the given one, or with a null element, is an error."""
    whole = ~F.exists(vector, lambda x: x.isNull())
    fits = whole if dimension is None else (F.size(vector) == dimension) & whole
    wrong = F.raise_error(F.lit("vectors differ in length or have null elements")).cast("array<double>")
    return F.when(vector.isNull() | fits, vector.cast("array<double>")).otherwise(wrong)


def centroids(
    df: DataFrame, *keys: str, vector: str = "embedding", weight: str | None = None,
    total: str | None = None, dimension: int | None = None,
) -> DataFrame:
    """Element-wise mean of the vectors of each key, by ``weight`` if given; ``total`` adds its sum, or the count."""
    share = F.lit(1.0) if weight is None else F.col(weight)
    rows = df.where(F.col(vector).isNotNull()).withColumn(vector, _checked(F.col(vector), dimension))
    return _element_sums(rows, keys, vector, share, dimension, total)


def _vocabulary(word_vectors: DataFrame) -> DataFrame:
    """(term, _vector) of the words that have one."""
    return word_vectors.select(F.col("word").alias("term"), F.col("embedding").alias("_vector")).where(
        F.col("_vector").isNotNull())


def _packed(words: DataFrame, dimension: int | None) -> tuple[DataFrame, np.ndarray, np.ndarray | None]:
    """(term, _number), and the vectors and weights of the words by number, in the type they are stored in."""
    table = words.toArrow()
    vectors = matrix(table["_vector"])
    if table["_vector"].combine_chunks().flatten().null_count or (dimension is not None and len(table) and vectors.shape[1] != dimension):
        raise ValueError("vectors differ in length or have null elements")
    numbers = pa.table({"term": table["term"], "_number": pa.array(range(len(table)), pa.int32())})
    weights = table["weight"].to_numpy() if "weight" in table.column_names else None
    return words.sparkSession.createDataFrame(numbers, "term string, _number int"), vectors, weights


def _partial_sums(rows: DataFrame, vectors: np.ndarray, weights: np.ndarray | None) -> DataFrame:
    """(id, _w, _sums): the weighted sum of the vectors of each run of rows with one id, and of their weights.

    ``rows(id, _number[, weight])``; without a weight that of the word counts. A run costs one reduction of a slice
    of the matrix of vectors; runs of an id are added up later.
    """
    schema = T.StructType([
        rows.schema["id"], T.StructField("_w", T.DoubleType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))])
    arrow, sent = to_arrow_schema(schema), rows.sparkSession.sparkContext.broadcast((vectors, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weights = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, number = batch.column("id"), batch.column("_number").to_numpy()
            w = weights[number] if weights is not None else batch.column("weight").cast(pa.float64()).fill_null(0.0).to_numpy()
            new = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            sums = np.add.reduceat(vectors[number] * w[:, None], starts, axis=0)
            offsets = pa.array(np.arange(0, sums.size + 1, sums.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(starts)), pa.array(np.add.reduceat(w, starts)),
                pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1)))], schema=arrow)

    return rows.mapInArrow(run, schema)


def _rare_sums(rows: DataFrame, words: DataFrame, dimension: int | None) -> DataFrame:
    """As ``_partial_sums``, of ``rows(id, term[, weight])`` over ``words(term, _vector[, weight])`` too many to be packed.

    Ids are dealt into parts. A vector goes to each part with its term, and all terms of an id are added up there, so
    no vector travels with every row and no sum with every term. A part holds ``_PART_ROWS`` rows.
    """
    by_word = "weight" in words.columns
    parts = max(1, -(-rows.count() // _PART_ROWS))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    carried = [F.col("weight").alias("_of_word")] if by_word else []
    vector = F.when(_checked(F.col("_vector"), dimension).isNotNull(), F.col("_vector")).alias("_vector")
    sent = dealt.select(F.col("_part").alias("_to"), F.col("term").alias("_word")).distinct().join(
        words.select(F.col("term").alias("_word"), vector, *carried), "_word")
    schema = T.StructType([
        rows.schema["id"], T.StructField("_w", T.DoubleType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return arrow.empty_table()
        vectors, at = matrix(right["_vector"]), pa.array(np.arange(len(right)), pa.int64())
        met = left.join(pa.table({"term": right["_word"], "_at": at}), "term", join_type="inner", use_threads=False)
        ids = met["id"].combine_chunks().dictionary_encode(null_encoding="encode")
        order = np.argsort(ids.indices.to_numpy(), kind="stable")
        code, number = ids.indices.to_numpy()[order], met["_at"].to_numpy()[order]
        w = (right["_of_word"].to_numpy()[number] if by_word
             else pc.fill_null(met["weight"].cast(pa.float64()), 0.0).to_numpy()[order])
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        # Slices of ids, so that no row of the part has its vector twice at once.
        sums = np.concatenate([
            np.add.reduceat(vectors[number[low:high]] * w[low:high, None], starts[a:a + _SLICE] - low, axis=0)
            for a in range(0, len(starts), _SLICE)
            for low, high in [(starts[a], starts[a + _SLICE] if a + _SLICE < len(starts) else len(code))]
        ]) if len(starts) else np.zeros((0, vectors.shape[1]))
        offsets = pa.array(np.arange(0, sums.size + 1, vectors.shape[1]), pa.int32())
        return pa.Table.from_arrays([
            ids.dictionary.take(pa.array(code[starts])), pa.array(np.add.reduceat(w, starts) if len(starts) else w),
            pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1)))], schema=arrow)

    return dealt.groupBy("_part").cogroup(sent.groupBy("_to")).applyInArrow(add, schema)


def _numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """``words`` stored with a dense ``_number``, and how many there are."""
    stored = written(words.withColumn("_at", F.monotonically_increasing_id()), "words")
    part = F.shiftright("_at", 33)
    counts = sorted(stored.groupBy(part.alias("_of")).count().collect())
    firsts = np.cumsum([0, *[n for _, n in counts]])
    offsets = words.sparkSession.createDataFrame(
        [(p, int(first)) for (p, _), first in zip(counts, firsts)], "_of bigint, _first bigint")
    number = (F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int")
    return stored.withColumn("_of", part).join(F.broadcast(offsets), "_of").withColumn(
        "_number", number).drop("_of", "_first", "_at"), int(firsts[-1])


def _runs(rows: DataFrame) -> DataFrame:
    """(id, _numbers[, _weights]): a row for each run of rows with one id."""
    schema = T.StructType([rows.schema["id"], T.StructField("_numbers", T.ArrayType(T.IntegerType()))])
    weighted = "weight" in rows.columns
    schema = schema.add("_weights", T.ArrayType(T.DoubleType())) if weighted else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id")
            new = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            offsets = pa.array(np.append(starts, len(ids)), pa.int32())
            lists = [batch.column("_number")]
            lists += [batch.column("weight").cast(pa.float64()).fill_null(0.0)] if weighted else []
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(starts)), *[pa.ListArray.from_arrays(offsets, x) for x in lists]], schema=arrow)

    return rows.mapInArrow(run, schema)


def _run_sums(runs: DataFrame, sent, width: int) -> DataFrame:
    """(id, _w, _sums) of each of ``_runs``, over (vectors, weights of the words or none) as ``sent``."""
    schema = T.StructType([
        runs.schema["id"], T.StructField("_w", T.DoubleType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weights = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("_numbers")
            number, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
            w = weights[number] if weights is not None else batch.column("_weights").flatten().to_numpy()
            starts = np.append(0, ends[:-1])
            sums, low = np.empty((len(starts), width)), 0
            while low < len(starts):
                high = max(low + 1, int(np.searchsorted(ends, starts[low] + _TOKENS, "right")))
                part = slice(starts[low], ends[high - 1])
                sums[low:high] = np.add.reduceat(vectors[number[part]] * w[part, None], starts[low:high] - starts[low], axis=0)
                low = high
            offsets = pa.array(np.arange(0, sums.size + 1, width), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(np.add.reduceat(w, starts)),
                pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1)))], schema=arrow)

    return runs.mapInArrow(run, schema)


def _means_by_slices(
    rows: DataFrame, words: DataFrame, rare: DataFrame | None, left: DataFrame | None, dimension: int | None,
) -> DataFrame:
    """As ``_weighted_means`` over ``words``, some elements of all their vectors at a time, and ``left`` rows over ``rare`` ones.

    Terms become numbers once and are stored, so no vector travels with a term or to a part of the ids; each slice
    of the elements is one pass over the numbers. Only sums of runs are shuffled, and the rows of rare words.
    """
    spark = rows.sparkSession
    vector = F.when(_checked(F.col("_vector"), dimension).isNotNull(), F.col("_vector")).alias("_vector")
    words, count = _numbered(words.select("term", vector, *[c for c in ("weight",) if c in words.columns]))
    lengths = words.agg(F.min(F.size("_vector")), F.max(F.size("_vector"))).first()
    if lengths[0] != lengths[1]:
        raise ValueError("vectors differ in length or have null elements")
    kind = np.float32 if words.schema["_vector"].dataType.elementType == T.FloatType() else np.float64
    width, step = lengths[1], max(1, min(lengths[1], frames.BROADCAST_BYTES // (count * np.dtype(kind).itemsize)))
    numbers = words.select("term", "_number")
    runs = written(_runs(rows.join(F.broadcast(numbers), "term").drop("term")), "runs")
    weights = None
    if "weight" in words.columns:
        table = words.select("_number", "weight").toArrow()
        weights = np.zeros(count)
        weights[table["_number"].to_numpy()] = table["weight"].to_numpy()
    parts = None
    for low in range(0, width, step):
        table = words.select("_number", F.slice("_vector", low + 1, step).alias("_vector")).toArrow()
        vectors = np.empty((count, min(step, width - low)), kind)
        vectors[table["_number"].to_numpy()] = matrix(table["_vector"])
        del table
        sent = spark.sparkContext.broadcast((vectors, weights))
        sums = written(_run_sums(runs, sent, vectors.shape[1]).withColumn("_low", F.lit(low)), "sums")
        sent.destroy()
        parts = sums if parts is None else parts.unionByName(sums)
    if left is not None:
        lows = F.explode(F.transform(F.lit(list(range(0, width, step))), lambda low: F.struct(
            low.alias("_low"), F.slice("_sums", low + 1, step).alias("_sums")))).alias("_slice")
        parts = parts.unionByName(_rare_sums(left, rare, dimension).select("id", "_w", lows).select("id", "_w", "_slice._sums", "_slice._low"))
    added = parts.repartition("id").groupBy("id", "_low").agg(
        F.sum("_w").alias("_w"), F.array(*[F.sum(F.get("_sums", F.lit(i))) for i in range(step)]).alias("_part"))
    summed = added.groupBy("id").agg(
        F.max(F.when(F.col("_low") == 0, F.col("_w"))).alias("_w"), F.sort_array(F.collect_list(F.struct("_low", "_part"))).alias("_parts"))
    whole = F.slice(F.flatten(F.transform("_parts", lambda p: p["_part"])), 1, width)
    return summed.where(F.col("_w") != 0).select(
        "id", F.transform(whole, lambda x: x / F.col("_w")).alias("embedding"))


def _weighted_means(rows: DataFrame, words: DataFrame, dimension: int | None, *, store: bool = False) -> DataFrame:
    """(id, embedding) of ``rows(id, term[, weight])`` over ``words(term, _vector[, weight])``.

    Words go out packed: terms with numbers by a broadcast join, vectors as one matrix, so tokens are not
    shuffled and the terms of an id shrink to a row per run. Vectors too large for that go out by slices of their elements,
    as long as the terms fit a broadcast. Of more terms that holds for the most frequent ones, as many as fit; only the rare
    remainder is shuffled, so no frequent term is ever a hot key. The rows are then read several times; ``store``
    writes them first.
    """
    single = words.schema["_vector"].dataType.elementType == T.FloatType()
    limit = max(1, frames.BROADCAST_BYTES // (_ROW_BYTES + (4 if single else 8) * (dimension or DIMENSION)))
    carried = [c for c in ("id", "term", "weight") if c in rows.columns]
    if has_at_most(words.select("term"), limit):
        frequent, rare = words, None
    else:
        rows = written(rows.select(*carried), "terms") if store else rows
        most = frames.BROADCAST_BYTES // _ROW_BYTES
        if most and has_at_most(words.select("term"), most):
            return _means_by_slices(rows.select(*carried), words, None, None, dimension)
        often = frames.frequent_keys(rows, ["term"], most or limit, most=bool(most))
        frequent, rare = words.join(F.broadcast(often), "term", "left_semi"), words.join(F.broadcast(often), "term", "left_anti")
        if most and not has_at_most(frequent, 0):
            left = rows.select(*carried).join(F.broadcast(often), "term", "left_anti")
            return _means_by_slices(rows.select(*carried), frequent, rare, left, dimension)
    numbers, vectors, weights = _packed(frequent, dimension)
    width = vectors.shape[1] if len(vectors) else dimension
    numbered = rows.select(*carried).join(F.broadcast(numbers), "term").drop("term")
    parts = _partial_sums(numbered, vectors, weights)
    if rare is not None:
        left = rows.select(*carried).join(F.broadcast(often), "term", "left_anti")
        parts = parts.unionByName(_rare_sums(left, rare, dimension))
        width = width or len(words.first()["_vector"])
    if width is None:
        return parts.select("id", F.col("_sums").alias("embedding")).limit(0)
    summed = parts.groupBy("id").agg(F.sum("_w").alias("_w"), *[F.sum(F.col("_sums")[i]).alias(f"_s{i}") for i in range(width)])
    return summed.where(F.col("_w") != 0).select(
        "id", F.array(*[F.col(f"_s{i}") / F.col("_w") for i in range(width)]).alias("embedding"))


def embed_bow(bow: DataFrame, word_vectors: DataFrame, *, dimension: int | None = None) -> DataFrame:
    """(id, embedding): mean of the vectors of the terms of each id, by weight.

    Terms without a vector count neither above nor below the line; an id without any
    known term, or with total weight 0, is left out. Best fed from stored maps, where the
    terms of an id lie together; those of a large vocabulary are read three times.
    """
    return _weighted_means(bow.select("id", "term", "weight"), _vocabulary(word_vectors), dimension)


def embed_tokens(
    tokenized: DataFrame, word_vectors: DataFrame, idf: DataFrame, *,
    unknown_weight: float | None = None, dimension: int | None = None,
) -> DataFrame:
    """``embed_bow`` of the tf-idf weights of the tokens, without forming the bags of words.

    Every occurrence counts with its idf: the number of tokens of an id divides both sums
    of the mean and cancels out. The idf is attached to the vocabulary, not to the tokens.
    """
    weights = idf.select(F.col("token").alias("term"), F.col("weight").alias("_idf"))
    words = (
        _vocabulary(word_vectors)
        .join(weights, "term", "left")
        .select("term", "_vector", F.coalesce("_idf", unknown_term_weight(idf, unknown_weight)).alias("weight"))
    )
    rows = tokenized.select("id", F.explode("terms").alias("term"))
    return _weighted_means(rows, words, dimension, store=True)


def embed_texts(
    df: DataFrame, word_vectors: DataFrame, idf: DataFrame, *, id: str = "id", text: str = "text",
    unknown_weight: float | None = None, token_fn: TokenFn | None = None, dimension: int | None = None,
) -> DataFrame:
    """Texts to vectors: tokenize, weigh, average."""
    tokenized = tokenize_texts(df, id, text, token_fn=token_fn)
    return embed_tokens(tokenized, word_vectors, idf, unknown_weight=unknown_weight, dimension=dimension)


def embed_submissions(
    submissions: DataFrame, word_vectors: DataFrame, idf: DataFrame, *, id: str = "query_id",
    text: str = "text", dimension: int | None = None,
) -> DataFrame:
    """``embed_texts`` with weight 0 for unknown terms, as (``id``, embedding)."""
    vectors = embed_texts(
        submissions, word_vectors, idf, id=id, text=text, unknown_weight=0.0, dimension=dimension
    )
    return vectors.withColumnRenamed("id", id)
