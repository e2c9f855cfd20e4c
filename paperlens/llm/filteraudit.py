"""How filters work together: what each removes in every order they can be applied in.

Five filters have 32 subsets. A document becomes a 32-bit word whose bit S tells that it survives all filters of the
subset S. Words are added up bit by bit with carry-save adders (three words become a sum and a carry), so
a batch costs a few bit operations a document and not 32 sums. From the survivors of all subsets, by part and label, follows
everything about all 120 orders: what a filter removes at a step is what the filters before it leave, less
what is left with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperlens.llm.arrow import map_texts, steps
from paperlens.session import checkpointed

LETTERS = "ABCDE"
FILTERS = len(LETTERS)
SUBSETS = 1 << FILTERS
LABELS = ("all", "good", "toxic")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
_REPEATED = 1 << LETTERS.index("E")
# Word of a document that fails the filters of a mask.
SURVIVES = np.array(
    [sum(1 << subset for subset in range(SUBSETS) if not subset & failed) for failed in range(SUBSETS)], dtype=np.uint32)


def subset_counts(words: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For each of the 32 bits the number of words that have it, a word counting ``copies`` times.

    Words wait at the levels of the binary digits of their copies. At a level three words become one there and
    one carry at the next, until two are left to be read bit by bit.
    """
    levels = [[words[(copies >> b) & 1 == 1]] for b in range(int(copies.max(initial=0)).bit_length())]
    counts, level = np.zeros(SUBSETS, dtype=np.int64), 0
    while level < len(levels):
        here = np.concatenate(levels[level])
        while len(here) > 2:
            third = len(here) // 3
            a, b, c = here[:3 * third].reshape(3, third)
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append((a & b) | (c & (a ^ b)))
            here = np.concatenate([a ^ b ^ c, here[3 * third:]])
        for word in here:
            counts += ((int(word) >> np.arange(SUBSETS)) & 1) << level
        level += 1
    return counts


def text_masks(texts: pa.Array) -> list[list]:
    """The filters that judge a text alone, as a mask, and the digest of the text."""
    masks, digests = [], []
    for text in texts.to_pylist():
        text = text or ""
        data = text.encode()
        words = data.split()  # at space, tab, line feed, vertical tab, form feed and return
        capitals = len(data) - len(data.translate(None, _CAPITALS))
        masks.append(
            (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > MAX_CAPITAL_PERCENT * len(text)) << 2
            | (len(data.translate(None, _MARKS)) < len(data)) << 3)
        digests.append(hashlib.sha256(data).digest())
    return [masks, digests]


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(_key, _part, _mask, _copies): rows of ``docs`` by key, part and mask of the filters they fail.

    A: under 200 words; B: under half of the words are distinct; C: over 3 % capitals A-Z; D: one of ``#$%&*|``;
    E: the text of a smaller key, compared by its SHA-256. A null key is neither smaller nor larger than
    another; a null text is empty, a null part the empty string. Rows are counted before they meet the smallest
    key of their text, and meet it by text and key, so neither a frequent text nor a frequent key gathers in a task.
    """
    source = docs.select(
        F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("_part"),
        F.col(f"`{text}`").alias("_text"))
    judged = map_texts(source, "_text", {"_mask": pa.int32(), "_digest": pa.binary()}, "_mask int, _digest binary",
                       text_masks, raw=True)
    rows = checkpointed(judged)
    first = rows.where(F.col("_key").isNotNull()).groupBy("_digest").agg(F.min("_key").alias("_key")).withColumn(
        "_first", F.lit(True))
    counted = rows.groupBy("_digest", "_key", "_part", "_mask").agg(F.count("*").alias("_copies"))
    later = F.col("_key").isNotNull() & F.col("_first").isNull()
    mask = F.col("_mask").bitwiseOR(F.when(later, F.lit(_REPEATED)).otherwise(F.lit(0)))
    return counted.join(first, ["_digest", "_key"], "left").groupBy(
        "_key", "_part", mask.alias("_mask")).agg(F.sum("_copies").alias("_copies"))


def survivors(rows: DataFrame) -> DataFrame:
    """(part, counts): for each part the survivors of the 32 subsets among all, good and toxic documents, in one array.

    ``rows``: _part, _mask, _copies, _good, _toxic.
    """
    width = len(LABELS) * SUBSETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, rows=10_000):
            parts = batch.column("_part").dictionary_encode()
            of, names = parts.indices.to_numpy(), parts.dictionary
            order = np.argsort(of, kind="stable")
            words = SURVIVES[batch.column("_mask").to_numpy()][order]
            copies = batch.column("_copies").to_numpy()[order]
            wanted = [np.ones(len(of), dtype=bool)] + [
                batch.column(c).to_numpy(zero_copy_only=False)[order] for c in ("_good", "_toxic")]
            ends = np.searchsorted(of[order], np.arange(len(names) + 1))
            counts = np.zeros((len(names), len(LABELS), SUBSETS), dtype=np.int64)
            for at, (low, high) in enumerate(zip(ends, ends[1:])):
                for label, flags in enumerate(wanted):
                    mine = flags[low:high].astype(bool)
                    counts[at, label] = subset_counts(words[low:high][mine], copies[low:high][mine])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(names) * width + 1, width), pa.int32()), pa.array(counts.reshape(-1)))
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), lists], names=["part", "_counts"])

    batches = rows.select("_part", "_mask", "_copies", "_good", "_toxic").mapInArrow(run, "part string, _counts array<long>")
    summed = batches.groupBy("part").agg(*[F.sum(F.col("_counts")[i]).alias(f"_{i}") for i in range(width)])
    return summed.select("part", F.array(*[F.col(f"_{i}") for i in range(width)]).alias("counts"))


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def interactions(survivors: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what the filter of the step does there."""
    orders = ["".join(p) for p in permutations(LETTERS)]
    # Subset of the filters applied after each step, step 0 included.
    applied = [sum(1 << LETTERS.index(f) for f in order[:step]) for order in orders for step in range(FILTERS + 1)]

    def left(subset: Column | int, label: int = 0) -> Column:
        return F.get("counts", (F.lit(subset) if isinstance(subset, int) else subset) + F.lit(label * SUBSETS))

    def removed_over_orders(bit: int) -> Column:
        # A subset before the filter occurs in as many orders as its members and those after can be arranged.
        total = F.lit(0).cast("long")
        for subset in range(SUBSETS):
            if not subset & bit:
                before = subset.bit_count()
                total += (left(subset) - left(subset | bit)) * (factorial(before) * factorial(FILTERS - 1 - before))
        return total

    def per_filter(value) -> Column:
        return F.array(*[value(1 << f) for f in range(FILTERS)])

    every = SUBSETS - 1
    counted = survivors.select(
        "part", "counts", per_filter(lambda bit: left(0) - left(bit)).alias("_fails"),
        per_filter(lambda bit: left(every ^ bit) - left(every)).alias("_only"),
        per_filter(removed_over_orders).alias("_shapley"),
        F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("_order"))
    place = F.col("_order") * (FILTERS + 1) + F.col("step")
    steps_of = counted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(FILTERS)))).select(
        "*", F.get(F.split(F.lit(",".join(orders)), ","), F.col("_order")).alias("filter_order"),
        F.get(_numbers(applied), place).alias("_now"), F.get(_numbers(applied), place - 1).alias("_before"))
    steps_of = steps_of.withColumn(
        "_filter", F.instr(F.lit(LETTERS), F.expr("substring(filter_order, step, 1)")) - 1)

    def lost(label: int) -> Column:
        return left(F.col("_before"), label) - left(F.col("_now"), label)

    return steps_of.select(
        "part", "filter_order", "step", left(F.col("_now")).alias("kept"), lost(0).alias("removed"),
        (F.get("_fails", F.col("_filter")) - lost(0)).alias("redundant"),
        F.get("_only", F.col("_filter")).alias("unique_fails"), lost(1).alias("good_lost"), lost(2).alias("toxic_lost"),
        F.get("_shapley", F.col("_filter")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``interactions`` of the five filters over all of ``docs``, one set of 600 rows per part.

    Counts are of rows; a document is good or toxic if any row of ``labels`` with its key says so (1), and neither
    if the key is null or has no label. Empty and very long texts are texts like others. An empty table has no
    parts and gives no rows. Other columns do not matter.
    """
    flags = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_key")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"))
    rows = failures(docs, key, text, part).join(flags, "_key", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("_good", "_toxic")})
    return interactions(survivors(rows))
