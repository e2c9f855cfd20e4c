"""Benchmark decontamination with suffix arrays of the training text.

Each task turns its documents into shards of word numbers, in the vocabulary of the benchmark,
and sorts the suffixes of a shard. Every benchmark suffix that starts a window is found by binary
search; its interval in the suffix array gives all places of the window, and windows in a row
give the longest verbatim matches. Suffixes that cannot start a match, because too few words of
the vocabulary follow, are left out of the array, and suffixes are ordered by the words that a
window can have.

The benchmark is the query side. It is read in blocks of at most about ``BLOCK_BYTES``, each
broadcast as one index. With more blocks the documents are stored once and searched block by block; only the
matches are kept between blocks, so one index is alive at a time and no plan grows with the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from paperlens.llm.arrow import steps
from paperlens.llm.store import written
from paperlens.session import checkpointed

WINDOW = 10
BLOCK_BYTES = 8_000_000
# Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
# Text that is taken apart into words at a time, each of them an object.
STEP_BYTES = 4_000_000
# Words per sort key and bits per word.
_PER, _BITS = 3, 21

_SPACE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII."""
    return text.encode().translate(_SPACE).split()


def _keys(numbers: np.ndarray, places: np.ndarray, depth: int) -> list[np.ndarray]:
    """Words at ``places`` packed by ``_PER``, as many as ``depth`` words need."""
    padded = np.concatenate([numbers, np.zeros(depth + _PER, np.int64)])
    keys = []
    for start in range(0, depth, _PER):
        key = padded[places + start]
        for at in range(start + 1, start + _PER):
            key = (key << _BITS) | padded[places + at]
        keys.append(key)
    return keys


def _bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each target in its own slice [low, high) of ``values``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        seen = values[np.minimum(middle, len(values) - 1)]
        right = open_ & ((seen <= target) if after else (seen < target))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


class Benchmark:
    """Windows of a block of items, ready to be searched."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window, self.ids = window, sorted({name for name, _ in items})
        number = {name: at for at, name in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        numbers, starts, lengths, owners, at = [], [], [], [], 0
        for name, text in dict.fromkeys(items):
            words = words_of(text)
            if not words:
                continue
            length = min(window, len(words))
            numbers += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [0]
            count = len(words) - length + 1
            starts += range(at, at + count)
            lengths += [length] * count
            owners += [number[name]] * count
            at += len(words) + 1
        if len(self.vocabulary) >= 1 << _BITS:
            raise ValueError("too many different words in one block of the benchmark")
        self.starts, self.lengths = np.array(starts, np.int64), np.array(lengths, np.int64)
        self.owners = np.array(owners, np.int64)
        self.keys = _keys(np.array(numbers, np.int64), self.starts, window)
        # Shortest window that starts with each word.
        self.least = np.full(len(self.vocabulary) + 1, np.iinfo(np.int64).max)
        if len(self.starts):
            np.minimum.at(self.least, np.array(numbers, np.int64)[self.starts], self.lengths)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)

    def occurrences(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the shard, window) of every occurrence of a window in the shard."""
        none = np.zeros(0, np.int64)
        if not len(self.starts) or not len(numbers):
            return none, none
        ends = np.where(numbers == 0, np.arange(len(numbers)), len(numbers))
        left = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(numbers))
        places = np.flatnonzero(left >= self.least[numbers])
        if not len(places):
            return none, none
        keys = _keys(numbers, places, self.window)
        order = np.lexsort(keys[::-1])
        suffixes, keys = places[order], [k[order] for k in keys]
        low, high = np.zeros(len(self.starts), np.int64), np.full(len(self.starts), len(suffixes), np.int64)
        for at, (own, column) in enumerate(zip(self.keys, keys, strict=True)):
            known = np.clip(self.lengths - at * _PER, 0, _PER)
            shift = (_PER - known) * _BITS
            first = (own >> shift) << shift
            low, high = (
                _bisect(column, low, high, first, False),
                _bisect(column, low, high, first + (np.int64(1) << shift) - 1, True),
            )
        counts = high - low
        windows = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return suffixes[np.repeat(low, counts) + within], windows


def _matches(benchmark: Benchmark, documents: list[list[bytes]]) -> list[tuple[list, list, int]]:
    """Per document of a shard: merged spans of hit words, item ids, words of the longest match."""
    starts = np.cumsum([0, *(len(words) + 1 for words in documents)])
    numbers = np.zeros(starts[-1], np.int64)
    for start, words in zip(starts, documents, strict=False):
        numbers[start:start + len(words)] = benchmark.numbers(words)
    places, windows = benchmark.occurrences(numbers)
    found: list[tuple[list, list, int]] = [([], [], 0) for _ in documents]
    if not len(places):
        return found
    lengths = benchmark.lengths[windows]
    # Windows in a row of one item that meet words in a row are one longer match.
    line = places - benchmark.starts[windows]
    order = np.lexsort((places, line))
    joined = (np.diff(line[order]) == 0) & (np.diff(places[order]) == 1)
    edges = np.flatnonzero(np.concatenate([[True], ~joined, [True]]))
    first, last = places[order][edges[:-1]], (places + lengths)[order][edges[1:] - 1]
    longest = np.zeros(len(documents), np.int64)
    np.maximum.at(longest, np.searchsorted(starts, first, "right") - 1, last - first)
    # Spans of hit words.
    covered = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(covered, places, 1)
    np.add.at(covered, places + lengths, -1)
    hit = np.concatenate([[0], np.cumsum(covered) > 0]).astype(np.int8)
    change = np.flatnonzero(np.diff(hit))
    spans = change.reshape(-1, 2)
    for (low, high), owner in zip(spans.tolist(), (np.searchsorted(starts, spans[:, 0], "right") - 1).tolist(), strict=True):
        found[owner][0].append((low - int(starts[owner]), high - int(starts[owner])))
    pairs = np.unique(np.stack([np.searchsorted(starts, places, "right") - 1, benchmark.owners[windows]]), axis=1)
    for owner, item in pairs.T.tolist():
        found[owner][1].append(benchmark.ids[item])
    return [(spans, items, int(most)) for (spans, items, _), most in zip(found, longest, strict=True)]


def _united(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted([*old, *new]):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ADDED = {"n_words": pa.int64(), "hit_spans": _SPANS, "item_ids": pa.list_(pa.string()), "longest_match": pa.int32()}
_SCHEMA = "n_words long, hit_spans array<struct<start: int, end: int>>, item_ids array<string>, longest_match int"


def _searched(docs: DataFrame, text: str, items: list[tuple[str, str]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items, window))
    kept = [c for c in docs.columns if c not in _ADDED]
    carried = set(_ADDED) <= set(docs.columns)
    own = StructType([docs.schema[c] for c in kept]).simpleString()[7:-1]

    def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
        documents = [words_of(t or "") for t in batch.column(text).to_pylist()]
        found: list[tuple[list, list, int]] = []
        start = total = 0
        for at, words in enumerate(documents):
            if at > start and total + len(words) > SHARD_WORDS:
                found += _matches(shared.value, documents[start:at])
                start, total = at, 0
            total += len(words)
        found += _matches(shared.value, documents[start:])
        if carried:
            before = zip(*(batch.column(c).to_pylist() for c in ("hit_spans", "item_ids", "longest_match")), strict=True)
            found = [
                (_united([(s["start"], s["end"]) for s in old_spans], spans), sorted({*old_items, *items}), max(old, most))
                for (old_spans, old_items, old), (spans, items, most) in zip(before, found, strict=True)
            ]
        spans = [[{"start": low, "end": high} for low, high in f[0]] for f in found]
        values = [[len(d) for d in documents], spans, [f[1] for f in found], [f[2] for f in found]]
        arrays = [pa.array(v, kind) for v, kind in zip(values, _ADDED.values(), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], [*kept, *_ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        yield from map(shard, steps(batches, text, rows=10_000, size=STEP_BYTES))

    return docs.mapInArrow(run, ", ".join(x for x in (own, _SCHEMA) if x))


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with its verbatim matches with benchmark items.

    Added (columns of these names are replaced): n_words; hit_spans, the words inside any occurrence
    of a window, as merged spans of word positions; item_ids, the items with such windows, sorted;
    longest_match, the words of the longest verbatim match. A window is ``window`` consecutive words
    of an item, or the whole of a shorter item. Null texts have no words, null item ids count as
    empty; repeated rows of either table change nothing else.
    """
    kept = [c for c in docs.columns if c not in _ADDED or c == text]
    docs = docs.select(*[f"`{c}`" for c in kept])
    items = benchmark.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("words"),
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))

    def block(number: int) -> list[tuple[str, str]]:
        rows = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == number).distinct().collect()
        return sorted((r["item"], r["words"]) for r in rows)

    if blocks == 1:
        return _searched(docs, text, block(0), window)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(text)}"
    stored = written(plain.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    matched = ("hit_spans", "item_ids", "longest_match")
    before = None
    for number in range(blocks - 1):
        found = _searched(stored.select("_row", own), own, block(number), window).where(
            F.size("item_ids") > 0).select("_row", *matched)
        before = checkpointed((found if before is None else before.unionByName(found)).groupBy("_row").agg(
            F.flatten(F.collect_list("hit_spans")).alias("hit_spans"),
            F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
            F.max("longest_match").alias("longest_match")))
    kinds = dict(before.dtypes)
    empty = {c: F.coalesce(c, F.array().cast(kinds[c])) for c in matched[:2]}
    carried = stored.join(before, "_row", "left").drop("_row").withColumns(
        {**empty, "longest_match": F.coalesce("longest_match", F.lit(0)), "n_words": F.lit(0).cast("long")})
    found = _searched(carried, own, block(blocks - 1), window)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *_ADDED)


def n_hit(spans: str = "hit_spans"):
    """Column: how many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their columns as they were."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = find_matches(renamed, benchmark, names[text], window=window).where(F.size("item_ids") == 0)
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])
