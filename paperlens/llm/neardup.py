"""Near duplicates: improved consistent weighted sampling of TF-IDF shingles, banded and verified.

1. Shingles of five words are counted over all documents. Only frequent ones have an idf below the
   ceiling; they are found exactly from counts of hashed buckets and one exact count of what lies in full buckets.
2. Each text draws ``BANDS * ROWS`` consistent weighted samples; texts that agree in a whole band meet.
   Two texts of similarity s meet with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9993 at 0.8.
3. Texts that meet, directly or through others, are a family. A family is verified in blocks: every two
   blocks meet in a group, all weighted Jaccard similarities between them are taken by matrix product, and links of
   a spanning forest are passed on. So all links inside a family count, and no pair rows exist.
4. Components of these links are the classes. Equal texts are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperlens.llm.arrow import map_texts, steps
from paperlens.llm.graph import components
from paperlens.operators.frames import broadcast_if_small
from paperlens.session import checkpointed

SHINGLE = 5
BANDS, ROWS = 24, 6
# A link needs this similarity, as a fraction of whole numbers.
NEAR = (4, 5)
# Shingles are frequent if they make up this share of all shingles of documents; so there are at most 2 ** 19.
_FREQUENT = 1 << 19
_BUCKETS = 1 << 20
# Weights are whole numbers: tf times an idf from UNIT (in every document) to CEILING (not frequent).
UNIT, CEILING = 64, 96
# Texts and shingles of a block.
BLOCK_TEXTS, BLOCK_SHINGLES = 1_000, 1_000_000
_TABLE_BITS = 14
# Bytes of texts that are hashed together, and shingles that are sampled together.
_HASHED_BYTES, _SAMPLED_SHINGLES = 1_000_000, 65_536
_MIX = np.uint64(0x9E3779B97F4A7C15)

_random = np.random.default_rng(5)
_BYTE = _random.integers(0, 1 << 64, 256, np.uint64)
_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _BYTE[list(b"abcdefghijklmnopqrstuvwxyz")]
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(b" \t\n\v\f\r")] = False
_BYTE[~_IS_WORD] = 0
_PLACE = _random.integers(0, 1 << 63, 4_096, np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _random.integers(0, 1 << 63, SHINGLE + 1, np.uint64) * np.uint64(2) + np.uint64(1)

Shingles = tuple[np.ndarray, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts between the borders in ``data``, and the borders among them."""
    inside = _IS_WORD[data]
    starting = inside.copy()
    starting[1:] &= ~inside[:-1]
    first = borders[:-1][borders[:-1] < len(data)]
    starting[first] = inside[first]
    starts = np.flatnonzero(starting)
    words = np.zeros(0, np.uint64)
    if len(starts):
        lengths = np.diff(np.append(starts, len(data)))
        place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
        words = _mixed(np.add.reduceat(_BYTE[data[starts[0]:]] * _PLACE[place & 4_095], starts - starts[0]))
    return words, np.searchsorted(starts, borders)


def _hashed(words: np.ndarray, edges: np.ndarray) -> Iterator[Shingles]:
    """Shingles of the texts between the edges in ``words``, all hashed together."""
    runs = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for at in range(SHINGLE if len(runs) else 0):
        runs += words[at:at + len(runs)] * _ORDER[at]
    runs = _mixed(runs)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if high - low >= SHINGLE:
            yield np.unique(runs[low:high - SHINGLE + 1], return_counts=True)
        elif high > low:
            whole = (words[low:high] * _ORDER[:high - low]).sum(dtype=np.uint64, keepdims=True)
            yield _mixed(whole + _ORDER[SHINGLE] * np.uint64(high - low)), np.ones(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _in_steps(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(borders, borders[at] + _HASHED_BYTES, "right")) - 1)
        yield _words(data[borders[at]:borders[end]], borders[at:end + 1] - borders[at])
        at = end


def word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the 64-bit hashes of its words, lower-cased (A-Z); words end at ASCII white space."""
    for words, edges in _in_steps(column):
        yield from np.split(words, edges[1:-1])


def shingles(column: pa.Array) -> Iterator[Shingles]:
    """Per text the hashes of its different shingles, sorted, and how often each occurs.

    Words are lower-cased (A-Z) and end at ASCII white space; a text of fewer than five is one shingle.
    """
    for words, edges in _in_steps(column):
        yield from _hashed(words, edges)


@dataclass
class Weights:
    """idf of the frequent shingles; all others have the ceiling."""

    hashes: np.ndarray
    idf: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), CEILING, np.int64)
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            same = self.hashes[at] == hashes
            found[same] = self.idf[at[same]]
        return found


def weights_of(docs: DataFrame, text: str) -> Weights:
    """Document frequencies over all documents, exact for every frequent shingle."""
    docs = docs.select(text)
    parts = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        sums, rows, held = np.zeros(_BUCKETS, np.int64), 0, []
        for batch in steps(batches, text):
            for hashes, _ in shingles(batch.column(text)):
                rows += 1
                held.append(_bucket(hashes))
            sums += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=_BUCKETS)
            held = []
        if rows:
            for part, piece in enumerate(np.split(sums, parts)):
                small = piece.astype("<u2") if piece.max() < 1 << 16 else piece.astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([rows if part == 0 else 0], pa.int64()),
                     pa.array([small.tobytes()], pa.binary())], ["part", "n_rows", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(_BUCKETS // parts, np.int64), 0
        for batch in batches:
            rows += sum(batch.column("n_rows").to_pylist())
            for sums in batch.column("sums").to_pylist():
                total += np.frombuffer(sums, "<u2" if len(sums) == 2 * len(total) else "<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([rows], pa.int64()),
             pa.array([total.astype("<i8").tobytes()], pa.binary())], ["part", "n_rows", "sums"])

    schema = "part int, n_rows long, sums binary"
    # 64 rows of fixed size, whatever the corpus.
    found = docs.mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect()
    n_rows = sum(r["n_rows"] for r in found)
    none = Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not found:
        return none
    loads = np.concatenate([np.frombuffer(r["sums"], "<i8") for r in sorted(found, key=lambda r: r["part"])])
    least = max(2, int(loads.sum()) // _FREQUENT)
    full = docs.sparkSession.sparkContext.broadcast(np.packbits(loads >= least).tobytes())

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        in_full = np.unpackbits(np.frombuffer(full.value, np.uint8)).astype(bool)
        held: list[np.ndarray] = []
        for batch in steps(batches, text):
            for hashes, _ in shingles(batch.column(text)):
                held.append(hashes[in_full[_bucket(hashes)]])
            if sum(map(len, held)) > 2_000_000:
                yield _counted(held)
                held = []
        yield _counted(held)

    frequent = docs.mapInArrow(candidates, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rows = frequent.where(F.col("n") >= least).toPandas()
    if not len(rows):
        return none
    hashes = rows["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    share = np.log(rows["n"].to_numpy(float)[order] / least) / max(1e-9, np.log(max(n_rows, least + 1) / least))
    idf = UNIT + np.rint((CEILING - UNIT) * (1 - np.minimum(share, 1))).astype(np.int64)
    return Weights(hashes[order], idf)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["hash", "n"])


class Sampler:
    """Consistent weighted samples: the same random numbers for a shingle in every text.

    The numbers of sample k are read from a table at a hash of the shingle, so they depend on
    nothing but k and the shingle. Equal values are decided by the smaller hash.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 20) -> None:
        random = np.random.default_rng(seed)
        shape = (samples, 1 << _TABLE_BITS)
        self.r = random.gamma(2.0, 1.0, shape).astype(np.float32)
        self.log_c = np.log(random.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = random.random(shape, np.float32)
        self.factors = random.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        # What most shingles have: no frequent one, and once in the text.
        usual = np.log(np.float32(CEILING))
        self.usual = np.stack([self._drawn(self.r[k], self.log_c[k], self.beta[k], usual) for k in range(samples)])

    @staticmethod
    def _drawn(r: np.ndarray, log_c: np.ndarray, beta: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
        """ln a of improved consistent weighted sampling, as sortable numbers in the upper 32 bits."""
        t = np.floor(log_weight / r + beta)
        bits = (log_c - r * (t - beta) - r).view(np.uint32)
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        return ordered.astype(np.uint64) << np.uint64(32)

    def bands(self, texts: list[Shingles], weights: Weights) -> np.ndarray:
        """(text, band): one hash per band of the samples of each text; no text may be empty."""
        hashes = np.concatenate([h for h, _ in texts])
        weight = weights.of(hashes) * np.concatenate([n for _, n in texts])
        starts = np.cumsum([0, *(len(h) for h, _ in texts)])[:-1]
        log_weight = np.log(weight.astype(np.float32))
        other = np.flatnonzero(weight != CEILING)
        place = np.arange(len(hashes), dtype=np.uint64)
        out = np.zeros((len(texts), BANDS), np.uint64)
        for k, factor in enumerate(self.factors):
            at = ((hashes * factor) >> np.uint64(64 - _TABLE_BITS)).astype(np.intp)
            value = self.usual[k].take(at)
            if len(other):
                there = at[other]
                value[other] = self._drawn(
                    self.r[k].take(there), self.log_c[k].take(there), self.beta[k].take(there), log_weight[other])
            value |= place
            chosen = (np.minimum.reduceat(value, starts) & np.uint64(0xFFFFFFFF)).astype(np.intp)
            there = at[chosen]
            t = np.floor(log_weight[chosen] / self.r[k][there] + self.beta[k][there]).astype(np.int64)
            band = k // ROWS
            out[:, band] = _mixed(out[:, band] * _MIX + _mixed(hashes[chosen] + t.astype(np.uint64) * _MIX) + np.uint64(k))
        return out


_samplers: dict[int, Sampler] = {}


def _sampler() -> Sampler:
    if not _samplers:
        _samplers[0] = Sampler()
    return _samplers[0]


def text_key(text: Column) -> Column:
    """Identity of a text: 128 bits of a digest; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _features(own: Shingles, weights: Weights) -> tuple[bytes, bytes]:
    """Shingles by occurrence, as hashes and their weights: their weighted overlap is that of tf times idf."""
    hashes, counts = own
    idf = weights.of(hashes)
    every = np.repeat(hashes, counts)
    number = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
    again = number > 0
    every[again] = _mixed(every[again] + number[again].astype(np.uint64) * _MIX)
    return every.astype("<u8").tobytes(), np.repeat(idf, counts).astype(np.uint8).tobytes()


def near_matrix(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each two texts, given as features and weights, whether their weighted Jaccard similarity is near."""
    texts = [*left, *right]
    owners = np.repeat(np.arange(len(texts)), [len(f) for f, _ in texts])
    values, first, column, counts = np.unique(
        np.concatenate([f for f, _ in texts]), return_index=True, return_inverse=True, return_counts=True)
    weight = np.concatenate([w for _, w in texts])[first].astype(np.float64)
    shared = np.flatnonzero(counts > 1)
    rank = np.full(len(values), -1)
    rank[shared] = np.arange(len(shared))
    places = rank[column]
    owners, places = owners[places >= 0], places[places >= 0]
    order = np.argsort(places, kind="stable")
    owners, places = owners[order], places[order]
    total = np.array([int(w.sum(dtype=np.int64)) for _, w in texts])
    # Whole numbers below 2 ** 24 are exact in single precision.
    kind = np.float32 if total.max(initial=0) < 1 << 23 else np.float64
    common = np.zeros((len(left), len(right)), kind)
    width = max(1, 8_000_000 // max(1, len(texts)))
    for start in range(0, len(shared), width):
        low, high = np.searchsorted(places, [start, start + width])
        matrix = np.zeros((len(texts), min(width, len(shared) - start)), kind)
        matrix[owners[low:high], places[low:high] - start] = 1
        common += (matrix[:len(left)] * weight[shared[start:start + width]].astype(kind)) @ matrix[len(left):].T
    sums = total[:len(left), None] + total[None, len(left):]
    share, whole = NEAR
    return common.astype(np.int64) * (whole + share) >= share * sums


def forest(near: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links (row, column) of a spanning forest of a matrix of links; ``same``: rows and columns are the same texts."""
    n_rows, n_columns = near.shape
    links, row_seen, column_seen = [], np.zeros(n_rows, bool), np.zeros(n_columns, bool)
    for start in range(n_rows):
        if row_seen[start]:
            continue
        row_seen[start] = True
        if same:
            column_seen[start] = True
        waiting = [(True, start)]
        while waiting:
            is_row, at = waiting.pop()
            if is_row:
                new = np.flatnonzero(near[at] & ~column_seen)
                column_seen[new] = True
                links += [(at, int(c)) for c in new]
                if same:
                    row_seen[new] = True
                waiting += [(same, int(c)) for c in new]
            else:
                new = np.flatnonzero(near[:, at] & ~row_seen)
                row_seen[new] = True
                links += [(int(r), at) for r in new]
                waiting += [(True, int(r)) for r in new]
    return links


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group of rows; the rows of a group stand together."""
    group, rows, links = None, [], []

    def close() -> None:
        sides: tuple[list, list] = ([], [])
        for right, key, features, weights in rows:
            sides[right].append((key, np.frombuffer(features, "<u8"), np.frombuffer(weights, np.uint8)))
        left, right = sides[0], sides[1] or sides[0]
        if not left or (not sides[1] and len(left) < 2):
            return
        near = near_matrix([x[1:] for x in left], [x[1:] for x in right])
        links.extend((left[a][0], right[b][0]) for a, b in forest(near, not sides[1]))

    names = ("family", "i", "j", "side", "key", "features", "weights")
    for batch in batches:
        for family, i, j, *row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if (family, i, j) != group:
                close()
                group, rows = (family, i, j), []
            rows.append(row)
        if len(links) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links, strict=True)], ["a", "b"])
            links.clear()
    close()
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links, strict=True)], ["a", "b"])


def _families(texts: DataFrame) -> DataFrame:
    """(key, family) of the texts that meet another in a band."""
    met = texts.select("key", F.explode("bands").alias("bucket"))
    leaders = met.groupBy("bucket").agg(F.min("key").alias("leader"), F.max("key").alias("last")).where("leader <> last")
    stars = met.join(broadcast_if_small(leaders.select("bucket", "leader")), "bucket").where("key <> leader")
    return components(stars, "key", "leader").select(F.col("node").alias("key"), F.col("root").alias("family"))


def _links(docs: DataFrame, text: str, families: DataFrame, weights: Weights) -> DataFrame:
    """(a, b) keys of near texts of one family: a spanning forest per two blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(texts: pa.Array) -> list[list]:
        pairs = [_features(own, shared.value) for own in shingles(texts)]
        return [[f for f, _ in pairs], [w for _, w in pairs]]

    whole = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("_text"))
    wanted = whole.join(broadcast_if_small(families), "key").dropDuplicates(["key"])
    features = checkpointed(map_texts(
        wanted, "_text", {"features": pa.binary(), "weights": pa.binary()}, "features binary, weights binary", work, raw=True))
    sizes = features.groupBy("family").agg(F.greatest(
        F.ceil(F.count("*") / F.lit(BLOCK_TEXTS)), F.ceil(F.sum(F.octet_length("weights")) / F.lit(BLOCK_SHINGLES)),
    ).cast("int").alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = (
        features.join(broadcast_if_small(sizes), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                (F.col("block") > F.col("other")).cast("int").alias("side"), "key", "features", "weights")
    )
    grouped = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return checkpointed(grouped.mapInArrow(_verified, "a binary, b binary"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, text_key, class_id) for every row of ``docs``; see ``_classes``.

    class_id names a class as well as the keys do: where keys are null or repeat, different classes can
    have one class_id.
    """
    return _classes(docs, key, text).select(F.col("_id").alias(key), "text_key", "class_id")


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, text_key, root, words, class_id) for every row of ``docs``; root tells classes of texts with words apart.

    Two texts are linked if their weighted Jaccard similarity over TF-IDF shingles is 0.8 or more, and a
    class is all that links connect; class_id is its smallest ``key``. Rows of equal text share a class. Texts without
    words, null ones included, are classes of their own, row by row. A null ``key`` counts only
    where its class has no other. Repeated rows are kept; other columns of ``docs`` do not matter.
    """
    docs = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    weights = weights_of(docs, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(texts: pa.Array) -> list[list]:
        found: list = [None] * len(texts)
        places, held, size = [], [], 0

        def sampled() -> None:
            for at, bands in zip(places, _sampler().bands(held, shared.value).view(np.int64), strict=True):
                found[at] = bands

        for at, own in enumerate(shingles(texts)):
            if not len(own[0]):
                continue
            if held and size + len(own[0]) > _SAMPLED_SHINGLES:
                sampled()
                places, held, size = [], [], 0
            places.append(at)
            held.append(own)
            size += len(own[0])
        if held:
            sampled()
        return [found]

    rows = checkpointed(map_texts(
        docs.withColumn("key", text_key(F.col("_text"))), "_text",
        {"bands": pa.list_(pa.int64())}, "bands array<long>", work, raw=True))
    families = checkpointed(_families(rows.where("bands is not null").dropDuplicates(["key"])))
    roots = components(_links(docs, "_text", families, weights), "a", "b")
    named = (
        rows.select("_id", "key", F.col("bands").isNotNull().alias("_words"))
        .join(broadcast_if_small(roots.withColumnRenamed("node", "key")), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    named = checkpointed(named)
    several = (
        named.where("_words").groupBy("root").agg(F.min("_id").alias("class_id"), F.count("*").alias("_n"))
        .where("_n > 1").drop("_n")
    )
    return named.join(broadcast_if_small(several), "root", "left").select(
        "_id", F.col("key").alias("text_key"), "root", F.col("_words").alias("words"),
        F.when(F.col("_words"), F.coalesce("class_id", "_id")).otherwise(F.col("_id")).alias("class_id"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest ``key``, null last, then the smallest text digest.

    Rows of a class that agree in key and text are one document. Texts without words all stay.
    """
    rows = _classes(docs, key, text).where("words")
    rank = F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col("text_key").alias("text_key"))
    rows = checkpointed(rows.groupBy("_id", "text_key", "root").agg(F.count("*").alias("_n")))
    first = rows.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("_m")).where("_m > 1")
    chosen = rows.join(broadcast_if_small(first.select("root", "first")), "root")
    losers = chosen.where((~F.col("_id").eqNullSafe(F.col("first.id"))) | (F.col("text_key") != F.col("first.text_key")))
    names = docs.columns
    own = docs.withColumn("_text_key", text_key(F.col(f"`{text}`"))).withColumn("_key", F.col(f"`{key}`"))
    losers = broadcast_if_small(losers.select(F.col("_id").alias("_lost"), F.col("text_key").alias("_lost_key")))
    same = (F.col("_text_key") == F.col("_lost_key")) & F.col("_key").eqNullSafe(F.col("_lost"))
    kept = own.join(losers, same, "left_anti")
    again = rows.where("_n > 1").select(F.col("_id").alias("_twice"), F.col("text_key").alias("_twice_key"))
    same = (F.col("_text_key") == F.col("_twice_key")) & F.col("_key").eqNullSafe(F.col("_twice"))
    again = broadcast_if_small(again)
    once = kept.join(again, same, "left_anti").unionByName(
        kept.join(again, same, "left_semi").dropDuplicates(["_key", "_text_key"]))
    return once.select(*[f"`{c}`" for c in names])
