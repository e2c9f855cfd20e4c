"""Scores of texts under a hierarchical Pitman-Yor model of words after words.

Every preceding word is a context, and so is the start of a text. Each word that makes up ``1 / CONTEXTS`` of the
training tokens or more has a restaurant of its own; those of all rarer ones, by a hash of the word, share
``CLASSES`` more. All share one parent restaurant without context, whose base is uniform over the vocabulary
and an unknown word. Seatings are drawn by Gibbs sampling: a sweep seats the customers of every restaurant and
word anew, given the tables of the sweep before (a blocked draw, not one customer at a time), and sends one
customer per table to the parent. Predictive probabilities are averaged over the last sweeps.

All customers of a word are in one part, keyed by a hash of the word, so the parent's seating is local and
only sums per restaurant travel: as many as there are restaurants, whatever the corpus. That is what bounds their
number; a larger one would mean sums that no longer fit into a broadcast. Documents are cut
into chunks; a chunk sends each part one message with its words, and gets the answers in the same order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperlens.llm.arrow import steps
from paperlens.llm.neardup import word_hashes
from paperlens.llm.store import opened
from paperlens.session import checkpointed

# Together with the start of texts no more than 2 ** 15, so a context is two bytes in a message.
CONTEXTS = 1 << 13
CLASSES = (1 << 15) - CONTEXTS - 2
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES = 16_000_000
PART_TOKENS = 2_000_000
# Customers of one word and context that are seated one by one; above, tables are drawn by the
# waiting time to the next one.
_ONE_BY_ONE = 256
_BLOCK = 4_096
_END, _START = np.uint64(1), np.uint64(2)


def _tokens(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the hashes of its words, then the end."""
    for words in word_hashes(column):
        yield np.append(words, _END)


@dataclass
class Sums:
    """What a sweep leaves behind: tables per context, customers and tables of the parent."""

    tables: np.ndarray
    parent_customers: float
    parent_tables: float


@dataclass
class Model:
    """Fixed figures of the corpus and the sums of each sweep so far."""

    contexts: int
    customers: np.ndarray
    tokens: int
    vocabulary: int
    discount: float
    parent_discount: float
    sums: list[Sums]


def table_counts(customers: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables that ``customers`` take in turn where a new one has ``weight`` against the seated less the discounts."""
    tables = np.minimum(customers, 1).astype(np.int64)
    active = np.flatnonzero(customers > 1)
    for seated in range(1, _ONE_BY_ONE):
        active = active[customers[active] > seated]
        if not len(active):
            return tables
        a = weight[active]
        tables[active] += random.random(len(active)) * (a + seated - discount * tables[active]) < a
    place = np.full(len(active), float(_ONE_BY_ONE))
    while len(active):
        a = weight[active]
        # P(no table until m) is about (place / m) ** a for so many customers.
        shift = discount * tables[active]
        with np.errstate(over="ignore", divide="ignore"):
            place = (place - shift) * random.random(len(active)) ** (-1 / np.maximum(a, 1e-12)) + shift + 1
        more = place <= customers[active]
        active, place = active[more], place[more]
        tables[active] += 1
    return tables


@dataclass
class Part:
    """Merged customers of one part: words, and per word and context their number. A context of the number of
    restaurants would be the parent itself."""

    number: int
    words: np.ndarray
    word: np.ndarray
    context: np.ndarray
    customers: np.ndarray

    def parent_probability(self, model: Model, sweep: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        sums, d = model.sums[sweep], model.parent_discount
        base = (STRENGTH + d * sums.parent_tables) / (model.vocabulary + 1)
        return (customers - d * tables + base) / (STRENGTH + sums.parent_customers)

    def unknown_probability(self, model: Model, sweep: int) -> float:
        return float(self.parent_probability(model, sweep, np.zeros(1), np.zeros(1))[0])

    def parent_customers(self, tables: np.ndarray, contexts: int) -> np.ndarray:
        sent = np.where(self.context == contexts, self.customers, tables)
        return np.bincount(self.word, sent, len(self.words))

    def start(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One table for every word in a restaurant."""
        tables = np.minimum(self.customers, 1)
        parent = self.parent_customers(tables, model.contexts)
        return tables, parent, np.minimum(parent, 1)

    def draw(self, model: Model, sweep: int, parent: np.ndarray, parent_tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tables, and the parent's customers and tables, drawn given those of the parent before and the sums of
        ``sweep``. Every sweep is drawn from a seed of its own, so it comes out equal whenever it is drawn again."""
        sums, own = model.sums[sweep], self.context < model.contexts
        random = np.random.default_rng([11, self.number, sweep])
        probability = self.parent_probability(model, sweep, parent, parent_tables)
        weight = (STRENGTH + model.discount * sums.tables[self.context[own]]) * probability[self.word[own]]
        tables = np.zeros_like(self.customers)
        tables[own] = table_counts(self.customers[own], weight, model.discount, random)
        parent = self.parent_customers(tables, model.contexts)
        weight = np.full(len(parent), (STRENGTH + model.parent_discount * sums.parent_tables) / (model.vocabulary + 1))
        return tables, parent, table_counts(parent, weight, model.parent_discount, random)

    def sweeps(self, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per sweep the tables, and the parent's customers and tables; one more than ``model`` has sums for."""
        state = self.start(model)
        yield state
        for sweep in range(len(model.sums)):
            state = self.draw(model, sweep, *state[1:])
            yield state


class Seats:
    """The parent's customers and tables of a part after a sweep, in a file of the shared folder, so that the next
    sweep need not draw all before it again. Without the file, it does: the draws are the same."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def make(self) -> "Seats":
        system, path = opened(self.folder)
        system.create_dir(path, recursive=True)
        return self

    def _file(self, number: int, sweep: int):
        system, path = opened(self.folder)
        return system, f"{path}/part-{number}-{sweep}"

    def put(self, number: int, sweep: int, parent: np.ndarray, parent_tables: np.ndarray) -> None:
        system, path = self._file(number, sweep)
        first = _packed(parent)
        with system.open_output_stream(path, compression=None) as file:
            file.write(len(first).to_bytes(8, "little") + first + _packed(parent_tables))

    def after(self, part: Part, model: Model, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """The state after the sweep of that number; 0 is the start."""
        if sweep == 0:
            return part.start(model)[1:]
        system, path = self._file(part.number, sweep)
        try:
            with system.open_input_file(path) as file:
                data = file.read()
        except FileNotFoundError:
            return part.draw(model, sweep - 1, *self.after(part, model, sweep - 1))[1:]
        size = int.from_bytes(data[:8], "little")
        return _unpacked(data[8:8 + size]), _unpacked(data[8 + size:])


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, compressed; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if values.max(initial=0) < 1 << (8 * w - 1) or w == 8)
    return bytes([width]) + zlib.compress(values.astype(f"<u{width}").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def _places(values: np.ndarray) -> bytes:
    """Places in a chunk's list of entries, three bytes each."""
    wide = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    if len(wide) and wide[:, 3].any():
        raise ValueError("more entries in a chunk than three bytes can number")
    return wide[:, :3].tobytes()


def _placed(data: bytes) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return np.concatenate([narrow, np.zeros((len(narrow), 1), np.uint8)], axis=1).reshape(-1).view("<u4")


_MESSAGE = {"chunk": pa.string(), "part": pa.int32(), "words": pa.binary(), "entries": pa.binary(),
            "contexts": pa.binary(), "counts": pa.binary()}
_MESSAGE_SCHEMA = "chunk string, part int, words binary, entries binary, contexts binary, counts binary"


def _chunks(docs: DataFrame, id_type: pa.DataType, contexts: np.ndarray, parts: int) -> DataFrame:
    """Per chunk its documents, as places in the chunk's list of entries, and its messages.

    An entry is a word and a context that occur in the chunk; entries are sorted by word.
    """
    spark_id = docs.schema["_id"].dataType.simpleString()
    columns = {"id": id_type, "held_out": pa.bool_(), "tokens": pa.binary(), **_MESSAGE}
    ordered = np.sort(contexts)
    rank = np.argsort(contexts)
    restaurants = len(contexts) + CLASSES

    def context_of(words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ordered, words), len(ordered) - 1)
        # Other bits of the hash than those that choose a part.
        shared = len(contexts) + ((words & np.uint64(0xFFFFFFFF)) * np.uint64(CLASSES) >> np.uint64(32)).astype(np.int64)
        return np.where(ordered[at] == words, rank[at], shared)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], kind) for n, kind in columns.items()], list(columns))

    def emitted(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        chunk = uuid.uuid4().hex
        lengths = [len(t) for _, _, t in held]
        tokens = np.concatenate([t for _, _, t in held])
        before = np.concatenate([np.concatenate([[_START], t[:-1]]) for _, _, t in held])
        train = np.repeat([not out for _, out, _ in held], lengths)
        words, word = np.unique(tokens, return_inverse=True)
        keys, entry = np.unique(word * (restaurants + 1) + context_of(before), return_inverse=True)
        counts = np.bincount(entry, train, len(keys)).astype(np.int64)
        of_word, context = np.divmod(keys, restaurants + 1)
        per_word = np.bincount(of_word, minlength=len(words))
        part = ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        rows, size, at = [], 0, 0
        for (number, out, own) in held:
            rows.append({"id": number, "held_out": out, "chunk": chunk, "tokens": _places(entry[at:at + len(own)])})
            at += len(own)
            size += len(own)
            if size > 2_000_000:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)
        edges = np.searchsorted(part, np.arange(parts + 1))
        entry_edges = np.concatenate([[0], np.cumsum(per_word)])[edges]
        rows = []
        for p in np.flatnonzero(np.diff(edges)):
            low, high, first, last = edges[p], edges[p + 1], entry_edges[p], entry_edges[p + 1]
            rows.append({"chunk": chunk, "part": int(p), "words": words[low:high].astype("<u8").tobytes(),
                         "entries": _packed(per_word[low:high]), "contexts": _packed(context[first:last]),
                         "counts": _packed(counts[first:last])})
        yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held, size = [], 0
        for batch in steps(batches, "text"):
            numbers, outs = batch.column("_id").to_pylist(), batch.column("held_out").to_pylist()
            for number, out, own in zip(numbers, outs, _tokens(batch.column("text")), strict=True):
                held.append((number, out, own))
                size += 6 * len(own)
                if size > CHUNK_BYTES:
                    yield from emitted(held)
                    held, size = [], 0
        if held:
            yield from emitted(held)

    return docs.mapInArrow(run, f"id {spark_id}, held_out boolean, tokens binary, {_MESSAGE_SCHEMA}")


def _messages_of(batch_rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[str, int, int]]]:
    """All words and entries of a part's messages, one after the other, and where each chunk's entries are."""
    words, word, contexts, counts, places, at, first = [], [], [], [], [], 0, 0
    for row in batch_rows:
        own = np.frombuffer(row["words"], "<u8")
        words.append(own)
        word.append(np.repeat(np.arange(at, at + len(own)), _unpacked(row["entries"])))
        contexts.append(_unpacked(row["contexts"]))
        counts.append(_unpacked(row["counts"]))
        places.append((row["chunk"], first, first + len(contexts[-1])))
        at, first = at + len(own), first + len(contexts[-1])
    return np.concatenate(words), np.concatenate(word), np.concatenate(contexts), np.concatenate(counts), places


def _merged(number: int, rows: list[dict], contexts: int) -> tuple[Part, np.ndarray, np.ndarray, list[tuple[str, int, int]]]:
    """The part, and per entry of the messages the word and the merged entry it belongs to."""
    words, word, context, counts, places = _messages_of(rows)
    different, of = np.unique(words, return_inverse=True)
    keys, entry = np.unique(of[word] * (contexts + 1) + context, return_inverse=True)
    total = np.bincount(entry, counts, len(keys)).astype(np.int64)
    of_key, of_context = np.divmod(keys, contexts + 1)
    return Part(number, different, of_key, of_context, total), of[word], entry, places


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each part; they stand together."""
    number, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != number and rows:
                yield number, rows
                rows = []
            number = row["part"]
            rows.append(row)
    if rows:
        yield number, rows


def _summed(messages: DataFrame, vector_of: Callable[[int, list[dict]], np.ndarray], length: int) -> np.ndarray:
    """Sum over all parts of one vector of whole numbers per part."""
    blocks = -(-length // _BLOCK)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks * _BLOCK)
        for number, rows in _by_part(batches):
            total[:length] += vector_of(number, rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(blocks), pa.int32()), pa.array([_packed(b.astype(np.int64)) for b in np.split(total, blocks)], pa.binary())],
            ["block", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BLOCK)
        for batch in batches:
            for sums in batch.column("sums").to_pylist():
                total += _unpacked(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([_packed(total.astype(np.int64))], pa.binary())], ["block", "sums"])

    schema = "block int, sums binary"
    rows = messages.mapInArrow(each, schema).groupBy("block").applyInArrow(add, schema).collect()
    found = {r["block"]: _unpacked(r["sums"]) for r in rows}
    return np.concatenate([found.get(b, np.zeros(_BLOCK)) for b in range(blocks)])[:length].astype(float)


def _contexts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Words that are contexts, and the number of training tokens, exact.

    A word with its share of all tokens has that share in some stretch of them, so the words that have it in
    a stretch are candidates and are then counted everywhere.
    """
    train = docs.where("not held_out").select("text")

    def counted(wanted: np.ndarray | None) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute  # noqa: F401

            held, size = [], 0

            def flushed() -> pa.RecordBatch:
                words, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
                some = counts * CONTEXTS >= size if wanted is None else np.isin(words, wanted)
                return pa.RecordBatch.from_arrays([
                    pa.array([*words[some].view(np.int64).tolist(), None], pa.int64()),
                    pa.array([*counts[some].tolist(), size], pa.int64())], ["word", "n"])

            for batch in steps(batches, "text"):
                for tokens in _tokens(batch.column("text")):
                    held.append(tokens)
                    size += len(tokens)
                    if size > PART_TOKENS:
                        yield flushed()
                        held, size = [], 0
            yield flushed()

        return run

    schema = "word long, n long"
    first = train.mapInArrow(counted(None), schema).where("word is not null").select("word").distinct().collect()
    wanted = np.array([r["word"] for r in first], np.int64).view(np.uint64)
    sums = train.mapInArrow(counted(wanted), schema).groupBy("word").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in sums if r["word"] is None)
    words = sorted(r["word"] for r in sums if r["word"] is not None and r["n"] * CONTEXTS >= total)
    return np.append(np.array(words, np.int64).view(np.uint64), _START), total


def _fitted(messages: DataFrame, k: int, seats: Seats) -> Model:
    """The seating's sums of every sweep in ``k`` restaurants, and discounts from the numbers of words seen once and twice."""

    def first(number: int, rows: list[dict]) -> np.ndarray:
        part, *_ = _merged(number, rows, k)
        own = part.context < k
        by_context = np.bincount(part.context, part.customers, k + 1)[:k]
        types = np.bincount(part.context[own & (part.customers > 0)], minlength=k + 1)[:k]
        parent = part.parent_customers(np.minimum(part.customers, 1), k)
        seen = np.bincount(part.word, part.customers, len(part.words))
        return np.concatenate([by_context, types, [
            seen.sum(), (seen > 0).sum(), (part.customers[own] == 1).sum(), (part.customers[own] == 2).sum(),
            (parent == 1).sum(), (parent == 2).sum(), parent.sum()]])

    found = _summed(messages, first, 2 * k + 7)
    tokens, vocabulary, once, twice, parent_once, parent_twice, parent = found[2 * k:]

    def discount(n1: float, n2: float) -> float:
        return float(min(0.95, max(0.05, n1 / max(1.0, n1 + 2 * n2))))

    model = Model(k, found[:k], int(tokens), int(vocabulary), discount(once, twice),
                  discount(parent_once, parent_twice), [Sums(found[k:2 * k], parent, vocabulary)])

    for _ in range(BURN_IN + SAMPLES):
        shared = messages.sparkSession.sparkContext.broadcast(model)

        def swept(number: int, rows: list[dict], shared=shared) -> np.ndarray:
            part, model = _merged(number, rows, k)[0], shared.value
            sweep = len(model.sums) - 1
            tables, customers, parent_tables = part.draw(model, sweep, *seats.after(part, model, sweep))
            seats.put(number, sweep + 1, customers, parent_tables)
            own = part.context < k
            return np.concatenate([
                np.bincount(part.context[own], tables[own], k)[:k], [customers.sum(), parent_tables.sum()]])

        found = _summed(messages, swept, k + 2)
        model = Model(**{**model.__dict__, "sums": [*model.sums, Sums(found[:k], found[k], found[k + 1])]})
    return model


def _answers(messages: DataFrame, model: Model, seats: Seats) -> DataFrame:
    """(chunk, part, counts, scores): for the entries of each message the word's count and log10 probability."""
    shared = messages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _by_part(batches):
            model = shared.value
            k = model.contexts
            part, word, entry, places = _merged(number, rows, k)
            known = np.bincount(part.word, part.customers, len(part.words))
            own = part.context < k
            total = np.zeros(len(part.word))
            for sweep in range(BURN_IN + 1, len(model.sums)):
                tables, parent, parent_tables = part.draw(model, sweep - 1, *seats.after(part, model, sweep - 1))
                probability = part.parent_probability(model, sweep, parent, parent_tables)[part.word]
                context, d = part.context[own], model.discount
                probability[own] = (
                    part.customers[own] - d * tables[own]
                    + (STRENGTH + d * model.sums[sweep].tables[context]) * probability[own]
                ) / (STRENGTH + model.customers[context])
                total += probability
            score = np.log10(total / SAMPLES).astype("<f4")
            counts, scores = known[word].astype(np.int64), score[entry]
            yield pa.RecordBatch.from_arrays([
                pa.array([c for c, _, _ in places], pa.string()), pa.array([number] * len(places), pa.int32()),
                pa.array([_packed(counts[a:b]) for _, a, b in places], pa.binary()),
                pa.array([scores[a:b].tobytes() for _, a, b in places], pa.binary())],
                ["chunk", "part", "counts", "scores"])

    return messages.mapInArrow(run, "chunk string, part int, counts binary, scores binary")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    The model learns from the rows whose crc32 of the key as text, modulo ``FOLDS``, is not ``HELD_OUT``
    (a null key counts as empty text). Words end at ASCII white space, A-Z are lowered, and each text has
    an end token, also an empty or null one. base_score is that of add-one unigrams. Repeated
    rows are scored, and learnt from, one by one. Without any training row all words are unknown.
    """
    names = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("text"),
        (F.pmod(F.crc32(names.cast("binary")), F.lit(FOLDS)) == HELD_OUT).alias("held_out"),
    )
    contexts, tokens = _contexts(rows)
    parts = max(8, -(-tokens // PART_TOKENS))
    id_type = _arrow_type(rows)
    chunks = checkpointed(_chunks(rows, id_type, contexts, parts))
    messages = checkpointed(
        chunks.where("part is not null").select(*_MESSAGE)
        .repartitionById(parts, F.col("part")).sortWithinPartitions("part", "chunk"))
    seats = Seats(f"{docs.sparkSession.sparkContext.getCheckpointDir()}/seats-{uuid.uuid4().hex}").make()
    model = _fitted(messages, len(contexts) + CLASSES, seats)
    answers = _answers(messages, model, seats)
    train_tokens, vocabulary = model.tokens, model.vocabulary
    columns = {"id": id_type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
               "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def finish(documents: pa.Table, replies: pa.Table) -> pa.Table:
        """The documents of one chunk with the answers of all parts, which stand in the order of its entries."""
        received = sorted(replies.to_pylist(), key=lambda r: r["part"])
        out = []
        if received:
            counts = np.concatenate([_unpacked(r["counts"]) for r in received])
            scores = np.concatenate([np.frombuffer(r["scores"], "<f4") for r in received]).astype(np.float64)
            base = np.log10((counts + 1) / (train_tokens + vocabulary + 1))
        for data in documents.column("tokens").to_pylist():
            entries = _placed(data)
            out.append((len(entries), int((counts[entries] > 0).sum()), train_tokens,
                        float(base[entries].sum()), float(scores[entries].sum())))
        made = [pa.array([r[at] for r in out], kind) for at, kind in enumerate(list(columns.values())[2:])]
        given = [documents.column(c).combine_chunks() for c in ("id", "held_out")]
        return pa.Table.from_arrays([*given, *made], list(columns))

    spark_id = rows.schema["_id"].dataType.simpleString()
    scored = (
        chunks.where("part is null").select("chunk", "id", "held_out", "tokens").groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(finish, f"id {spark_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                              "base_score double, score double")
    )
    return scored.withColumnRenamed("id", key)


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["_id"].dataType)
