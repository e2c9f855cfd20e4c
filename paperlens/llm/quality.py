"""Quality rules by distribution divergence from language references.

A document's shares of character classes and of common words are compared with references of
its table's languages by Jensen-Shannon distance (square root of the divergence in bits). The
references are computed from all documents: per language the median share of each class over
distinct documents, and the shares of its common words over documents that pass the class rule.
Every language with enough documents has a reference. Those of languages with a share of all documents hold
for the documents of every such language, those of rarer ones only for their own. Of a document whose language has no
reference only the shares of letters of whatever script, punctuation, symbols and other characters are compared. Without any language that is frequent, all documents together stand for one, and without any
other reference they are that of every document. Shares of few words or characters are noise, so distances have minimum
lengths, and common words of shorter texts are taken together: a text of n words is compared by n / ``GROUP_WORDS``
groups of common words that make up equal shares of the language, which keeps the noise of a distance at 0.06.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperlens.llm.arrow import map_texts, steps
from paperlens.session import checkpointed

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# Lengths from which the two distances decide, and the distances that reject.
CLASS_CHARACTERS, CLASS_DISTANCE = 200, 0.145
WORD_WORDS, WORD_DISTANCE = 300, 0.35
# Below so many words, by groups: four times the noise.
GROUP_WORDS, GROUP_DISTANCE = 50, 0.24
# A common word makes up this share of its language; so there are at most 500.
COMMON_SHARE = 0.002
# A language has a reference with this many documents; with this share of them it is frequent, so at most 1000 are.
LANGUAGE_DOCUMENTS, LANGUAGE_SHARE = 20, 0.001
# Different words that a task counts before it passes its sums on.
HELD_WORDS = 400_000

SYMBOLS = b"#*$%&|<>"
_SPACE = " \t\n\v\f\r"
CLASSES = ("plain", "upper", "space", "punctuation", "foreign", "symbol", "other")


def _classes() -> np.ndarray:
    """Class of each UTF-8 byte. Digits count as plain: numbers and keys say little about quality."""
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for name, members in (
        ("plain", b"abcdefghijklmnopqrstuvwxyz0123456789"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("space", _SPACE.encode()), ("punctuation", b".,;:!?'\"()-+@/="), ("symbol", SYMBOLS),
        ("foreign", bytes(range(128, 256))),
    ):
        table[list(members)] = CLASSES.index(name)
    return table


_CLASS_OF = _classes()


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS_OF[np.frombuffer(data, np.uint8)], minlength=len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms along the last axis, from 0 to 1."""
    middle = (p + q) / 2

    def to_middle(x: np.ndarray) -> np.ndarray:
        ratio = np.divide(x, middle, out=np.ones_like(middle), where=x > 0)
        return (x * np.log2(ratio)).sum(-1)

    return np.sqrt(np.maximum(0, (to_middle(p) + to_middle(q)) / 2))


def any_script(counts: np.ndarray) -> np.ndarray:
    """Counts or shares of classes along the last axis, without spaces and with all letters as one class."""
    own = dict(zip(CLASSES, np.moveaxis(np.asarray(counts, float), -1, 0), strict=True))
    letters = own["plain"] + own["upper"] + own["foreign"]
    merged = np.stack([letters, own["punctuation"], own["symbol"], own["other"]], -1)
    return merged / np.maximum(merged.sum(-1, keepdims=True), 1e-12)


@dataclass
class References:
    """Class shares by language (one row each) and shares of common words, the rest last; frequent languages first."""

    languages: list[str]
    classes: np.ndarray
    words: list[tuple[list[bytes], np.ndarray]]
    frequent: int
    # The only reference is that of all documents.
    together: bool = False
    groups: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.place = {name: at for at, name in enumerate(self.languages)}

    def compared(self, language: str | None) -> list[int]:
        """Places of the references for documents of a language (None: the frequent ones)."""
        at = 0 if self.together or language is None else self.place.get(language)
        if at is None:
            return []
        return [*range(self.frequent), *([at] if at >= self.frequent else [])]

    def class_distance(self, counts: np.ndarray, language: str | None = None) -> float:
        if counts.sum() < CLASS_CHARACTERS or not len(self.classes):
            return 0.0
        places = self.compared(language)
        classes = self.classes[places] if places else any_script(self.classes[:self.frequent])
        counts = counts if places else any_script(counts)
        if not counts.sum():
            return 0.0
        return float(js_distance(np.broadcast_to(counts / counts.sum(), classes.shape), classes).min())

    def word_distance(self, words: list[bytes], language: str) -> float:
        """To the own language if that is near enough, else to the nearest of those compared."""
        places = self.compared(language)
        if len(words) < MIN_WORDS or not self.words or not places:
            return 0.0
        counts = Counter(words)

        def distance(at: int) -> float:
            common, shares = self.words[at]
            if not common:
                return 0.0
            seen = np.array([*map(counts.__getitem__, common), 0], float)
            seen[-1] = len(words) - seen.sum()
            if len(words) < WORD_WORDS:
                of, shares = self.grouped(at, len(words) // GROUP_WORDS)
                seen = np.bincount(of, seen, len(shares))
            return float(js_distance(seen / len(words), shares))

        if language in self.place:
            own = distance(self.place[language])
            if own <= word_limit(len(words)):
                return own
        return min(map(distance, places))

    def grouped(self, at: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """Group of each common word, the most common first, and of the rest, which is the last; and their shares."""
        if (at, groups) not in self.groups:
            shares = self.words[at][1]
            order = np.argsort(-shares[:-1], kind="stable")
            before = np.cumsum(shares[:-1][order]) - shares[:-1][order]
            of = np.full(len(shares), groups)
            of[order] = np.minimum(before / max(shares[:-1].sum(), 1e-12) * groups, groups - 1).astype(int)
            self.groups[at, groups] = of, np.bincount(of, shares, groups + 1)
        return self.groups[at, groups]


def word_limit(words: int) -> float:
    """Word distance above which a text of so many words is rejected."""
    return WORD_DISTANCE if words >= WORD_WORDS else GROUP_DISTANCE


def _class_references(docs: DataFrame, text: str, lang: str) -> References:
    names = [f"_{c}" for c in CLASSES]

    def work(texts: list[str]) -> list[list]:
        counts = np.array([class_counts(t.encode()) if len(t.split(None, MIN_WORDS - 1)) >= MIN_WORDS
                           else np.zeros(len(CLASSES), int) for t in texts]).reshape(-1, len(CLASSES))
        return list(counts.T)

    counted = map_texts(
        docs.select(F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.col(text).alias("_text")), "_text",
        dict.fromkeys(names, pa.int64()), ", ".join(f"{n} long" for n in names), work,
    )
    total = sum(F.col(n) for n in names)
    shares = counted.where(total > 0).distinct().select("_lang", *[(F.col(n) / total).alias(n) for n in names])
    medians = [F.percentile_approx(n, 0.5, F.lit(1000)).alias(n) for n in names]
    # One row per language with enough documents, however rare, and one for all.
    rows = shares.rollup("_lang").agg(F.count("*").alias("_rows"), F.grouping("_lang").alias("_all"), *medians)
    found = rows.where((F.col("_all") == 1) | (F.col("_rows") >= LANGUAGE_DOCUMENTS)).orderBy("_lang").collect()
    every = next((row for row in found if row["_all"] == 1), None)
    if every is None or every["_rows"] == 0:
        return References([], np.zeros((0, len(CLASSES))), [], 0)
    own = [row for row in found if row["_all"] == 0]
    frequent = [row for row in own if row["_rows"] >= LANGUAGE_SHARE * every["_rows"]]
    rare = [row for row in own if row["_rows"] < LANGUAGE_SHARE * every["_rows"]]
    found = [*(frequent or [every]), *rare]
    medians = np.array([[row[n] for n in names] for row in found], float)
    names = [None if row is every else row["_lang"] for row in found]
    return References(names, medians / medians.sum(1, keepdims=True), [], len(frequent) or 1, not own)


def _word_counts(docs: DataFrame, text: str, lang: str, references: References,
                 wanted: set[bytes] | None) -> DataFrame:
    """(at, word, n) of parts of tasks, by place of the language's reference; null word: all words.

    The words are those common there (of rare languages all), or the ``wanted`` ones of frequent languages.
    """
    all_at = 0 if references.languages[0] is None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        counts: dict[int, Counter] = {}

        def flushed() -> pa.RecordBatch:
            rows = [(at, word, n) for at, own in counts.items() for word, n in own.items()
                    if word is None or wanted is not None or at >= references.frequent or n >= COMMON_SHARE * own[None]]
            counts.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.int64())], ["at", "word", "n"])

        for batch in steps(batches, text):
            for value, name in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist(), strict=True):
                name = name or ""
                places = {at for at in (all_at, references.place.get(name)) if at is not None}
                if wanted is not None:
                    places = {at for at in places if at < references.frequent}
                if not value or not places:
                    continue
                data = value.encode()
                words = data.lower().split()
                if len(words) < MIN_WORDS or references.class_distance(class_counts(data), name) > CLASS_DISTANCE:
                    continue
                for at in places:
                    own = counts.setdefault(at, Counter())
                    own[None] += len(words)
                    own.update(words if wanted is None else filter(wanted.__contains__, words))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield flushed()
        yield flushed()

    return docs.select(text, lang).mapInArrow(run, "at int, word binary, n long")


def references_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """References of all documents of a table, from three passes that send only small sums.

    A word that is common in a language is common in at least one part of it, so the words
    that are common in some part are candidates and are then counted everywhere. A rare language may have
    few documents in a part, where every word is common, so all its words are added up by a shuffle.
    """
    docs = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    references = _class_references(docs, "text", "lang")
    languages, frequent = references.languages, references.frequent
    if not languages:
        return references
    first = _word_counts(docs, "text", "lang", references, None)
    first = checkpointed(first) if len(languages) > frequent else first
    candidates = first.where((F.col("at") < frequent) & F.col("word").isNotNull())
    wanted = {bytes(row[0]) for row in candidates.select("word").distinct().collect()}
    sums = _word_counts(docs, "text", "lang", references, wanted).groupBy("at", "word").agg(F.sum("n").alias("n")).collect()
    if len(languages) > frequent:
        summed = first.where(F.col("at") >= frequent).groupBy("at", "word").agg(F.sum("n").alias("n"))
        totals = summed.where("word is null").select("at", F.col("n").alias("total"))
        sums += summed.join(totals, "at").where(F.col("n") >= COMMON_SHARE * F.col("total")).select("at", "word", "n").collect()
    found: list[dict] = [{} for _ in languages]
    for row in sums:
        found[row["at"]][None if row["word"] is None else bytes(row["word"])] = row["n"]
    for own in found:
        total = own.pop(None, 0)
        common = sorted(w for w, n in own.items() if n >= COMMON_SHARE * total)
        shares = np.array([own[w] for w in common] + [0.0]) / max(total, 1)
        shares[-1] = 1 - shares.sum()
        references.words.append((common, shares))
    return references


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, last, covered = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(last, at)
            last = at + 3
    return covered


def assess(docs: DataFrame, text: str = "text", lang: str = "lang", references: References | None = None,
           keep_text: bool = False) -> DataFrame:
    """``docs`` with its measures and ``kept``.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed, kept; columns of these names are replaced. Words end at ASCII
    white space. A null or empty text has no words and fails; a null language is one of its own.
    Rows are judged one by one, so repeated rows all get the same verdict.
    """
    references = references or references_of(docs, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(references)
    symbols = [bytes([s]) for s in SYMBOLS]

    def measure(value: str, language: str) -> tuple:
        data = value.encode()
        words = data.split()
        lines = [line for line in value.split("\n") if line.strip(_SPACE)]
        repeated = repeated_words(words)
        failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
        known = shared.value
        by_class = known.class_distance(class_counts(data), language)
        by_word = known.word_distance(data.lower().split(), language)
        return (
            len(words), len(value) - sum(map(value.count, _SPACE)), sum(map(data.count, symbols)),
            len(lines) - len(set(lines)), repeated, by_class, by_word, failed,
            not failed and by_class <= CLASS_DISTANCE and by_word <= word_limit(len(words)),
        )

    columns = {
        "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
        "n_repeat_words": "long", "class_distance": "double", "word_distance": "double",
        "base_failed": "boolean", "kept": "boolean",
    }
    arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return map_texts(
        docs, text, {name: arrow[kind] for name, kind in columns.items()},
        ", ".join(f"{name} {kind}" for name, kind in columns.items()),
        lambda texts, languages: list(zip(*map(measure, texts, languages), strict=True)) or [[]] * len(columns),
        keep_text, also=lang,
    )


def good_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their columns as they were."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    judged = assess(renamed, names[text], names[lang], keep_text=True).where("kept")
    return judged.select(*[F.col(n).alias(c) for c, n in names.items()])
