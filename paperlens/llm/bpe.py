"""Byte-level BPE: encode whole texts to token ids and decode them again.

A word is merged in a contiguous array of the ranks of its adjacent parts: the minimum is
found by a scan, its boundary is deleted and the two neighbouring ranks are refreshed. A scan
per merge suits short words; a word of more than ``SHORT`` bytes takes a heap of the same
(rank, position) keys, which merges in the same order without its quadratic cost.

The vocabulary file (the JSON form of public tokenizers) is a parameter. It is read on the
driver and sent to the workers; its size is checked against ``MAX_FILE``.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from paperlens.llm.arrow import map_texts

MAX_FILE = 64_000_000
SHORT = 96
CACHED_WORDS = 300_000

# Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pattern with its classes spelled out for code points up to U+024F.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_NARROW = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_WIDE_CHARACTER = re.compile("[^\0-ɏ]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b in set(printable) else chr(256 + rest.index(b)) for b in range(256)]


class Splitter:
    """Cuts a text into the words that merges do not cross."""

    def __init__(self) -> None:
        self._wide = self._new = None

    def words(self, text: str) -> list[str]:
        if not _WIDE_CHARACTER.search(text):
            return _NARROW.findall(text)
        if self._wide is None:
            import regex

            self._wide = regex.compile(PATTERN)
            # Characters newer than the tokenizer's tables count as symbols there.
            newer = regex.compile(r"[\p{L}\p{N}\s]")
            self._new = {
                c: 0xE000 for c in range(0x250, sys.maxunicode + 1)
                if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and newer.match(chr(c))
            }
        masked = text.translate(self._new)
        if masked == text:
            return self._wide.findall(text)
        return [text[m.start():m.end()] for m in self._wide.finditer(masked)]


class ByteBpe:
    """One vocabulary with its merges."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model, step = spec["model"], spec["pre_tokenizer"]
        if (model["type"] != "BPE" or step["type"] != "ByteLevel" or step.get("add_prefix_space")
                or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges")):
            raise ValueError("only plain byte-level BPE files are supported")
        vocabulary: dict[str, int] = model["vocab"]
        added = [a for a in spec.get("added_tokens", [])]
        if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or a.get("normalized") for a in added):
            raise ValueError("added tokens with special borders are not supported")
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.size = 1 + max([*vocabulary.values(), *(a["id"] for a in added)])
        self.bytes_of = [b""] * self.size
        for token, number in vocabulary.items():
            self.bytes_of[number] = bytes(byte_of[c] for c in token)
        for a in added:
            self.bytes_of[a["id"]] = a["content"].encode()
        self.special = {a["content"]: a["id"] for a in added}
        self._special = re.compile("|".join(
            re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if added else None
        self.first = [vocabulary[c] for c in characters]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocabulary[left] * self.size + vocabulary[right]] = rank
            self.merged.append(vocabulary[left + right])
        self.none = len(self.merged)
        self.splitter = Splitter()
        self.known: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Merge the parts of a short word in place."""
        get, size, none = self.rank.get, self.size, self.none
        ranks = [get(a * size + b, none) for a, b in pairwise(parts)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at] = self.merged[best]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] * size + parts[at], none)
            if at < len(ranks):
                ranks[at] = get(parts[at] * size + parts[at + 1], none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for a word of any length, the next one taken from a heap."""
        get, size = self.rank.get, self.size
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        ranked = ((get(a * size + b), at) for at, (a, b) in enumerate(pairwise(parts)))
        heap = [found for found in ranked if found[0] is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            nxt = after[at]
            if parts[at] < 0 or nxt < 0 or get(parts[at] * size + parts[nxt]) != rank:
                continue
            parts[at], parts[nxt] = self.merged[rank], -1
            after[at] = after[nxt]
            if after[nxt] >= 0:
                before[after[nxt]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0:
                    found = get(parts[left] * size + parts[after[left]])
                    if found is not None:
                        heapq.heappush(heap, (found, left))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            parts = [self.first[b] for b in word.encode()]
            parts = self.merge(parts) if len(parts) <= SHORT else self.merge_long(parts)
            found = np.array(parts, "<u4").tobytes()
            if len(parts) <= SHORT:
                if len(self.known) >= CACHED_WORDS:
                    self.known.clear()
                self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self._special is None:
            return self._plain(text)
        out, start = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[start:m.start()]), self.special[m.group()].to_bytes(4, "little")]
            start = m.end()
        return b"".join([*out, self._plain(text[start:] if start else text)])

    def _plain(self, text: str) -> bytes:
        get, make = self.known.get, self.word
        return b"".join([get(w) or make(w) for w in self.splitter.words(text)])

    def decode(self, ids: bytes) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[int, ByteBpe] = {}


def _vocabulary(content: Broadcast) -> ByteBpe:
    """One parsed vocabulary per worker process, kept between tasks."""
    found = _loaded.get(content.id)
    if found is None:
        _loaded.clear()
        found = _loaded[content.id] = ByteBpe(content.value)
    return found


class _Handle:
    def __init__(self, content: Broadcast, number: int) -> None:
        self.content, self.id = content, number

    @property
    def value(self) -> bytes:
        return self.content.value


def _shared(spark: SparkSession, path: str) -> _Handle:
    with open(path, "rb") as file:
        content = file.read(MAX_FILE + 1)
    if len(content) > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} bytes")
    return _Handle(spark.sparkContext.broadcast(content), hash(content))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` of the whole text.

    Equal to the tokenizers library with add_special_tokens=False: the strings of special
    tokens in a text become those tokens. A null text counts as empty and has no tokens; rows
    are kept one by one, whatever their other columns hold; columns named token_ids or n_tokens
    are replaced. An empty table stays empty.
    """
    handle = _shared(docs.sparkSession, path)

    def work(texts: list[str]) -> list[list]:
        ids = [_vocabulary(handle).encode(t) for t in texts]
        return [ids, [len(i) // 4 for i in ids]]

    return map_texts(docs, text, {"token_ids": pa.binary(), "n_tokens": pa.int64()},
                     "token_ids binary, n_tokens long", work, keep_text=True)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``token_ids`` (null ids: empty)."""
    handle = _shared(encoded.sparkSession, path)

    def work(ids: list[bytes]) -> list[list]:
        vocabulary = _vocabulary(handle)
        return [[vocabulary.decode(i or b"") for i in ids]]

    return map_texts(encoded, "token_ids", {"decoded": pa.string()}, "decoded string", work, keep_text=True)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass, without the text itself: token_ids, n_tokens, decoded."""
    handle = _shared(docs.sparkSession, path)

    def work(texts: list[str]) -> list[list]:
        vocabulary = _vocabulary(handle)
        ids = [vocabulary.encode(t) for t in texts]
        return [ids, [len(i) // 4 for i in ids], [vocabulary.decode(i) for i in ids]]

    added = {"token_ids": pa.binary(), "n_tokens": pa.int64(), "decoded": pa.string()}
    return map_texts(docs, text, added, "token_ids binary, n_tokens long, decoded string", work)
