"""Secret scans: keyword prefilter, anchored expressions near the hits, checksum validation.

One Aho-Corasick pass over a text (A-Z lowered) finds the keywords of every kind. Only there is
the expression of a kind matched, anchored at the hit. Hexadecimal keys have no keyword: each run
of ``HEX_LENGTH`` digits covers some evenly spaced characters, and only runs of such probes are
looked at. Tokens that carry a CRC-32 in base 62 are found only if the checksum is right.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperlens.llm.arrow import map_texts

# Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")

ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
_STRIDE = 6

# The forms of the secrets.
_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)
_PROBES = re.compile(r"[0-9a-f]{%d,}" % (HEX_LENGTH // _STRIDE))
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: str) -> str:
    """CRC-32 of the body as six digits of base 62."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return digits


def _valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= ASSIGN_LENGTH
    if kind == "access":
        return len(match[0]) >= ACCESS_LENGTH
    return checksum(match[1]) == match[2]


_EXPRESSIONS = {"assign": _ASSIGN, "access": _ACCESS, "github": _GITHUB, "npm": _NPM}
_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for kind, words in _KEYWORDS.items():
            for word in words:
                _automaton.add_word(word, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, position of the kind in KINDS, end) of every secret, in this order."""
    found: list[tuple[int, int, int]] = []
    lowered = text.encode().lower().decode()
    taken = dict.fromkeys(_EXPRESSIONS, 0)
    for last, (kind, length) in _keywords().iter(lowered):
        start = last - length + 1
        if start < taken[kind]:
            continue
        match = _EXPRESSIONS[kind].match(text, start)
        if match:
            taken[kind] = match.end()
            if _valid(kind, match):
                found.append((start, KINDS.index(kind), match.end()))
    number = KINDS.index("hex")
    for probes in _PROBES.finditer(text[_STRIDE - 1::_STRIDE]):
        # The probes beside these are no digits, so no run of digits reaches over the borders.
        low = max(0, probes.start() * _STRIDE)
        high = probes.end() * _STRIDE + _STRIDE - 1
        found += [(m.start(), number, m.end()) for m in _HEX.finditer(text, low, high)]
    return sorted(found)


def find_secrets(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``secrets``: array of (start, kind, end) in code points, by start, then kind.

    Matches of a kind are the leftmost that do not overlap; those of other kinds may. A null or
    empty text has an empty array. Rows are kept one by one; a column named secrets is replaced.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def work(texts: list[str]) -> list[list]:
        return [[[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans_of(t)] for t in texts]]

    return map_texts(docs, text, {"secrets": kind},
                     "secrets array<struct<start: int, kind: string, end: int>>", work, keep_text)


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; spans that overlap share one mark.

    A text without secrets, and a null one, stay as they are.
    """
    def clean(value: str) -> str | None:
        parts, done = [], 0
        for start, _, end in spans_of(value):
            if start >= done:
                parts += [value[done:start], mark]
            done = max(done, end)
        return "".join([*parts, value[done:]]) if parts else None

    def work(texts: list[str]) -> list[list]:
        return [[clean(t) for t in texts]]

    marked = map_texts(docs, text, {"_redacted": pa.string()}, "_redacted string", work, keep_text=True)
    return marked.withColumn(text, F.coalesce("_redacted", F.col(f"`{text}`"))).drop("_redacted").select(
        *[f"`{c}`" for c in docs.columns])


def span_list(secrets: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans, comma-joined."""
    some = F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(secrets: Column, kind: str) -> Column:
    return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long")
