"""Masking, sentence splitting and tokenizing as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Patterns and tags that mask numeric expressions, applied in this order.
_NUMBER = r"(?:\+/-|\+-|\+|-)?\s*\d+(?:\.\d+)*"
NUMERIC_MASKS: tuple[tuple[str, str], ...] = (
    (_NUMBER + r"\s*%", " sodadpct "),
    (r"[<>=]+\s*" + _NUMBER, " sodadnumexpr "),
    (_NUMBER + r"\s*[<>=]+", " sodadnumexpr "),
    (_NUMBER, " sodadnum "),
    (r"\(.*?\)", " "),
    (r"\s+", " "),
)

SENTENCE_END = r"([.!?])\s+"
# A run of letters and digits, with inner dots, apostrophes and hyphens, or one other mark.
TOKEN = r"[\p{L}\p{N}]+(?:[.'-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"

# Any number starts with one of these. Asked first, it spares trying all of a number at every letter.
_NUMBER_START = r"(?=[-+\s\d])"

TokenFn = Callable[[Column], Column]


def mask(text: Column, masks: Sequence[tuple[str, str]] = NUMERIC_MASKS) -> Column:
    for pattern, tag in masks:
        if pattern.startswith(_NUMBER):
            pattern = _NUMBER_START + pattern
        text = F.regexp_replace(text, F.lit(pattern), F.lit(tag))
    return text


def sentences(text: Column) -> Column:
    """Array of sentences: text up to a closing mark and white space, or up to a line break."""
    return F.split(F.regexp_replace(text, F.lit(SENTENCE_END), F.lit("$1\n")), "\n")


def tokens(text: Column, token_fn: TokenFn | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(found, token_fn) if token_fn else found
