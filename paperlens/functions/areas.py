"""Sets of areas as bit masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

WORD = 63  # bits of a word that a signed long holds


def area_mask(column: Column | str, areas: Sequence[str]) -> Column:
    """array<long>: bit i % 63 of word i // 63 tells that the list holds area i; other areas have no bit."""
    listed = F.col(column) if isinstance(column, str) else column
    names = F.array(*[F.lit(a) for a in areas]) if areas else F.array().cast("array<string>")
    places = F.transform(F.array_distinct(listed), lambda a: (F.array_position(names, a) - 1).cast("int"))

    def word(w: int) -> Column:
        return F.aggregate(
            F.filter(places, lambda p: (p >= w * WORD) & (p < (w + 1) * WORD)), F.lit(0).cast("long"),
            lambda bits, p: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p - w * WORD)))

    words = -(-len(areas) // WORD)
    return F.array(*[word(w) for w in range(words)]) if words else F.array().cast("array<long>")


def share_area(left: Column | str, right: Column | str) -> Column:
    """True where two masks of the same areas have a bit in common."""
    return F.exists(F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseAND(b))), lambda n: n > 0)
