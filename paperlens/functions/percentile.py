"""Percentile of a value within an empirical distribution held in one array."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percentile_in(x: Column, distribution: Column) -> Column:
    """``distribution``: array<struct<value, ptile>> sorted by value.

    Percentile of the last value strictly below ``x``: 0 if there is none, 1 if all are
    below (so also for an empty distribution). NaN is above nothing.
    """
    x = x.cast("double")
    below, size = count_below(x, distribution), F.size(distribution)
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(below == size, F.lit(1.0))
        .when(below == 0, F.lit(0.0))
        .otherwise(F.get(distribution, below - 1)["ptile"])
    )


def count_below(x: Column, distribution: Column) -> Column:
    """Number of elements whose value is strictly below ``x``, none for NaN: a binary search, whose steps
    add up powers of two from the largest within the size."""
    size = F.size(distribution)
    powers = F.transform(
        F.sequence(F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int"), F.lit(0)),
        lambda e: F.call_function("shiftleft", F.lit(1), e))

    def step(found: Column, power: Column) -> Column:
        value = F.get(distribution, found + power - 1)["value"]
        return F.when((found + power <= size) & ~F.isnan(x) & (value < x), found + power).otherwise(found)

    return F.aggregate(powers, F.lit(0), step)
