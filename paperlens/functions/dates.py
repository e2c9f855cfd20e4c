"""Sort dates written as yyyymmdd strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted years, and the form of a sort date (lexical, so 31 February passes).
YEAR_PATTERN = "201[5-9]"
SORT_DATE = r"^(YEAR)(0[1-9]|1[012])(0[1-9]|[12][0-9]|3[01])\z"


def sort_date_pattern(year_pattern: str = YEAR_PATTERN) -> str:
    """``\\z`` instead of ``$``: the latter also accepts a trailing line break."""
    return SORT_DATE.replace("YEAR", year_pattern)


def is_sort_date(column: Column, year_pattern: str = YEAR_PATTERN) -> Column:
    return column.rlike(sort_date_pattern(year_pattern))


def year_of(column: Column) -> Column:
    return F.substring(column, 1, 4).cast("short")


def month_of(column: Column) -> Column:
    return F.substring(column, 5, 2).cast("short")
