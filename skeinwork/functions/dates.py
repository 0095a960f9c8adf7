"""Dates and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy")


def parsed_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that fits, value by value; null if none does."""
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def year_of(c: Column) -> Column:
    """The year of a date text in any format, or of a bare year."""
    return F.coalesce(F.year(parsed_date(c)), F.regexp_extract(c, r"\b((?:18|19|20)[0-9]{2})\b", 1).try_cast("int"))


def season_of(c: Column, first_month: int = 8, separator: str = "/") -> Column:
    """`2023/24` for a date from August 2023 to July 2024."""
    start = F.year(c) - F.when(F.month(c) < first_month, 1).otherwise(0)
    return F.concat(start.cast("string"), F.lit(separator), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def season_shifted(c: Column, by: int) -> Column:
    """A season label some seasons on: `2023-24` by -1 is `2022-23`."""
    start = F.substring(c, 1, 4).cast("int") + by
    return F.concat(start.cast("string"), F.substring(c, 5, 1), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def from_epoch(c: Column) -> Column:
    return F.timestamp_seconds(c)
