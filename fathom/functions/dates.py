"""Dates written as text or epoch numbers as column expressions; unreadable ones are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(c: Column) -> Column:
    """Epoch milliseconds above 1e12, seconds above 1e9; else null."""
    v = c.try_cast("double")
    return F.when(v > 1e12, F.timestamp_millis(v.cast("long"))).when(v > 1e9, F.timestamp_seconds(v.cast("long")))


def month_year(month: Column, year: Column) -> Column:
    """The first day of an English month name and a year."""
    return F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.trim(month)), year.cast("string")), F.lit("MMMM yyyy")).cast("date")
