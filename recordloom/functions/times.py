"""Absolute time and its printed forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# formats of the printed forms: fixed values
DATE_FORMAT, TIME_FORMAT = "yyyyMMdd", "HHmmss"


def ask_time() -> Column:
    """Milliseconds now; the same for every row of a query."""
    return F.unix_millis(F.current_timestamp())


def format_date(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), DATE_FORMAT)


def format_time(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), TIME_FORMAT)


def record_date(text: Column) -> Column:
    """A date kept as eight digits; anything else is null."""
    return F.try_to_timestamp(text.cast("string"), F.lit(DATE_FORMAT)).cast("date")
