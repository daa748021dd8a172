"""Capture-time expressions. The data carries no zone, so types are NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLIEST_YEAR = 1990


def _strict(text: Column, pattern: str, shape: str) -> Column:
    parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    return F.when(text.rlike(shape), parsed)


def capture_time(text: Column, latest_year: int | None = None) -> Column:
    """A capture time for grouping: two layouts, zero dates and odd years out."""
    clean = F.trim(text)
    parsed = F.coalesce(
        _strict(clean, "yyyy:M:d H:m:s", r"^\d{4}:\d{1,2}:\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
        _strict(clean, "yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    )
    last = F.lit(latest_year) if latest_year else F.year(F.current_date())
    return F.when(
        ~clean.startswith("0000") & F.year(parsed).between(EARLIEST_YEAR, last), parsed
    )


def display_time(text: Column) -> Column:
    """A capture time for display: one layout, no year bound, ISO text."""
    clean = F.trim(text)
    parsed = _strict(clean, "yyyy:M:d H:m:s",
                     r"^\d{4}:\d{1,2}:\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$")
    return F.when(
        ~clean.startswith("0000"), F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss")
    )


def month_span(start: Column, end: Column) -> Column:
    """``Mon YYYY``, or two of them when the months differ."""
    first = F.date_format(start, "MMM yyyy")
    last = F.date_format(end, "MMM yyyy")
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(" - "), last))


def age_seconds(now: Column, modified: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(modified)
