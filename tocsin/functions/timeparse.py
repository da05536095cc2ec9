"""Clock-text parsing (O07) and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month/day/year hour:minute:second layouts accepted, tried in order.
MDY_HMS_FORMATS = (
    "M/d/yyyy H:m:s",
    "M/d/yy H:m:s",
    "M-d-yyyy H:m:s",
    "M-d-yy H:m:s",
    "M.d.yyyy H:m:s",
    "M/d/yyyy H:m:s a",
    "M/d/yyyy h:m:s a",
)


def mdy_hms(text: Column) -> Column:
    """Parse month/day/year hour:minute:second text; anything else -> NULL."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(fmt)) for fmt in MDY_HMS_FORMATS])


def mdy_hms_of(date: Column, time: Column) -> Column:
    """``mdy_hms(paste(date, time))``."""
    return mdy_hms(F.concat_ws(" ", date, time))


def format_mdy(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy HH:mm:ss")


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(ts) + seconds)


def minutes_between(end: Column, start: Column) -> Column:
    """Difference in minutes (the baseline table labels durations in minutes)."""
    return (F.unix_seconds(end) - F.unix_seconds(start)) / F.lit(60.0)
