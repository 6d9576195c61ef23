"""Calendar arithmetic: hour index, seasons, quarters, month names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchscope.functions.hashing import as_column

# First hour of the simulations and the study season.
EPOCH = "2000-10-01 00:00:00"
SEASON_MONTHS = (12, 1, 2, 3, 4, 5)
HOUR_STEP = 3


def hour_index(ts) -> Column:
    """Whole hours since the first simulated hour."""
    seconds = F.unix_timestamp(as_column(ts).cast("timestamp")) - F.unix_timestamp(F.lit(EPOCH).cast("timestamp"))
    return F.floor(seconds / 3600).cast("bigint")


def hour_timestamp(index) -> Column:
    """Inverse of :func:`hour_index`."""
    start = F.unix_timestamp(F.lit(EPOCH).cast("timestamp"))
    return F.timestamp_seconds(start + as_column(index) * 3600)


def is_step_hour(ts, step: int = HOUR_STEP) -> Column:
    return F.hour(as_column(ts)) % step == 0


def is_step_index(index, step: int = HOUR_STEP) -> Column:
    return F.pmod(as_column(index), F.lit(step)) == 0


def in_season(ts) -> Column:
    return F.month(as_column(ts)).isin(*SEASON_MONTHS)


def on_day(ts, day: str) -> Column:
    start = F.lit(day).cast("timestamp")
    return (as_column(ts) >= start) & (as_column(ts) < start + F.expr("INTERVAL 1 DAY"))


def quarter_months(ts) -> Column:
    """Month range of the quarterly file that holds ``ts``, e.g. ``01-03``."""
    first = F.quarter(as_column(ts)) * 3 - 2
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(pad(first), F.lit("-"), pad(first + 2))


def month_name(ts) -> Column:
    return F.date_format(as_column(ts), "MMMM")


def year_month(ts) -> Column:
    return F.date_format(as_column(ts), "yyyyMM")


def month_last_hour(ts) -> Column:
    """23:00 of the last day of the month."""
    return F.last_day(as_column(ts)).cast("timestamp") + F.expr("INTERVAL 23 HOURS")


def year_range(start: int, end: int) -> list[int]:
    """Years from start to an exclusive end; equal bounds mean that one year."""
    return list(range(start, end if end > start else start + 1))


def time_axis(start: str, end: str, step: str) -> Column:
    """Array of timestamps from start to end, both included; ``step`` such as ``1 HOUR``."""
    return F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {step}"))
