"""Timestamp arithmetic (X1-X5, X11). Works on TIMESTAMP_NTZ; session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _time_of_day_micros(ts: Column) -> Column:
    """Wall-clock microseconds since midnight (field extraction, no zone conversion)."""
    return (F.hour(ts).cast("long") * MICROS_PER_HOUR + F.minute(ts).cast("long") * 60_000_000
            + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long"))


def micros_between(end, start) -> Column:
    """Signed microseconds from ``start`` to ``end`` (null if either is null).

    Built from the calendar-day difference and the time-of-day difference, so the result is
    the exact wall-clock difference for TIMESTAMP_NTZ under any session zone (a zone-based
    difference is off by an hour when a wall-clock time falls in a DST gap of the zone).
    """
    e, s_ = _c(end), _c(start)
    days = F.datediff(F.to_date(e), F.to_date(s_)).cast("long")
    return days * MICROS_PER_DAY + _time_of_day_micros(e) - _time_of_day_micros(s_)


def whole_days_between(end, start) -> Column:
    """Floor of the elapsed days, so time of day counts (not calendar days)."""
    return F.floor(micros_between(end, start) / F.lit(MICROS_PER_DAY)).cast("int")


def hours_between(end, start) -> Column:
    """Elapsed hours as double."""
    return micros_between(end, start) / F.lit(float(MICROS_PER_HOUR))


def fractional_days(end, start) -> Column:
    """Elapsed days as double."""
    return micros_between(end, start) / F.lit(float(MICROS_PER_DAY))


def weekday_mon0(ts) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_c(ts))


def month_start(ts) -> Column:
    """First instant of the month, kept as TIMESTAMP_NTZ."""
    return F.trunc(F.to_date(_c(ts)), "month").cast("timestamp_ntz")


def month_label(ts) -> Column:
    """X11: 'yyyy-MM' label of a month."""
    return F.date_format(_c(ts), "yyyy-MM")


def plus_days(ts, days: int) -> Column:
    """Timestamp + whole days."""
    return _c(ts) + F.make_dt_interval(F.lit(days))


def epoch_micros(ts) -> Column:
    """X11: timestamp as integer microseconds since 1970-01-01 (NTZ-safe)."""
    return micros_between(_c(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a naive ``datetime`` (or pass a Column through).

    ``F.lit(datetime)`` builds a session-zone TIMESTAMP, which shifts against NTZ columns
    when the session zone is not the Python process zone; going through the ISO string
    keeps the wall-clock value exact under any ``spark.sql.session.timeZone``.
    """
    if isinstance(value, Column):
        return value
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
