"""Time arithmetic on zone-less timestamps (`timestamp_ntz`)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SITE_ZONE = "US/Central"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _require_utc() -> None:
    session = SparkSession.getActiveSession()
    zone = session.conf.get("spark.sql.session.timeZone") if session else "UTC"
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise RuntimeError(f"session zone is {zone}: clock changes would fold times; call session.configure first")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zone-less time, read as UTC."""
    _require_utc()
    return F.unix_micros(_col(ts).cast("timestamp"))


def cell(ts: str | Column, width: timedelta) -> Column:
    """Number of the `width`-long slice of the time line that holds `ts`; never decreases with time."""
    return F.call_function("div", micros(ts), F.lit(width // timedelta(microseconds=1)))


def to_local(ts: str | Column, zone: str = SITE_ZONE) -> Column:
    """UTC wall clock -> site wall clock, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts).cast("timestamp_ntz"))


def compose(date: str | Column, time: str | Column) -> Column:
    """Date part of one column and time of day of another, fractions of a second included, as one timestamp;
    NULL if either is NULL."""
    d, t = _col(date), _col(time)
    return F.call_function(
        "try_make_timestamp_ntz",
        F.year(d), F.month(d), F.dayofmonth(d),
        F.hour(t), F.minute(t), F.extract(F.lit("SECOND"), t).cast("decimal(16,6)"),
    )


def parse_time_of_day(text: str | Column) -> Column:
    """'HH:mm[:ss]' text as a timestamp on a fixed day, ready for `compose`."""
    return F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), _col(text))).cast("timestamp_ntz")


def elapsed(later: str | Column, earlier: str | Column, unit: str = "days") -> Column:
    """Signed difference as a double in days, hours, minutes or seconds."""
    per_unit = {"days": 86400e6, "hours": 3600e6, "minutes": 60e6, "seconds": 1e6}[unit]
    return (micros(later) - micros(earlier)).cast("double") / F.lit(per_unit)


def whole_years(later: str | Column, earlier: str | Column) -> Column:
    """Age as days / 365.25, truncated toward zero (not the calendar age)."""
    return (elapsed(later, earlier, "days") / F.lit(365.25)).cast("int")
