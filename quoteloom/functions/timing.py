"""Time arithmetic on epoch microseconds, sessions and calendar keys.

Every operator works on a ``us`` column (epoch microseconds, UTC): integer arithmetic stays inside
generated code and is exact, and ranges are half-open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR
WEEK = 7 * DAY


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell(us, width: int) -> Column:
    """Index of the epoch-aligned cell of ``width`` microseconds (floor, also before 1970)."""
    c = col(us)
    return ((c - F.pmod(c, F.lit(width).cast("long"))) / F.lit(width)).cast("long")


def cell_start(us, width: int) -> Column:
    c = col(us)
    return c - F.pmod(c, F.lit(width).cast("long"))


def as_timestamp(us) -> Column:
    return F.timestamp_micros(col(us))


def utc_hour(us) -> Column:
    return F.floor(F.pmod(col(us), F.lit(DAY)) / HOUR).cast("int")


def session_fixed(us, overlap_start: int = 13) -> Column:
    """Session by fixed UTC hours: Asia to 7, London to the overlap, New York to 21, then off-hours."""
    h = utc_hour(us)
    return (
        F.when(h < 7, "ASIA")
        .when(h < overlap_start, "LONDON")
        .when(h < 16, "LONDON_NEW_YORK")
        .when(h < 21, "NEW_YORK")
        .otherwise("OFF_HOURS")
    )


def session_dst(us) -> Column:
    """Session by local business hours (08 to 17) of London, New York and Tokyo, summer time aware."""
    ts = as_timestamp(us)

    def is_open(zone: str) -> Column:
        h = F.hour(F.from_utc_timestamp(ts, zone))
        return (h >= 8) & (h < 17)

    london, new_york, tokyo = is_open("Europe/London"), is_open("America/New_York"), is_open("Asia/Tokyo")
    return (
        F.when(london & new_york, "LONDON_NEW_YORK")
        .when(london, "LONDON")
        .when(new_york, "NEW_YORK")
        .when(tokyo, "ASIA")
        .otherwise("OTHER")
    )


def iso_week(us) -> Column:
    """ISO year and week, e.g. ``2024-W05``."""
    ts = as_timestamp(us)
    year = F.extract(F.lit("YEAROFWEEK"), ts)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def day_text(us) -> Column:
    return F.date_format(as_timestamp(us), "yyyy-MM-dd")


def month_text(us) -> Column:
    return F.date_format(as_timestamp(us), "yyyy-MM")


def weekday_name(us) -> Column:
    return F.date_format(as_timestamp(us), "EEEE")
