"""Time arithmetic on TIMESTAMP_NTZ.

Durations are carried as BIGINT microseconds (exact, hash-stable, cheap in
codegen) and turned into double hours only at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
SECOND_US = 1_000_000

EPOCH = "1970-01-01 00:00:00"

# Day-first layouts accepted per row, most specific first; ISO text is read as
# real ISO (year first), never re-interpreted day-first.
DAY_FIRST_FORMATS = [
    "d/M/yyyy H:mm[:ss]",                 # 01/06/2024 08:00, 1/6/2024 8:00:30
    "yyyy-MM-dd['T'][' ']HH:mm[:ss]",     # ISO date-time, read as ISO
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_col() -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz")


def to_us(ts) -> Column:
    """TIMESTAMP_NTZ -> BIGINT microseconds since 1970-01-01 (NULL stays NULL)."""
    return F.timestamp_diff("MICROSECOND", epoch_col(), _c(ts))


def from_us(us) -> Column:
    """BIGINT microseconds since 1970-01-01 -> TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", _c(us), epoch_col())


def us_to_hours(us) -> Column:
    return _c(us) / F.lit(float(HOUR_US))


def hours_between(start, end) -> Column:
    """(end - start) in double hours; NULL if either side is NULL."""
    return us_to_hours(F.timestamp_diff("MICROSECOND", _c(start), _c(end)))


def add_hours(ts, hours) -> Column:
    """ts + hours (double hours, rounded to the microsecond)."""
    h = hours if isinstance(hours, Column) else F.lit(float(hours))
    return F.timestamp_add("MICROSECOND", F.round(h * F.lit(float(HOUR_US))).cast("bigint"), _c(ts))


def parse_day_first(date_text, time_text=None) -> Column:
    """Combine a date and a time text and parse it day-first, row by row.

    Unparseable text (``nan``, ``25:00``, junk) or a NULL part yields NULL.
    Each row is parsed on its own, so one odd row never changes how others
    parse (unlike inferring one format from the first value).
    """
    txt = _c(date_text) if time_text is None else F.concat(_c(date_text), F.lit(" "), _c(time_text))
    txt = F.trim(txt)
    return F.coalesce(*[F.try_to_timestamp(txt, F.lit(f)) for f in DAY_FIRST_FORMATS]).cast("timestamp_ntz")
