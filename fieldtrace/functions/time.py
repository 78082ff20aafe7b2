"""Dates, local times, seasons and winters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import col, if_else

# First and last day of the year (leap-year numbering) of each season, and the
# order in which seasons are shown.
SEASONS = {
    "repro": [(106, 182)],
    "mue": [(183, 244)],
    "post-mue": [(245, 305)],
    "départ_hivernage": [(306, 320)],
    "hivernage": [(321, 366), (1, 46)],
    "départ_repro": [(47, 105)],
}
NESTING_DAYS = (106, 213)
REPORT_NESTING_DAYS = (92, 213)
WINTER_HALF_WIDTH = 40


def local_instant(date, time_of_day, zone: str = "Europe/Paris") -> Column:
    """Instant of a local date and time of day at minute precision; a missing time is noon.

    A local time that the clock change skips gives null.
    """
    date, clock = col(date), col(time_of_day)
    hour = F.coalesce(F.hour(clock), F.lit(12))
    minute = F.when(clock.isNull(), 0).otherwise(F.minute(clock))
    instant = F.try_make_timestamp_ltz(
        F.year(date), F.month(date), F.dayofmonth(date), hour, minute, F.lit(0), F.lit(zone))
    shown = F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz")), "HH:mm")
    asked = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))
    return F.when(shown == asked, instant)


def in_days(c, days: tuple[int, int]) -> Column:
    return F.dayofyear(col(c)).between(*days)


def season(c) -> Column:
    day = F.dayofyear(col(c))
    out = None
    for name, spans in SEASONS.items():
        for first, last in spans:
            test = day.between(first, last)
            out = F.when(test, name) if out is None else out.when(test, name)
    return out


def level_rank(c, levels) -> Column:
    """Position of a category in its fixed list of levels."""
    out = None
    for i, level in enumerate(levels):
        out = F.when(col(c) == level, i) if out is None else out.when(col(c) == level, i)
    return out


def winter(c) -> Column:
    """Winter a date belongs to, named after its December."""
    c = col(c)
    return F.year(c) - F.when(F.month(c) < 7, 1).otherwise(0)


def days_to_midwinter(c) -> Column:
    """Days between a date and 24 December of its winter."""
    c = col(c)
    return F.abs(F.datediff(F.make_date(winter(c), F.lit(12), F.lit(24)), F.to_date(c)))


def month_before(c) -> Column:
    """Same day one month earlier; null where that day does not exist."""
    back = F.add_months(F.to_date(col(c)), -1)
    return F.when(F.dayofmonth(back) == F.dayofmonth(col(c)), back)


def shifted_winter(c) -> Column:
    return F.year(month_before(c))


def month_name(c) -> Column:
    return F.date_format(col(c), "MMMM")


def age_class(age, winter_year, ringed_at) -> Column:
    """Young in the winter after the first capture, adult otherwise."""
    young = col(age).isin("1A", "2A", "pull") & (col(winter_year) == F.year(col(ringed_at)))
    return F.when(young, "je").otherwise("ad")


def default_text(c, value: str = "ind") -> Column:
    return F.coalesce(col(c), F.lit(value))


def flag(cond: Column) -> Column:
    return if_else(cond, F.lit(1), F.lit(0))
