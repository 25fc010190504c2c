"""Service clocks and calendar buckets. Times are microseconds since 1970 in UTC unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LISBON = "Europe/Lisbon"
SECOND = 1_000_000
#: A service day begins at this local hour.
DAY_STARTS = 4


def _part(clock: Column, i: int) -> Column:
    return F.try_element_at(F.split(clock, ":"), F.lit(i)).try_cast("int")


def clock_seconds(clock: Column) -> Column:
    """Seconds of a timetable clock 'H:M:S', which may pass 24:00; null unless it has three whole numbers."""
    return F.when(F.size(F.split(clock, ":")) == 3, _part(clock, 1) * 3600 + _part(clock, 2) * 60 + _part(clock, 3))


def wall_us(day: Column, seconds: Column, zone: str = LISBON) -> Column:
    """The instant at which the wall clock of `zone` shows `day` plus that many seconds."""
    local = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + seconds)
    return F.unix_micros(F.to_utc_timestamp(local, zone))


def scheduled_us(day: Column, clock: Column) -> Column:
    """Clock on an operating day; hours before 4 belong to the next calendar day. No range check."""
    s = clock_seconds(clock)
    return wall_us(day, F.when(_part(clock, 1) < DAY_STARTS, s + 86400).otherwise(s))


def service_us(day: Column, clock: Column) -> Column:
    """Clock on a calendar day without any shift; minutes and seconds over 59 and negative hours give null."""
    good = (_part(clock, 1) >= 0) & _part(clock, 2).between(0, 59) & _part(clock, 3).between(0, 59)
    return wall_us(day, F.when(good, clock_seconds(clock)))


def local(us: Column, zone: str = LISBON) -> Column:
    return F.from_utc_timestamp(F.timestamp_micros(us), zone)


def service_day(us: Column) -> Column:
    """The local date, or the day before at local hours under 4."""
    t = local(us)
    return F.date_sub(F.to_date(t), F.when(F.hour(t) < DAY_STARTS, 1).otherwise(0))


def reference_us(us: Column, clock: Column) -> Column:
    """Clock on the service day of a ping."""
    return service_us(service_day(us), clock)


def half_hour(us: Column) -> Column:
    """Minute of the local day at which the instant's half hour begins."""
    t = local(us)
    return F.hour(t) * 60 + F.floor(F.minute(t) / 30).cast("int") * 30


def monday(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


#: Blocks of the day by their first hour and the hour after their last.
BLOCKS = [("06-10", 6, 10), ("10-16", 10, 16), ("16-21", 16, 21), ("21-24", 21, 24)]


def block(hour: Column) -> Column:
    """The block of an hour; hours in none are night."""
    out = F.lit("night")
    for name, first, end in BLOCKS:
        out = F.when((hour >= first) & (hour < end), name).otherwise(out)
    return out


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5
