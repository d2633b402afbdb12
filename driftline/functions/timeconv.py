"""Conversions between serial day numbers, text dates and Spark dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: serial day number of 1970-01-01 when day 1 is 0000-01-01.
SERIAL_DAY_OF_EPOCH = 719529
SECONDS_PER_DAY = 86400
SEASON_MONTH = 6


def serial_to_days(serial: Column) -> Column:
    return serial - F.lit(float(SERIAL_DAY_OF_EPOCH))


def day_to_date(days: Column) -> Column:
    """Calendar day that contains a fractional day number (floor, also before 1970)."""
    return F.date_from_unix_date(F.floor(days).cast("int"))


def serial_to_date(serial: Column) -> Column:
    return day_to_date(serial_to_days(serial))


def serial_to_minute(serial: Column) -> Column:
    """Timestamp cut to the minute (session time zone must be UTC)."""
    seconds = F.floor(serial_to_days(serial) * SECONDS_PER_DAY / 60) * 60
    return F.timestamp_seconds(seconds.cast("bigint"))


def date_to_serial(day: Column) -> Column:
    return F.unix_date(day) + SERIAL_DAY_OF_EPOCH


def calendar_to_serial(year: Column, month: Column, day: Column) -> Column:
    return date_to_serial(F.make_date(year, month, day))


def date_to_days(day: Column) -> Column:
    return F.unix_date(day).cast("double")


def parse_us_date(text: Column) -> Column:
    """``M/d/yyyy`` with one- or two-digit month; NULL when it does not parse."""
    return F.try_to_date(text, "M/d/yyyy")


def parse_dashed_date(text: Column) -> Column:
    """``d-MMM-yyyy``, ignoring any time of day after the first blank."""
    return F.try_to_date(F.split_part(F.trim(text), F.lit(" "), F.lit(1)), "d-MMM-yyyy")


def parse_us_minute(text: Column) -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit("M/d/yyyy H:mm"))


def days_since_june(day: Column) -> Column:
    """Days since the latest June 1 on or before ``day``."""
    season = F.year(day) - F.when(F.month(day) < SEASON_MONTH, 1).otherwise(0)
    return F.datediff(day, F.make_date(season, F.lit(SEASON_MONTH), F.lit(1)))
