"""Timestamps in log text (P8, P9) and time-of-day factors.

All event times are `timestamp_ntz`; the session time zone should be UTC.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake import catalog
from threatlake.functions import text

_CLOCK = r"\s+\d{1,2}:\d{1,2}:\d{1,2}"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}[T\s]\s*\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?$"
_ISO_ZULU = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}Z$"
_SYSLOG = r"^[A-Za-z]{3}\s+\d{1,2}" + _CLOCK + "$"
_YMD = r"^\d{4}/\d{1,2}/\d{1,2}" + _CLOCK + "$"
_MDY = r"^(\d{1,2})/(\d{1,2})/(\d{4})(" + _CLOCK + ")$"
_APACHE = r"^(\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2})\s+(?:Z|([+-]\d{2}):?(\d{2}))$"
_ANYWHERE = (
    r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
)


def _iso(stamp: Column) -> Column:
    return F.regexp_replace(stamp, r"[T\s]\s*", " ").try_cast("timestamp_ntz")


def _syslog(stamp: Column, default_year: int | None) -> Column:
    year = F.year(F.current_date()) if default_year is None else F.lit(default_year)
    dated = F.concat(year.cast("string"), F.lit(" "), F.regexp_replace(stamp, r"\s+", " "))
    return F.try_to_timestamp(dated, F.lit("yyyy MMM d H:m:s")).cast("timestamp_ntz")


def parse_timestamp(stamp: Column, default_year: int | None = None) -> Column:
    """ISO with or without fraction and Z, syslog, Y/m/d, m/d/Y or Apache; NULL for anything else.

    Syslog stamps carry no year: `default_year` supplies it, else the current year.
    """
    s = F.trim(stamp)
    zone = F.when(F.regexp_extract(s, _APACHE, 2) == "", F.lit("+0000")).otherwise(
        F.concat(F.regexp_extract(s, _APACHE, 2), F.regexp_extract(s, _APACHE, 3)))
    apache = F.try_to_timestamp(
        F.concat_ws(" ", F.regexp_extract(s, _APACHE, 1), zone), F.lit("d/MMM/yyyy:H:m:s Z"))
    return (
        F.when(s.rlike(_ISO), _iso(s))
        .when(s.rlike(_SYSLOG), _syslog(s, default_year))
        .when(s.rlike(_ISO_ZULU), _iso(F.rtrim(s, F.lit("Z"))))
        .when(s.rlike(_YMD), F.translate(s, "/", "-").try_cast("timestamp_ntz"))
        .when(s.rlike(_MDY), F.regexp_replace(s, _MDY, "$3-$1-$2$4").try_cast("timestamp_ntz"))
        .when(s.rlike(_APACHE), apache.cast("timestamp_ntz"))
    )


def parse_epoch(seconds: Column) -> Column:
    """Epoch seconds (double) to event time; NULL outside years 1 to 9999."""
    ok = seconds.between(-62135596800.0, 253402300799.0)
    return F.when(ok, F.timestamp_seconds(seconds)).cast("timestamp_ntz")


def parse_found(found: Column, default_year: int | None = None) -> Column:
    """Time of a stamp that was cut out of a line."""
    return F.when(found.rlike(_ISO), _iso(found)).when(found.rlike(_SYSLOG), _syslog(found, default_year))


def with_found_time(lines: DataFrame, column: str = "line", out: str = "found",
                    default_year: int | None = None) -> DataFrame:
    """Adds the time of the first ISO or syslog stamp anywhere in the line.

    NULL when there is none or it does not read as a time.
    """
    staged = text.computed_once(lines, "_stamp", F.regexp_extract(column, _ANYWHERE, 0))
    return text.computed_once(staged, out, parse_found(F.col("_stamp"), default_year)).drop("_stamp")


def time_multiplier(event_time: Column) -> Column:
    """Maintenance windows first, then business hours, else off hours; 1.0 without a time."""
    hour, day = F.hour(event_time), F.weekday(event_time)
    out = F.when(event_time.isNull(), F.lit(1.0))
    for weekday, start, end, multiplier in catalog.MAINTENANCE_WINDOWS:
        # Both windows run over midnight into the following day.
        inside = ((day == weekday) & (hour >= start)) | ((day == (weekday + 1) % 7) & (hour < end))
        out = out.when(inside, F.lit(multiplier))
    business = (day <= 4) & (hour >= catalog.BUSINESS_START) & (hour < catalog.BUSINESS_END)
    return out.when(business, F.lit(catalog.BUSINESS_MULTIPLIER)).otherwise(
        F.lit(catalog.OFF_HOURS_MULTIPLIER))


def is_business_hours(event_time: Column) -> Column:
    """Monday to Friday, 09:00 to 17:00:00 inclusive."""
    second = F.hour(event_time) * 3600 + F.minute(event_time) * 60 + F.second(event_time)
    micros = F.unix_micros(event_time.cast("timestamp")) % 1_000_000
    before_close = (second < 17 * 3600) | ((second == 17 * 3600) & (micros == 0))
    return (F.weekday(event_time) < 5) & (second >= 9 * 3600) & before_close


def is_after_hours(event_time: Column) -> Column:
    """23:00 to 05:00, over midnight."""
    hour = F.hour(event_time)
    return (hour >= catalog.AFTER_HOURS_START) | (hour < catalog.AFTER_HOURS_END)


def seconds_of(event_time: Column) -> Column:
    """Whole seconds since the epoch."""
    return F.unix_seconds(event_time.cast("timestamp"))


def as_timestamp_literal(value: datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")
