"""Instants as (seconds since 1970, nanoseconds).  Two readings of text, which differ on purpose.

``search_instant`` is for filters: a zone is demanded, the day must exist, a clock may
be compact (HHMMSS), and digits beyond nanoseconds must be zero.  ``order_instant`` is
for the order of messages: no zone means UTC, digits beyond nanoseconds are ignored,
there is no compact clock, and only the ranges of month and day are checked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.binding import bind

_DATE = r"^\s*(\d{1,6})-(\d{1,2})-(\d{1,2})[T ]"
_ZONE = r"(Z|[+-]\d{2}:?\d{2})"
_SEARCH = _DATE + r"(?:(\d{1,2}):(\d{1,2}):(\d{1,2})|(\d{2})(\d{2})(\d{2}))(?:\.(\d+))?" + _ZONE + r"\s*$"
_ORDER = _DATE + r"(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d*))?" + _ZONE + r"?\s*$"


def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("long"))


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a proleptic Gregorian date; a day beyond its month runs on into the next."""
    y = F.when(month <= 2, year - 1).otherwise(year)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * F.pmod(month + 9, F.lit(12)) + 2) / 5) + day - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("long")


def _nanos(fraction: Column) -> Column:
    return F.rpad(F.substring(fraction, 1, 9), 9, "0").cast("int")


def _offset(zone: Column) -> Column:
    digits = F.regexp_replace(zone, "[Z:+-]", "")
    minutes = _number(F.substring(digits, 1, 2)) * 60 + _number(F.substring(digits, 3, 2))
    return F.when(zone.startswith("-"), -minutes).when(digits == "", F.lit(0)).otherwise(minutes)


def _zone_ok(zone: Column) -> Column:
    digits = F.regexp_replace(zone, "[Z:+-]", "")
    return (digits == "") | ((_number(F.substring(digits, 1, 2)) <= 23) & (_number(F.substring(digits, 3, 2)) <= 59))


def _month_days(year: Column, month: Column) -> Column:
    leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _instant(ok: Column, days: Column, clock: list[Column], offset: Column, nanos: Column) -> Column:
    hour, minute, second = clock
    fine = ok & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    seconds = days * 86400 + hour * 3600 + minute * 60 + second - offset * 60
    return F.when(fine, F.struct(seconds.cast("long").alias("sec"), nanos.cast("int").alias("nanos")))


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern as an array, all null where it does not match."""
    return F.when(text.rlike(pattern), F.array(*(F.regexp_extract(text, pattern, k) for k in range(n + 1))))


def search_instant(text: Column) -> Column:
    """Struct (sec, nanos), or null for text that isn't an instant with a zone."""

    def read(p: Column) -> Column:
        year, month, day = (_number(p[k]) for k in (1, 2, 3))
        clock = [F.coalesce(_number(p[k]), _number(p[k + 3])) for k in (4, 5, 6)]
        ok = month.between(1, 12) & day.between(1, _month_days(year, month)) & _zone_ok(p[11]) & ~F.substring(p[10], 10, 1 << 20).rlike("[1-9]")
        return _instant(ok, _days(year, month, day), clock, _offset(p[11]), _nanos(p[10]))

    return bind(_groups(text, _SEARCH, 11), read)


def order_instant(text: Column) -> Column:
    """Struct (sec, nanos), or null for text that has no place on the line of time."""

    def read(p: Column) -> Column:
        year, month, day = (_number(p[k]) for k in (1, 2, 3))
        ok = month.between(1, 12) & day.between(1, 31) & _zone_ok(p[8])
        return _instant(ok, _days(year, month, day), [_number(p[k]) for k in (4, 5, 6)], _offset(p[8]), _nanos(p[7]))

    return bind(_groups(text, _ORDER, 8), read)


def sort_class(raw: Column, instant: Column) -> Column:
    """0 missing, 1 text that is no instant, 2 an instant: the first key of the order of placements."""
    return F.when(raw.isNull(), 0).when(instant.isNull(), 1).otherwise(2)


def relative_millis(text: str, now_ms: int) -> int | None:
    """The time that ``Nh``, ``Nd`` or ``Nw`` before now stands for, in milliseconds; null if it isn't one of those."""
    hours = {"h": 1, "d": 24, "w": 168}
    text = text.strip()
    if len(text) < 2 or text[-1] not in hours or not text[:-1].isascii() or not text[:-1].isdigit() or int(text[:-1]) == 0:
        return None
    return now_ms - int(text[:-1]) * hours[text[-1]] * 3_600_000


def iso_utc(seconds: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
