"""Recency rules of postings; the present time and zone are always parameters.

`as_of` is an instant (UTC, if it has no zone of its own), `zone` the name of the zone that local days are of. Dates written as
`YYYY-MM-DD` begin at midnight UTC, those with points, slashes or single digits at local midnight. Bounds are worked
out once, so that rows are only compared with a day.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days that a posting counts as new, and periods that a reader may choose.
NEW_DAYS = 3
PERIODS = (7, 14, 21, 31)


def month_back(day: Column) -> Column:
    """The same day of the month before; days that it lacks run on into the next (31 March: 3 March)."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), -1), F.dayofmonth(day) - 1)


def _instant(as_of: datetime) -> datetime:
    return as_of.replace(tzinfo=timezone.utc) if as_of.tzinfo is None else as_of


def _local(as_of: datetime, zone: str) -> datetime:
    return _instant(as_of).astimezone(ZoneInfo(zone))


def _midnight(day: date, zone: str) -> datetime:
    """When a day begins in a zone, as an instant."""
    return datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)


def _month_before(day: date) -> date:
    """As `month_back`."""
    first = date(day.year - (day.month == 1), (day.month - 2) % 12 + 1, 1)
    return first + timedelta(days=day.day - 1)


def _first_since(instant: datetime, zone: str) -> date:
    """The first day that begins at an instant or later in a zone."""
    day = instant.astimezone(ZoneInfo(zone)).date() - timedelta(days=1)
    while _midnight(day, zone) < instant:
        day += timedelta(days=1)
    return day


def _read(reg_date: Column | str) -> tuple[Column, Column, Column]:
    """A text (null as empty), its day if it begins at midnight UTC, and its day if it begins at local midnight; null for other texts."""
    c = F.coalesce(F.col(reg_date) if isinstance(reg_date, str) else reg_date, F.lit(""))
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}\z")
    part = lambda i: F.regexp_extract(c, r"^(\d{4})[./-](\d{1,2})[./-](\d{1,2})\z", i)
    written = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    return c, F.when(iso, F.try_to_date(c, "yyyy-MM-dd")), F.when(~iso, written)


def _rolled(date: Column | str) -> Column:
    """The day of `YYYY-MM-DD` where months and days out of range run on; null for other texts."""
    c = F.col(date) if isinstance(date, str) else date
    y, m, d = (F.regexp_extract(c, r"^(\d{4})-(\d{2})-(\d{2})\z", i).try_cast("int") for i in (1, 2, 3))
    return F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1)


def within_month(reg_date: Column | str, as_of: datetime, strict: bool = False, zone: str = "UTC") -> Column:
    """Whether a posting is new enough to be gathered: registered since a month before `as_of`, to the minute, both in local time.

    Texts that aren't dates are kept. `strict` takes the month before by the calendar (31 March: 28 February).
    """
    now = _local(as_of, zone)
    bound = F.add_months(F.lit(now.date()), -1) if strict else F.lit(_month_before(now.date()))
    day = _rolled(reg_date)
    midnight = now.hour == now.minute == now.second == now.microsecond == 0
    return F.when(day.isNull(), True).otherwise((day >= bound) if midnight else (day > bound))


def within_month_view(reg_date: Column | str, as_of: datetime, zone: str = "UTC") -> Column:
    """Whether the listing shows a posting: it has a date, and not one before local midnight of the day a month back.

    West of UTC the bound's own day is so out, if it is written as an ISO date. Non-empty texts that aren't dates are shown.
    """
    c, utc, local = _read(reg_date)
    bound = _month_before(_local(as_of, zone).date())
    first = _first_since(_midnight(bound, zone), "UTC")
    return F.when(c == "", False).when(local.isNotNull(), local >= F.lit(bound)).when(utc.isNull(), True).otherwise(utc >= F.lit(first))


def within_days(reg_date: Column | str, as_of: datetime, days: int, zone: str = "UTC") -> Column:
    """Whether at most `days` times 24 hours have gone since the date began.

    Empty and unreadable dates are not within any; future ones are.
    """
    _, utc, local = _read(reg_date)
    since = _instant(as_of) - timedelta(days=days)
    return F.coalesce(utc >= F.lit(_first_since(since, "UTC")), local >= F.lit(_first_since(since, zone)), F.lit(False))


def is_new(reg_date: Column | str, as_of: datetime, zone: str = "UTC") -> Column:
    return within_days(reg_date, as_of, NEW_DAYS, zone)
