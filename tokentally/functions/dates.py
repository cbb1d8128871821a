"""Timestamps, zones and report periods."""

from __future__ import annotations

import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
_ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
WEEKDAYS = {"sunday": 0, "monday": 1, "tuesday": 2, "wednesday": 3, "thursday": 4, "friday": 5, "saturday": 6}


def parse_timestamp(c: Column) -> Column:
    """ISO timestamps with a T; without a zone they are UTC; anything else is null."""
    return F.when(c.rlike(_PLAIN), c.try_cast("timestamp"))


def parse_rfc3339(c: Column) -> Column:
    """The same, and a zone is required."""
    return F.when(c.rlike(_ZONED), c.try_cast("timestamp"))


def zone(name: str | None) -> str:
    """A valid zone name; null, empty and unknown names mean UTC, spaces stand for underscores."""
    for candidate in (name or "UTC", (name or "UTC").replace(" ", "_")):
        try:
            return ZoneInfo(candidate).key
        except Exception:  # noqa: BLE001  zoneinfo raises several kinds for bad names
            continue
    return "UTC"


def date_in_zone(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd")


def date_as_written(c: Column) -> Column:
    """The day in the log's own offset: what the text begins with, if it is a timestamp with a zone."""
    return F.when(c.rlike(_ZONED), F.substring(c, 1, 10))


def week_start(day: Column, start: str = "monday") -> Column:
    """The first day of the week that ``day`` (a date) is in."""
    return F.date_sub(day, F.pmod(F.dayofweek(day) - 1 - WEEKDAYS[parse_weekday(start)], F.lit(7)))


def bucket(date: Column, kind: str, start: str = "monday") -> Column:
    """A date string's period: itself, its week's first day, or its month; what is no date stays as it is."""
    if kind == "monthly":
        return F.substring(date, 1, 7)
    if kind == "weekly":
        return F.coalesce(F.date_format(week_start(F.try_to_date(date, "yyyy-MM-dd"), start), "yyyy-MM-dd"), date)
    return date


def parse_weekday(name: str | None) -> str:
    low = (name or "").strip().lower()
    return low if low in WEEKDAYS else "monday"


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c.cast("bigint"))


def millis_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def minute_text(ts: Column) -> Column:
    """To the minute, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def second_text(ts: Column) -> Column:
    """To the second, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_date(c: Column) -> Column:
    """A date from YYYY-MM-DD, null from anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def flexible_timestamp(c: Column) -> Column:
    """Log timestamps as text: a text with a date prefix stays, an ISO text or a number (above 1e10 milliseconds, else seconds) becomes ISO text.

    ``c`` is the field as text; numbers arrive as their digits.
    """
    t = F.trim(c)
    n = F.when(t.rlike(r"^\d{1,15}$"), t.try_cast("bigint"))
    number = F.when(n > 0, millis_text(from_millis(F.when(n > 10_000_000_000, n).otherwise(n * 1000))))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t).otherwise(F.coalesce(number, millis_text(parse_timestamp(t))))


def bound(text: str | None) -> str | None:
    """A date bound as YYYYMMDD; a time of day is dropped."""
    if not text:
        return None
    m = re.match(r"^(\d{4})-(\d{2})-(\d{2})(?: \d{2}:\d{2}(?::\d{2})?)?$", text.strip())
    return "".join(m.groups()) if m else re.sub(r"\D", "", text) or None


def in_range(date: Column, since: str | None, until: str | None) -> Column:
    """Inclusive, on dates with the dashes taken out."""
    plain, ok = F.replace(date, F.lit("-"), F.lit("")), F.lit(True)
    if bound(since):
        ok = ok & (plain >= bound(since))
    if bound(until):
        ok = ok & (plain <= bound(until))
    return ok


def duration_text(seconds: Column) -> Column:
    """30s, 5m, 1h30m."""
    s = F.floor(seconds).cast("bigint")
    hours, minutes = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(minutes, F.lit("m"))).otherwise(F.concat(hours, F.lit("h"), minutes, F.lit("m")))


def duration_long(seconds: Column) -> Column:
    """30s, 5m0s, 1h30m: as the watcher prints it."""
    s = F.floor(seconds).cast("bigint")
    hours, minutes = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(minutes, F.lit("m"), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(hours, F.lit("h"), minutes, F.lit("m")))
