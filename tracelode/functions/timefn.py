"""Instants, local days and hours; the zone is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges by name; the profile's own bound for everything is 3651 days, the menu's 3650.
RANGE_DAYS = {"today": 1, "7d": 7, "30d": 30, "90d": 90, "180d": 180, "year": 365, "all": 3651}
MENU_RANGES = ("today", "7d", "30d", "90d", "180d", "year", "all")


def window_days(name: str) -> int:
    return RANGE_DAYS.get(name, 30)


def menu_range(name: str) -> str:
    if name not in MENU_RANGES:
        raise ValueError(f"unknown range {name!r}")
    return name


def instant(raw: Column) -> Column:
    """An RFC 3339 text as an instant, null if it is none."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(raw))


def epoch_instant(v: Column) -> Column:
    """Epoch numbers: milliseconds from 10^10 on, seconds below."""
    n = v.cast("double")
    return F.when(n >= 1e10, F.timestamp_millis(n.cast("long"))).otherwise(F.timestamp_micros((n * 1e6).cast("long")))


def local(ts: Column, tz: str = "UTC") -> Column:
    return ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(local(ts, tz), "yyyy-MM-dd")


def local_hour(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(local(ts, tz), "yyyy-MM-dd'T'HH:00")


def date_or_prefix(raw: Column, tz: str = "UTC") -> Column:
    """Local date of a readable instant, else a leading yyyy-mm-dd, else null."""
    return F.coalesce(local_date(instant(raw), tz), F.when(raw.rlike(r"^.{4}-.{2}-"), F.substring(raw, 1, 10)))


def gap_seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds between instants, toward zero."""
    return ((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000)).cast("long")


def iso_week(ts: Column) -> Column:
    return F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def work_period(hour: Column) -> Column:
    """Part of the day; the night is hours 0 to 5 here."""
    return F.when(hour <= 5, "night").when(hour <= 11, "morning").when(hour <= 17, "afternoon").otherwise("evening")


def is_recent(ts: Column, now: Column, seconds: int | Column) -> Column:
    """Whether ts lies in the seconds before now, to the microsecond; later instants do not."""
    age = F.unix_micros(now) - F.unix_micros(ts)
    return F.coalesce(age.between(F.lit(0), F.lit(seconds).cast("long") * 1_000_000), F.lit(False))


def in_range(date: Column, today: str, days: int) -> Column:
    return date.between(F.date_format(F.date_sub(F.lit(today).cast("date"), days - 1), "yyyy-MM-dd"), F.lit(today))
