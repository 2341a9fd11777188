"""Weeks, periods and buckets, as column expressions in UTC; the present is always a parameter."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90}
RETRY_SECONDS = (30, 60, 120, 240, 480)


def moment(at: datetime) -> Column:
    """A fixed time, read in the session's time zone like the times of the tables."""
    return F.lit(at.isoformat(" ")).cast("timestamp")


def text_moment(text: str) -> datetime | None:
    """The moment of the whole seconds that a text bound, `YYYY-MM-DD` and perhaps a time, begins with; null for days that don't exist."""
    padded = text[:19] + "0000-01-01T00:00:00"[len(text[:19]) :]
    try:
        return datetime.fromisoformat(padded)
    except ValueError:
        return None


def day_start(day: date, zone: str = "UTC") -> datetime:
    """The UTC moment at which a day begins in a zone; where the clock skips midnight, its first moment."""
    local = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone))
    return local.astimezone(timezone.utc).replace(tzinfo=None)


def local_day(ts: Column, zone: str = "UTC") -> Column:
    """The day in a zone, daylight saving included."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def on_days(ts: Column, first: date, last: date, zone: str = "UTC") -> Column:
    """From the first moment of a day to the last of another in a zone, as bounds of UTC that reach the scan."""
    return (ts >= moment(day_start(first, zone))) & (ts < moment(day_start(last + timedelta(days=1), zone)))


def iso_week(ts: Column) -> Column:
    """`2026-W01`: the year is the one that the week belongs to."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def iso_monday(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def week_bounds(week: str) -> tuple[datetime, datetime] | None:
    """Monday and next Monday of `YYYY-Www`; weeks 1 to 53 are accepted in any year."""
    m = re.fullmatch(r"(\d{4})-W(\d{2})", week)
    if not m or not 1 <= int(m[2]) <= 53:
        return None
    fourth = date(int(m[1]), 1, 4)  # always in week 1
    start = fourth - timedelta(days=fourth.weekday()) + timedelta(weeks=int(m[2]) - 1)
    begin = datetime(start.year, start.month, start.day)
    return begin, begin + timedelta(days=7)


def rolling_start(period: str, as_of: datetime) -> datetime | None:
    """So many times 24 hours before as_of; an unknown period has no start."""
    days = PERIOD_DAYS.get(period)
    return as_of - timedelta(days=days) if days else None


def midnight_start(period: str, as_of: datetime, zone: str = "UTC") -> datetime | None:
    """Midnight in a zone so many days before as_of; `today` is today's midnight."""
    days = {"today": 0, **PERIOD_DAYS}.get(period)
    today = as_of.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).date()
    return day_start(today - timedelta(days=days), zone) if days is not None else None


def in_period(ts: Column, period: str, as_of: datetime, rolling: bool = True, zone: str = "UTC") -> Column:
    """An ISO week is half open; other periods have only a start. Weeks and midnights are those of a zone."""
    week = week_bounds(period)
    if week:
        return on_days(ts, week[0].date(), week[1].date() - timedelta(days=1), zone)
    start = rolling_start(period, as_of) if rolling else midnight_start(period, as_of, zone)
    return F.lit(True) if start is None else ts >= moment(start)


def bucket_key(ts: Column, period: str) -> Column:
    """Days for 7d and 30d, ISO weeks for 90d, months otherwise."""
    if period in ("7d", "30d"):
        return F.date_format(ts, "yyyy-MM-dd")
    return iso_week(ts) if period == "90d" else F.date_format(ts, "yyyy-MM")


def calendar(spark: SparkSession, period: str, as_of: datetime) -> DataFrame:
    """bucket: the 7 or 30 last days, 13 ISO weeks or 12 months up to as_of."""
    today = as_of.date()
    first, step = {"7d": (today - timedelta(days=6), "1 DAY"), "30d": (today - timedelta(days=29), "1 DAY"), "90d": (today - timedelta(weeks=12), "7 DAY")}.get(period, (None, None))
    if first is None:
        months = today.year * 12 + today.month - 12
        first, step, today = date(months // 12, months % 12 + 1, 1), "1 MONTH", today.replace(day=1)
    days = spark.range(1).select(F.explode(F.expr(f"sequence(DATE '{first}', DATE '{today}', INTERVAL {step})")).alias("day"))
    return days.select(bucket_key(F.col("day"), period).alias("bucket"))


def minutes_between(start: Column, end: Column, clamp: bool = True) -> Column:
    minutes = (F.unix_micros(end) - F.unix_micros(start)) / 60_000_000
    return F.greatest(F.lit(0.0), minutes) if clamp else minutes


def retry_delay(attempt: Column) -> Column:
    """Seconds before a retry; the last step repeats."""
    steps = F.array(*[F.lit(s) for s in RETRY_SECONDS])
    return F.element_at(steps, F.least(F.greatest(attempt, F.lit(1)), F.lit(len(RETRY_SECONDS))).cast("int"))


def format_minutes(minutes: Column) -> Column:
    """`45m`, `1h 30m`, `2h`."""
    h, m = F.floor(minutes / 60), minutes % 60
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(h.cast("string"), F.lit("h"), F.when(m > 0, F.concat(F.lit(" "), m.cast("string"), F.lit("m"))).otherwise("")))


def format_duration(start: Column, end: Column) -> Column:
    """`<1m`, `45m`, `5h 23m`, `1d 2h`."""
    total = F.floor(minutes_between(start, end, clamp=False) + 0.5)
    days, hours = F.floor(total / 1440), F.floor(total / 60) % 24
    long = F.concat(days.cast("string"), F.lit("d"), F.when(hours > 0, F.concat(F.lit(" "), hours.cast("string"), F.lit("h"))).otherwise(""))
    return F.when(total < 1, "<1m").when(total < 1440, format_minutes(total)).otherwise(long)


def is_calendar_date(text: Column) -> Column:
    """`YYYY-MM-DD` of a day that exists."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
