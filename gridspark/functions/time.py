"""Time columns.  Storage is UTC; three kinds of day exist and are never mixed:
the UTC date, the local calendar date, and the electricity day (01:00 to 01:00 local)."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Market time zone, hour of price publication, search horizon bounds.
MARKET_TZ = "Europe/Helsinki"
PUBLICATION_HOUR = 14
DEFAULT_LOOKAHEAD_DAYS = 4
MIN_LOOKAHEAD_DAYS = 1
MAX_LOOKAHEAD_DAYS = 7
MAX_LOOKAHEAD_HOURS = 168


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def floor_hour(ts: Column | str) -> Column:
    return F.date_trunc("hour", _c(ts))


def ceil_hour(ts: Column | str) -> Column:
    return F.date_trunc("hour", _c(ts) + F.expr("INTERVAL '3599.999999' SECOND"))


def floor_day(ts: Column | str) -> Column:
    return F.date_trunc("day", _c(ts))


def utc_date(ts: Column | str) -> Column:
    return F.to_date(_c(ts))


def local_time(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    """Wall time; ambiguous in the autumn hour, so never use it as a key."""
    return F.from_utc_timestamp(_c(ts), tz)


def local_date(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    return F.to_date(local_time(ts, tz))


def local_hour(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    return F.hour(local_time(ts, tz))


def local_midnight(day: Column | str, tz: str = MARKET_TZ) -> Column:
    """UTC instant at which the local date begins."""
    return F.to_utc_timestamp(_c(day).cast("timestamp"), tz)


def local_noon(day: Column | str, tz: str = MARKET_TZ) -> Column:
    """Twelve elapsed hours after local midnight."""
    return local_midnight(day, tz) + F.expr("INTERVAL 12 HOURS")


def local_offset_iso(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    """ISO text with the local UTC offset, unique even in the repeated autumn hour."""
    wall = local_time(ts, tz)
    minutes = ((F.unix_seconds(wall) - F.unix_seconds(_c(ts))) / 60).cast("int")
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(
        F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"),
        F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60),
    )


def electricity_day(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    return F.to_date(F.from_utc_timestamp(_c(ts) - F.expr("INTERVAL 1 HOUR"), tz))


def electricity_day_start(day: Column | str, tz: str = MARKET_TZ) -> Column:
    return local_midnight(day, tz) + F.expr("INTERVAL 1 HOUR")


def electricity_day_end(day: Column | str, tz: str = MARKET_TZ) -> Column:
    return local_midnight(F.date_add(_c(day), 1), tz) + F.expr("INTERVAL 1 HOUR")


def iso_weekday(ts: Column | str) -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(_c(ts)) + 1


def cyclic_time(df, ts: str = "ts"):
    """Calendar parts and their sine/cosine encodings, on UTC fields."""
    day, hour = iso_weekday(ts), F.hour(ts)
    tau = 2.0 * math.pi
    return df.withColumns(
        {
            "day_of_week": day,
            "hour": hour,
            "year": F.year(ts),
            "day_of_week_sin": F.sin(F.lit(tau) * day / 7),
            "day_of_week_cos": F.cos(F.lit(tau) * day / 7),
            "hour_sin": F.sin(F.lit(tau) * hour / 24),
            "hour_cos": F.cos(F.lit(tau) * hour / 24),
        }
    )


def epoch_ms(ts: Column | str) -> Column:
    return F.unix_millis(_c(ts))


def from_epoch_ms(ms: Column | str) -> Column:
    return F.timestamp_millis(_c(ms))


def parse_utc(text: Column | str) -> Column:
    """Epoch milliseconds or ISO text; a missing offset means UTC; bad text gives null."""
    text = _c(text).cast("string")
    return F.coalesce(
        F.timestamp_millis(text.try_cast("bigint")),
        F.try_to_timestamp(text),
    )


def utc_iso(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def publication_cutoff(run: Column | str, tz: str = MARKET_TZ) -> Column:
    """Last local delivery date whose prices were already public when the run started."""
    return F.date_add(local_date(run, tz), (local_hour(run, tz) >= PUBLICATION_HOUR).cast("int"))


def is_true_forecast(run: Column | str, ts: Column | str, tz: str = MARKET_TZ) -> Column:
    return local_date(ts, tz) > publication_cutoff(run, tz)


def risk_start(now: Column | str, tz: str = MARKET_TZ) -> Column:
    """First instant of the still unknown electricity day, as a column."""
    up = ceil_hour(now)
    days = F.when(local_hour(up, tz) < PUBLICATION_HOUR, 1).otherwise(2)
    wall = F.date_add(local_date(up, tz), days).cast("timestamp") + F.expr("INTERVAL 1 HOUR")
    return F.to_utc_timestamp(wall, tz)


def weekday_name(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "EEEE")


def month_name(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "MMMM")


def start_hour_mask(hour: Column, start: int | None, end: int | None) -> Column | None:
    """Inclusive hour range that may wrap midnight; the full day means no mask."""
    start, end = clamp_hour(start), clamp_hour(end, default=23)
    if (start, end) == (0, 23):
        return None
    if start <= end:
        return hour.between(start, end)
    return (hour >= start) | (hour <= end)


# Driver-side scalars: one value per query, never per row.


def clamp_hour(hour: float | None, default: int = 0) -> int:
    if hour is None or not math.isfinite(hour):
        return default
    return int(min(max(hour, 0), 23))


def clamp_lookahead_days(days: float | None) -> int:
    if days is None or not math.isfinite(days):
        return DEFAULT_LOOKAHEAD_DAYS
    return int(min(max(math.floor(days + 0.5), MIN_LOOKAHEAD_DAYS), MAX_LOOKAHEAD_DAYS))


def lookahead_hours(local_hour_now: int, days: float | None) -> int:
    left_today = max(24 - (local_hour_now + 1), 0)
    return min(max(left_today + 24 * clamp_lookahead_days(days), 1), MAX_LOOKAHEAD_HOURS)


def lookahead_hours_col(hour: Column, days: float | None) -> Column:
    total = F.greatest(F.lit(23) - hour, F.lit(0)) + 24 * clamp_lookahead_days(days)
    return F.least(F.greatest(total, F.lit(1)), F.lit(MAX_LOOKAHEAD_HOURS))


def local_midnight_utc(day: date, tz: str = MARKET_TZ) -> datetime:
    wall = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(tz))
    return wall.astimezone(timezone.utc)


def start_of_yesterday(now: datetime, tz: str = MARKET_TZ) -> datetime:
    """UTC bound of the local day before `now`; a literal, so scans can push it down."""
    return local_midnight_utc(now.astimezone(ZoneInfo(tz)).date() - timedelta(days=1), tz)
