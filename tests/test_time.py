"""Day kinds, publication rule and masks, at the clock changes of 2025."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from gridspark.functions import time as T


def one(df, col):
    return df.select(col.cast("string").alias("c")).first()["c"]


@pytest.mark.parametrize(
    "ts, day, start, end, hours",
    [
        ("2025-03-30 12:00:00", "2025-03-30", "2025-03-29 23:00:00", "2025-03-30 22:00:00", 23),
        ("2025-10-26 12:00:00", "2025-10-26", "2025-10-25 22:00:00", "2025-10-26 23:00:00", 25),
        ("2025-01-14 22:59:59", "2025-01-14", "2025-01-13 23:00:00", "2025-01-14 23:00:00", 24),
        ("2025-01-14 23:00:00", "2025-01-15", "2025-01-14 23:00:00", "2025-01-15 23:00:00", 24),
    ],
)
def test_electricity_day(frame, ts, day, start, end, hours):
    df = frame([(ts,)], "ts timestamp").withColumn("d", T.electricity_day("ts"))
    assert one(df, F.col("d")) == day
    assert one(df, T.electricity_day_start("d")) == start
    assert one(df, T.electricity_day_end("d")) == end
    span = F.unix_seconds(T.electricity_day_end("d")) - F.unix_seconds(T.electricity_day_start("d"))
    assert one(df, span) == str(hours * 3600)


def test_local_midnight_across_changes(frame):
    df = frame([("2025-03-30",), ("2025-03-31",), ("2025-10-27",)], "d string")
    got = [r[0] for r in df.select(T.local_midnight(F.to_date("d")).cast("string")).collect()]
    assert got == ["2025-03-29 22:00:00", "2025-03-30 21:00:00", "2025-10-26 22:00:00"]


@pytest.mark.parametrize(
    "run, ts, expected",
    [
        ("2026-07-01 10:59:00", "2026-07-01 20:59:00", False),
        ("2026-07-01 10:59:00", "2026-07-01 21:00:00", True),
        ("2026-07-01 11:00:00", "2026-07-02 20:59:00", False),
        ("2026-07-01 11:00:00", "2026-07-02 21:00:00", True),
        ("2026-01-01 11:59:00", "2026-01-01 22:00:00", True),
        ("2026-01-01 12:00:00", "2026-01-01 22:00:00", False),
    ],
)
def test_true_forecast_boundaries(frame, run, ts, expected):
    df = frame([(run, ts)], "run timestamp, ts timestamp")
    assert df.select(T.is_true_forecast("run", "ts")).first()[0] is expected


@pytest.mark.parametrize("now, start", [("2026-05-03 10:00:00", "2026-05-03 22:00:00"), ("2026-05-03 11:30:00", "2026-05-04 22:00:00")])
def test_risk_start(frame, now, start):
    """13:00 local: tomorrow 01:00 local; 14:30 local: the day after."""
    assert one(frame([(now,)], "now timestamp"), T.risk_start("now")) == start


def test_start_hour_mask(frame):
    hours = frame([(h,) for h in range(24)], "h int")
    assert T.start_hour_mask(F.col("h"), 0, 23) is None
    kept = {r.h for r in hours.where(T.start_hour_mask(F.col("h"), 22, 2)).collect()}
    assert kept == {22, 23, 0, 1, 2}


def test_lookahead():
    assert T.lookahead_hours(23, None) == 96
    assert T.lookahead_hours(0, 99) == 168
    assert T.clamp_lookahead_days(0) == 1
    assert T.clamp_lookahead_days(float("nan")) == 4
    assert T.clamp_hour(31) == 23


def test_lookahead_column_equals_scalar(frame):
    hours = frame([(h,) for h in range(24)], "h int")
    for days in (None, 1, 7):
        got = {r[0]: r[1] for r in hours.select("h", T.lookahead_hours_col(F.col("h"), days)).collect()}
        assert got == {h: T.lookahead_hours(h, days) for h in range(24)}


def test_start_of_yesterday():
    now = datetime(2025, 3, 31, 12, tzinfo=timezone.utc)
    assert T.start_of_yesterday(now) == datetime(2025, 3, 29, 22, tzinfo=timezone.utc)
    assert T.local_midnight_utc(date(2025, 10, 27)) == datetime(2025, 10, 26, 22, tzinfo=timezone.utc)


def test_repeated_autumn_hour_has_two_texts(frame):
    df = frame([("2025-10-26 00:30:00",), ("2025-10-26 01:30:00",)], "ts timestamp")
    got = [r[0] for r in df.select(T.local_offset_iso("ts")).collect()]
    assert got == ["2025-10-26T03:30:00+03:00", "2025-10-26T03:30:00+02:00"]


def test_parse_utc(frame):
    df = frame([("2024-01-01T00:00:00Z",), ("1704067200000",), ("2024-01-01 02:00:00+02:00",), ("2024-01-01T00:00:00",), ("soon",), (None,)], "x string")
    got = [r[0] for r in df.select(T.parse_utc("x").cast("string")).collect()]
    assert got == ["2024-01-01 00:00:00"] * 4 + [None, None]
