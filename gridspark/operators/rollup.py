"""Aggregations of hourly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import (
    MARKET_TZ,
    electricity_day,
    electricity_day_end,
    electricity_day_start,

    local_date,

    local_midnight,
)
from .buckets import DEFAULT_BUCKET, as_list
from .fill import forward_fill, zero_to_last
from .quantile import exact_quantiles
from .spine import complete_grid


def hourly_mean(df: DataFrame, series, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean per series and UTC hour, present hours only."""
    series = as_list(series)
    return df.groupBy(*series, F.date_trunc("hour", ts).alias(ts)).agg(F.avg(value).alias(value))


def resample_hourly(
    df: DataFrame, series, ts: str = "ts", value: str = "value", *, bucket: str = DEFAULT_BUCKET
) -> DataFrame:
    """Hourly mean with the empty hours between a series' first and last hour as nulls."""
    return complete_grid(hourly_mean(df, series, ts, value), series, ts, bucket=bucket)


def across_locations(df: DataFrame, ts: str = "ts", value: str = "value", name: str = "value") -> DataFrame:
    """Sum, mean, sample deviation, minimum and maximum over all locations of a timestamp.
    The sum of nothing is zero, the others are null."""
    return df.groupBy(ts).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias(f"sum_{name}"),
        F.avg(value).alias(f"mean_{name}"),
        F.stddev_samp(value).alias(f"std_{name}"),
        F.min(value).alias(f"min_{name}"),
        F.max(value).alias(f"max_{name}"),
    )


def total_capacity(
    df: DataFrame, borders: Sequence[str], ts: str = "ts", border: str = "border", value: str = "value"
) -> DataFrame:
    """Border columns per timestamp and their null-skipping total; a zero total repeats
    the last non-zero one, the borders stay as they are."""
    wide = df.groupBy(ts).pivot(border, list(borders)).agg(F.first(value, ignorenulls=True))
    parts = [F.coalesce(F.col(b), F.lit(0.0)) for b in borders]
    total = wide.withColumn("total", sum(parts[1:], parts[0])).withColumn("_one", F.lit(0))
    return zero_to_last(total, "total", "_one", ts).drop("_one")


def daily_features(df: DataFrame, means: Sequence[str], flag: str | None = None, ts: str = "ts") -> DataFrame:
    """Mean and sample variance per UTC date; the flag is the day's maximum."""
    aggs = []
    for c in means:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.var_samp(c).alias(f"{c}_var")]
    if flag:
        aggs.append(F.max(flag).alias(f"{flag}_max"))
    return df.groupBy(F.to_date(ts).alias("date")).agg(*aggs)


def volatility_label(df: DataFrame, price: str = "price", ts: str = "ts", quantile: float = 0.80) -> DataFrame:
    """Days whose price variance reaches the given quantile of all days' variances.

    One row per date goes into the quantile, so plain `percentile` is bounded by the
    calendar.
    """
    daily = df.groupBy(F.to_date(ts).alias("date")).agg(F.var_samp(price).alias("price_variance"))
    limit = daily.agg(F.percentile("price_variance", F.lit(quantile))).scalar()
    return daily.withColumn("volatile", F.coalesce(F.col("price_variance") >= limit, F.lit(False)))


def next_days_mean(df: DataFrame, value: str, today_local, *, ts: str = "ts", days: int = 6) -> DataFrame:
    """Mean per UTC date, rounded to 1 digit, from the local date `today_local` on."""
    daily = df.groupBy(F.to_date(ts).alias("date")).agg(F.round(F.avg(value), 1).alias(f"{value}_mean"))
    return daily.where(F.col("date") >= F.lit(today_local).cast("date")).orderBy("date").limit(days)


def local_day_mean(df: DataFrame, value: str, series=(), ts: str = "ts", tz: str = MARKET_TZ) -> DataFrame:
    """Mean per local calendar day, with the UTC instant of its midnight."""
    series = as_list(series)
    out = df.groupBy(*series, local_date(ts, tz).alias("local_date")).agg(F.avg(value).alias(value))
    return out.withColumn("day_start", local_midnight("local_date", tz))


def daily_brief(
    df: DataFrame, price: str, wind: str, temperature: str, holiday: str, ts: str = "ts", tz: str = MARKET_TZ
) -> DataFrame:
    """Per local day: price (1 digit), wind (0 digits), mean temperature (1 digit), any
    holiday, weekday name."""
    aggs = []
    for name, col, digits in (("price", price, 1), ("wind", wind, 0)):
        aggs += [
            F.round(F.min(col), digits).alias(f"{name}_min"),
            F.round(F.max(col), digits).alias(f"{name}_max"),
            F.round(F.avg(col), digits).alias(f"{name}_mean"),
        ]
    out = df.groupBy(local_date(ts, tz).alias("local_date")).agg(
        *aggs,
        F.round(F.avg(temperature), 1).alias("temperature_mean"),
        F.bool_or(F.col(holiday) != 0).alias("holiday_any"),
    )
    return out.withColumn("weekday", F.date_format("local_date", "EEEE"))


def last_days(df: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """From `days` before the newest timestamp, inclusive."""
    bound = df.agg(F.max(ts) - F.expr(f"INTERVAL {days} DAYS")).scalar()
    return df.where(F.col(ts) >= bound)


def predicted_vs_actual_daily(df: DataFrame, actual: str, predicted: str, ts: str = "ts", days: int = 15) -> DataFrame:
    aggs = []
    for c in (predicted, actual):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    daily = last_days(df, days, ts).groupBy(F.to_date(ts).alias("date")).agg(*aggs)
    daily = daily.withColumn("error", F.col(f"{predicted}_mean") - F.col(f"{actual}_mean"))
    return daily.select("date", *[F.round(c, 1).alias(c) for c in daily.columns if c != "date"])


def row_statistics(df: DataFrame, series: str = "series_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean and variance across the series of a timestamp, on the long form."""
    return df.groupBy(ts).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def daily_place_quantiles(
    df: DataFrame,
    place: str,
    ts: str = "ts",
    value: str = "value",
    *,
    start=None,
    end=None,
    min_coverage: int | None = None,
    groups: str | Sequence[str] = (),
) -> DataFrame:
    """Median and 0.1 quantile across places per day, each place carried forward.

    A day's group holds one value per place and is not gathered, however many there are.  With `min_coverage`, days with fewer raw
    readings repeat the last accepted day.
    """
    groups = as_list(groups)
    raw = df.withColumn("_raw", F.col(value).isNotNull().cast("long"))
    grid = complete_grid(raw, [*groups, place], ts, step="1 day", end=end, bucket="365 days")
    full = forward_fill(grid, value, [*groups, place], ts, bucket="365 days")
    raw_count = F.coalesce(F.sum("_raw"), F.lit(0)).alias("coverage")
    q = exact_quantiles(full, value, [0.5, 0.1], [*groups, ts]).withColumnsRenamed({"q0": "median", "q1": "p10"})
    out = full.groupBy(*groups, ts).agg(raw_count).join(q.drop("n"), [*groups, ts], "left")
    out = out.select(*groups, ts, "median", "p10", "coverage")
    if min_coverage is not None:
        good = F.col("coverage") >= min_coverage
        out = out.withColumns({c: F.when(good, F.col(c)) for c in ("median", "p10")}).withColumn("_one", F.lit(0))
        out = forward_fill(out, ["median", "p10"], [*groups, "_one"], ts, bucket="365 days").drop("_one")
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    return out


def electricity_day_summary(df: DataFrame, metrics: dict[str, Column], series=(), ts: str = "ts", tz: str = MARKET_TZ) -> DataFrame:
    """Average, minimum and maximum of each metric per electricity day."""
    series = as_list(series)
    aggs = []
    for name, col in metrics.items():
        aggs += [F.avg(col).alias(f"{name}_avg"), F.min(col).alias(f"{name}_min"), F.max(col).alias(f"{name}_max")]
    out = df.groupBy(*series, electricity_day(ts, tz).alias("day")).agg(*aggs)
    return out.withColumns({"day_start": electricity_day_start("day", tz), "day_end": electricity_day_end("day", tz)})


def time_bins(df: DataFrame, hours: int, series=(), ts: str = "ts", value: str = "value", tz: str = MARKET_TZ) -> DataFrame:
    """Mean per local bin of `hours`; one hour or less returns the input columns."""
    series = as_list(series)
    if hours <= 1:
        return df.select(*series, ts, value)
    wall = F.from_utc_timestamp(ts, tz)
    bin_hour = (F.floor(F.hour(wall) / F.lit(hours)) * hours).cast("int")
    out = df.groupBy(*series, F.to_date(wall).alias("_d"), bin_hour.alias("_h")).agg(F.avg(value).alias(value))
    at = F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(F.col("_d").cast("timestamp")) + F.col("_h") * 3600), tz)
    return out.select(*series, at.alias(ts), value)


def local_day_average_on_rows(df: DataFrame, series, ts: str = "ts", value: str = "value", tz: str = MARKET_TZ) -> DataFrame:
    """Each row with the mean of its electricity day.  A day of an hourly series has at
    most 25 rows, which bounds the window."""
    w = Window.partitionBy(*as_list(series), electricity_day(ts, tz))
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("day_average", F.avg(value).over(w))


def delivered_day_mean(df: DataFrame, day_local, series=(), ts: str = "ts", value: str = "value", tz: str = MARKET_TZ) -> DataFrame:
    """Hourly means, then their plain mean, for one local date."""
    series = as_list(series)
    d = F.lit(day_local).cast("date") if not isinstance(day_local, Column) else day_local
    lo, hi = local_midnight(d, tz), local_midnight(F.date_add(d, 1), tz)
    hours = hourly_mean(df.where((F.col(ts) >= lo) & (F.col(ts) < hi)), series, ts, value)
    return hours.groupBy(*series).agg(F.avg(value).alias("day_mean"), F.count(value).alias("hours"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def time_bounds(df: DataFrame, now, ts: str = "ts") -> DataFrame:
    """First timestamp and the smaller of the last one and now."""
    return df.agg(F.min(ts).alias("earliest"), F.least(F.max(ts), F.lit(now).cast("timestamp")).alias("latest"))


def summaries(df: DataFrame, value: str, groups=()) -> DataFrame:
    groups = as_list(groups)
    g = df.groupBy(*groups) if groups else df.groupBy()
    return g.agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
    )


def latest_value(df: DataFrame, series, value: str = "value", ts: str = "ts") -> DataFrame:
    """Last known value and its timestamp per series."""
    seen = F.when(F.col(value).isNotNull(), F.col(ts))
    return df.groupBy(*as_list(series)).agg(F.max_by(value, seen).alias(value), F.max(seen).alias(ts))


