"""Views behind the published charts: merged prices, forecasts after the last actual,
display filters, history comparison, feature profile and brief tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import feature_group, is_finite, row_mean
from ..functions.time import MARKET_TZ, PUBLICATION_HOUR, local_date, local_hour
from .buckets import as_list, interval
from .metrics import pearson
from .patch import best_source, merge_actual_forecast, stack_sources
from .rollup import daily_brief, local_day_average_on_rows, time_bins
from .windows import cheapest_windows, horizon_prune, lead_time_cut


def finite_pairs(df: DataFrame, value: str = "value", ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts).isNotNull() & is_finite(value))


def between(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Inclusive range; either bound may be missing."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df


def forecast_after_actual(forecast: DataFrame, actual: DataFrame, now: Column, ts: str = "ts", *, strict: bool = False) -> DataFrame:
    """Forecast rows from one hour after the last actual (strict: after it), or from one
    hour after now when there are no actuals."""
    last = actual.agg(F.max(ts)).scalar()
    hour = interval(1, "HOUR")
    if strict:
        return forecast.where(F.col(ts) > F.coalesce(last, now))
    return forecast.where(F.col(ts) >= F.coalesce(last + hour, now + hour))


def display_filter(df: DataFrame, now: Column, ts: str = "ts", tz: str = MARKET_TZ) -> DataFrame:
    """Days whose prices are still unknown: not today or earlier, tomorrow only before the
    publication hour, everything later."""
    day, today = local_date(ts, tz), local_date(now, tz)
    tomorrow = F.date_add(today, 1)
    return df.where((day > tomorrow) | ((day == tomorrow) & (local_hour(now, tz) < PUBLICATION_HOUR)))


def select_price(merged: DataFrame, actual: DataFrame, forecast: DataFrame, keys, ts: str = "ts", value: str = "value") -> DataFrame:
    """Merged, then actual, then forecast price per floored hour; the first value of an
    hour counts.  One shuffle over the union of the three."""
    keys = as_list(keys)
    parts = {}
    for name, df in (("merged", merged), ("actual", actual), ("forecast", forecast)):
        hour = df.withColumn("_hour", F.date_trunc("hour", ts)).where(F.col(value).isNotNull())
        parts[name] = hour.groupBy(*keys, F.col("_hour").alias(ts)).agg(F.min_by(value, ts).alias(value))
    # The three sides are hourly by now, so the hour replaces the original timestamp.
    return best_source(stack_sources(parts), [*keys, ts], "source_rank", value).drop("source_rank")


def serving_series(actual: DataFrame, forecast: DataFrame, series, now: Column, ts: str = "ts", value: str = "value") -> DataFrame:
    """Actual prices followed by the forecast, with the electricity-day mean on each row."""
    series = as_list(series)
    after = forecast_after_actual(forecast, actual, now, ts)
    merged = merge_actual_forecast(actual, after, [*series, ts], value)
    return local_day_average_on_rows(merged, series, ts, value)


def serving_windows(actual: DataFrame, forecast: DataFrame, series, now: Column, **kw) -> DataFrame:
    """Cheapest windows over the merged series."""
    after = forecast_after_actual(forecast, actual, now, kw.get("ts", "ts"))
    merged = merge_actual_forecast(actual, after, [*as_list(series), kw.get("ts", "ts")], kw.get("value", "value"))
    return cheapest_windows(merged, now, series, **kw)


def history_comparison(
    snapshots: DataFrame, actual: DataFrame, *, keep: int = 35, horizon_hours: int | None = None, bin_hours: int = 1,
    day: str = "snapshot_date", ts: str = "ts", value: str = "value",
) -> DataFrame:
    """Past forecasts beside the actuals: the newest `keep` snapshots without the newest
    one, cut to lead times of two days and more, pruned and binned per run.  Actuals are
    binned only.  `age` ranks the snapshots, newest first; actuals have none."""
    dates = snapshots.select(day).distinct()
    ranked = dates.orderBy(F.col(day).desc()).limit(keep)
    newest = ranked.agg(F.max(day)).scalar()
    # At most `keep` dates.
    kept = snapshots.join(F.broadcast(ranked), day, "left_semi").where(F.col(day) != newest)
    pruned = horizon_prune(lead_time_cut(kept, day, ts), horizon_hours, day, ts)
    binned = time_bins(pruned, bin_hours, day, ts, value)
    ages = _ages(ranked, day)
    runs = binned.join(F.broadcast(ages), day)
    shown = time_bins(actual.select(ts, value), bin_hours, [], ts, value)
    return runs.select(F.col(day), "age", ts, value).unionByName(
        shown.select(F.lit(None).cast(runs.schema[day].dataType).alias(day), F.lit(None).cast("int").alias("age"), ts, value)
    )


def _ages(dates: DataFrame, day: str) -> DataFrame:
    """Rank by date over at most a few dozen dates."""
    listed = dates.agg(F.sort_array(F.collect_list(day), asc=False).alias("_d"))
    return listed.select(F.posexplode("_d").alias("age", day))


def brief_table(df: DataFrame, actual: str, predicted: str, wind: str, temperatures: Sequence[str], holiday: str, ts: str = "ts", tz: str = MARKET_TZ) -> DataFrame:
    """Daily brief of the complete rows, known prices in place of predictions."""
    rows = df.dropna("any", subset=[ts, predicted, wind, holiday, *temperatures])
    rows = rows.withColumns({"_price": F.coalesce(actual, predicted), "_temp": row_mean(list(temperatures))})
    return daily_brief(rows, "_price", wind, "_temp", holiday, ts, tz)


def feature_profile(df: DataFrame, features: Sequence[str], target: str, ts: str = "ts") -> DataFrame:
    """Mean, population deviation, correlation with the target, latest value and group of
    every non-constant feature, over the rows complete in all of them."""
    from ..functions.scalar import number

    rows = df.select(ts, *[number(F.col(c)).alias(c) for c in [*features, target]]).dropna("any")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(features):
        aggs += [
            F.avg(c).alias(f"_a{i}"),
            F.stddev_pop(c).alias(f"_s{i}"),
            pearson(c, target).alias(f"_r{i}"),
            F.max_by(c, ts).alias(f"_v{i}"),
        ]
    one = rows.agg(*aggs)
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"_a{i}").alias("mean"),
                F.col(f"_s{i}").alias("std"),
                F.coalesce(F.col(f"_r{i}"), F.lit(0.0)).alias("correlation"),
                F.col(f"_v{i}").alias("latest"),
            )
            for i, c in enumerate(features)
        ]
    )
    out = one.select(F.col("_n").alias("rows"), F.inline(items)).where("std > 0 AND rows >= 3")
    return out.withColumn("feature_group", feature_group("feature"))


