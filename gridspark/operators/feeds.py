"""Feed refreshes: a decoded feed is patched onto the hourly frame and its gaps are filled.

Each takes the frame and the feed rows and returns the frame with the refreshed columns.
`series` names the columns that tell one frame series from another (none for one frame).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import production_share
from ..session import materialize
from .asof import asof_backward, daily_to_hourly
from .buckets import as_list
from .fill import between_neighbours, fill_edges, forward_fill, interpolate, with_neighbours
from .interval import available_capacity
from .patch import (
    best_source,
    choose_by_time,
    dedup,
    patch,
    primary_or_backup,
    replace_feed,
    stack_sources,
    union_keep_last,
    wide_by_location,
)
from .rollup import across_locations, daily_place_quantiles, hourly_mean, total_capacity
from .spine import complete_grid, densify


def _keyed(df: DataFrame, series: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Fills need a series column; a single frame gets a constant one."""
    if series:
        return df, list(series)
    return df.withColumn("_one", F.lit(0)), ["_one"]


def station_series(
    frame: DataFrame,
    forecast: DataFrame,
    history: DataFrame,
    column: str,
    series,
    *,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Forecast and history of a station, each interpolated by row position, the forecast
    first where both have the hour; stored values win over the feed."""
    from .buckets import with_position

    series = as_list(series)
    filled = []
    for part in (forecast, history):
        rows = part.select(*series, ts, value)
        filled.append(interpolate(with_position(rows, series, ts, name="_pos"), value, series, ts, at="_pos").drop("_pos"))
    both = stack_sources({"forecast": filled[0], "history": filled[1]})
    feed = dedup(both, [*series, ts], "source_rank", keep="first").select(*series, ts, F.col(value).alias(column))
    return patch(frame, feed, [*series, ts], [column], prefer="old")


def nuclear(frame: DataFrame, feed: DataFrame, column: str, series=(), *, ts: str = "ts", value: str = "value") -> DataFrame:
    """Feed replaces the column as hourly means; gaps repeat the last value."""
    series = as_list(series)
    hours = hourly_mean(feed, series, ts, value).withColumnRenamed(value, column)
    out, keys = _keyed(replace_feed(frame, hours, [*series, ts], [column]), series)
    return forward_fill(out, column, keys, ts).drop("_one")


def import_capacity(frame: DataFrame, flows: DataFrame, borders: Sequence[str], *, ts: str = "ts", total: str = "import_capacity") -> DataFrame:
    """Border columns and their total, edges filled."""
    wide = total_capacity(flows, borders, ts).withColumnRenamed("total", total)
    out, keys = _keyed(replace_feed(frame, wide, ts, [*borders, total]), [])
    return fill_edges(out, [*borders, total], keys, ts).drop("_one")


def import_capacity_with_backup(frame: DataFrame, primary: DataFrame, backup: DataFrame, column: str, *, ts: str = "ts", value: str = "value") -> DataFrame:
    both = primary_or_backup(primary, backup, ts, value).withColumnRenamed(value, column)
    out, keys = _keyed(replace_feed(frame, both, ts, [column]), [])
    return fill_edges(out, column, keys, ts).drop("_one")


def combine_history_forecast(history: DataFrame, forecast: DataFrame, series, ts: str = "ts", value: str = "value") -> DataFrame:
    """History first where both have the hour, missing hours inserted and interpolated."""
    series = as_list(series)
    both = stack_sources({"history": history, "forecast": forecast})
    rows = best_source(both, [*series, ts], "source_rank", value).drop("source_rank")
    return densify(rows, value, series, ts)


def location_wind(frame: DataFrame, history: DataFrame, forecast: DataFrame, locations: Sequence[str], *, location: str = "location", ts: str = "ts", value: str = "value") -> DataFrame:
    """One column per location; the feed replaces the columns.  Check the result with
    `quality.nulls_after_join`."""
    rows = combine_history_forecast(history, forecast, location, ts, value)
    wide = wide_by_location(rows, location, locations, ts, value)
    return replace_feed(frame, wide, ts, locations)


IRRADIANCE = ("sum_irradiance", "mean_irradiance", "std_irradiance", "min_irradiance", "max_irradiance")


def irradiance(frame: DataFrame, history: DataFrame, forecast: DataFrame, *, ts: str = "ts", value: str = "value") -> DataFrame:
    """Statistics across locations per hour, history first; the sum is filled both ways,
    all columns interpolated, and the sum carried forward on the frame."""
    both = stack_sources({"history": across_locations(history, ts, value, "irradiance"), "forecast": across_locations(forecast, ts, value, "irradiance")})
    rows = dedup(both, ts, "source_rank", keep="first").select(ts, *IRRADIANCE).withColumn("_one", F.lit(0))
    # Written once, so that the two fills that follow do not roll up the feed again.
    rows = materialize(complete_grid(rows, "_one", ts), "irradiance")
    # One pass finds the neighbours of all columns; the sum takes the next known value,
    # the others the line between both.
    near = with_neighbours(rows, IRRADIANCE, "_one", ts)
    filled = {c: between_neighbours(c) for c in IRRADIANCE[1:]}
    total = IRRADIANCE[0]
    filled[total] = F.coalesce(total, F.col(f"_next_{total}.y"), F.col(f"_prev_{total}.y"))
    rows = near.withColumns(filled).select("_one", ts, *IRRADIANCE)
    out, keys = _keyed(replace_feed(frame, rows.drop("_one"), ts, list(IRRADIANCE)), [])
    return forward_fill(out, "sum_irradiance", keys, ts).drop("_one")


def outage_capacity(frame: DataFrame, outages: DataFrame, column: str, now, *, ts: str = "ts") -> DataFrame:
    """Available capacity per frame hour from the open outages; the new value wins."""
    grid = frame.select(ts).distinct()
    cap = available_capacity(grid, outages, ts=ts).select(ts, F.col("capacity").alias(column))
    return patch(frame, cap, ts, [column], prefer="new")


def spot_price(
    frame: DataFrame, feed: DataFrame, column: str, series=(), *, ts: str = "ts", cubic: bool = True, order: str | None = None
) -> DataFrame:
    """Stored prices win, the feed fills, then the gaps between known prices are
    interpolated (cubic by default, linear otherwise).  Of repeated feed times the last by
    the feed's column `order` counts."""
    from .cubic import cubic_interpolate

    series = as_list(series)
    out, keys = _keyed(patch(frame, feed, [*series, ts], [column], prefer="old", order=order), series)
    out = cubic_interpolate(out, column, keys, ts) if cubic else interpolate(out, column, keys, ts)
    return out.drop("_one")


def holidays(frame: DataFrame, hours: DataFrame, *, ts: str = "ts", column: str = "holiday") -> DataFrame:
    """Existing kind kept, else the calendar's, else zero; integer."""
    out = patch(frame, hours.select(ts, column), ts, [column], prefer="old")
    return out.withColumn(column, F.coalesce(F.col(column), F.lit(0)).cast("int"))


def hydrology(frame: DataFrame, rows: DataFrame, *, start, end, ts: str = "ts", prefix: str = "hydro") -> DataFrame:
    """Daily median and lower decile across places, mapped onto the hours of the day; the
    new value wins."""
    daily = daily_place_quantiles(rows, "place", ts, start=start, end=end)
    daily = daily.select(F.to_date(ts).alias("date"), F.col("median").alias(f"{prefix}_median"), F.col("p10").alias(f"{prefix}_p10"))
    cols = [f"{prefix}_median", f"{prefix}_p10"]
    hours = frame.select(ts).distinct().withColumn("date", F.to_date(ts)).join(daily, "date", "left").drop("date")
    return patch(frame, hours, ts, cols, prefer="new")


def hydrology_backfill(store: DataFrame, daily: DataFrame, columns: Sequence[str], *, start, end, ts: str = "ts") -> DataFrame:
    """Batch of hourly values for the stored hours of the range: the last accepted daily
    value at or before the hour.  Apply it with `sinks.store.update_existing`."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    hours = store.where(F.col(ts).between(lo, hi)).select(ts).withColumn("_one", F.lit(0))
    for c in columns:
        side = daily.select(F.lit(0).alias("_one"), ts, c)
        hours = asof_backward(hours, side, "_one", ts, c).drop("matched_ts")
    return hours.drop("_one")


def wind_power(
    frame: DataFrame,
    real: DataFrame,
    forecast: DataFrame,
    capacity: DataFrame,
    now,
    predict_share=None,
    *,
    ts: str = "ts",
    column: str = "wind",
    capacity_column: str = "wind_capacity",
) -> DataFrame:
    """Readings up to now, forecast after; capacity filled at both ends; hours that have
    neither get the model's capacity share times capacity.

    `predict_share` maps a frame to the same frame with a column `share`; it sees only the
    rows without a value.
    """
    out = frame.drop(column, capacity_column)
    for name, feed in (("_real", real), ("_fc", forecast), (capacity_column, capacity)):
        out = out.join(hourly_mean(feed, [], ts, "value").withColumnRenamed("value", name), ts, "left")
    out = out.withColumn(column, choose_by_time(F.col("_real"), F.col("_fc"), F.col(ts), now)).drop("_real", "_fc")
    out, keys = _keyed(out, [])
    out = fill_edges(out, capacity_column, keys, ts).drop("_one")
    if predict_share is None:
        return out
    gaps = predict_share(out.where(F.col(column).isNull())).select(ts, F.col("share").alias("_share"))
    out = out.join(gaps, ts, "left")
    return out.withColumn(column, F.coalesce(F.col(column), F.col("_share") * F.col(capacity_column))).drop("_share")


def production_training_rows(store: DataFrame, fresh: DataFrame, features: Sequence[str], *, ts: str = "ts", wind: str = "wind", capacity: str = "wind_capacity") -> DataFrame:
    """Store and fresh rows (fresh wins), capacity carried forward, target as share of
    capacity, complete rows only."""
    rows, keys = _keyed(union_keep_last(store, fresh, ts), [])
    rows = forward_fill(rows, capacity, keys, ts).drop("_one")
    rows = rows.withColumn("share", production_share(wind, capacity))
    return rows.dropna("any", subset=["share", *features])


def volatility_to_hours(hours: DataFrame, daily: DataFrame, column: str, *, ts: str = "ts") -> DataFrame:
    """Daily likelihood mapped onto the hours of its UTC date."""
    one = hours.withColumn("_one", F.lit(0))
    side = daily.select(F.lit(0).alias("_one"), "date", column)
    return daily_to_hourly(one, side, "_one", ts, column).drop("_one")


