"""Daily weather condition and wind level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import WIND_CALM_BELOW, condition_severity, weather_condition, wind_level
from ..functions.time import MARKET_TZ, epoch_ms, local_date, local_hour, local_noon
from .buckets import as_list


def representative_condition(
    symbols: DataFrame, groups: str | Sequence[str] = (), ts: str = "ts", symbol: str = "symbol", tz: str = MARKET_TZ
) -> DataFrame:
    """Most frequent condition of the hours nearest local noon, over all stations; the
    more severe one on ties.

    Rows collapse to counts per (day, hour, condition) before anything is ordered, so the
    number of stations does not matter.
    """
    day = [*as_list(groups), "local_date"]
    counts = (
        symbols.groupBy(
            *as_list(groups),
            local_date(ts, tz).alias("local_date"),
            F.abs(local_hour(ts, tz) - 12).alias("_off"),
            weather_condition(symbol).alias("condition"),
        )
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_nearest", F.min("_off").over(Window.partitionBy(*day)))
        .where("_off = _nearest")
        .groupBy(*day, "condition")
        .agg(F.sum("_n").alias("_n"))
        .where("condition IS NOT NULL")
    )
    return counts.groupBy(*day).agg(
        F.max_by("condition", F.struct("_n", condition_severity("condition"))).alias("condition")
    )


def daily_wind_level(
    df: DataFrame, groups: str | Sequence[str] = (), ts: str = "ts", wind: str = "wind", tz: str = MARKET_TZ
) -> DataFrame:
    """calm when the lower quartile is below the calm limit, else the level of the mean.
    At most 25 hours per day and group, so `percentile` is bounded."""
    out = df.groupBy(*as_list(groups), local_date(ts, tz).alias("local_date")).agg(
        F.percentile(wind, F.lit(0.25)).alias("_q"), F.avg(wind).alias("_mean")
    )
    level = F.when(F.col("_q") < WIND_CALM_BELOW, "calm").otherwise(wind_level("_mean"))
    return out.withColumn("wind_level", level).drop("_q", "_mean")


def daily_weather(
    symbols: DataFrame,
    winds: DataFrame,
    reference: Column,
    *,
    days: int = 8,
    groups: str | Sequence[str] = (),
    ts: str = "ts",
    symbol: str = "symbol",
    wind: str = "wind",
    tz: str = MARKET_TZ,
) -> DataFrame:
    """Condition and wind level per local day in [reference, reference + days - 1]; days
    that lack one of the two are skipped.  Keyed by the UTC milliseconds of local noon."""
    first = local_date(reference, tz)
    window = lambda c: (c >= first) & (c <= F.date_add(first, days - 1))
    cond = representative_condition(symbols.where(window(local_date(ts, tz))), groups, ts, symbol, tz)
    level = daily_wind_level(winds.where(window(local_date(ts, tz))), groups, ts, wind, tz)
    keys = [*as_list(groups), "local_date"]
    out = cond.join(level.where("wind_level IS NOT NULL"), keys)
    return out.select(
        *keys, epoch_ms(local_noon("local_date", tz)).alias("noon_ms"), "condition", "wind_level"
    )
