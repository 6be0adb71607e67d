"""Spike risk: top price hours of a day, wind multiplier, risk flags, price scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import RISK_MULTIPLIER_MIN, wind_multiplier
from ..functions.time import MARKET_TZ, ceil_hour, epoch_ms, local_date, local_hour, risk_start
from .buckets import as_list

# Share of a day's hours that may be flagged, and the hours of its two halves.
TOP_SHARE = 0.19
MORNING = (6, 11)
EVENING = (16, 21)
DAYTIME = (6, 21)


def top_price_hours(
    df: DataFrame, price: str, series: str | Sequence[str] = (), ts: str = "ts", tz: str = MARKET_TZ
) -> DataFrame:
    """Flag the highest-priced morning and evening hours of each local day.

    The quota is a share of the day's priced daytime hours, split evenly; a half with too
    few hours gives its remainder to the other.  Midday hours count but are never chosen.
    A local day of one series has at most 25 rows, which bounds the windows.
    """
    day = [*as_list(series), "local_date"]
    d = df.withColumns({"local_date": local_date(ts, tz), "local_hour": local_hour(ts, tz)})
    priced = F.col(price).isNotNull()
    hour = F.col("local_hour")
    half = F.when(hour.between(*MORNING), "m").when(hour.between(*EVENING), "e")
    d = d.withColumn("_half", F.when(priced, half))
    per_day = Window.partitionBy(*day)
    count = lambda test: F.count_if(test).over(per_day)
    d = d.withColumns(
        {
            "_quota": F.ceil(count(priced & hour.between(*DAYTIME)) * F.lit(TOP_SHARE)),
            "_m": count(F.col("_half") == "m"),
            "_e": count(F.col("_half") == "e"),
            "_rank": F.row_number().over(Window.partitionBy(*day, "_half").orderBy(F.col(price).desc(), ts)),
        }
    )
    each = F.ceil(F.col("_quota") / 2)
    short_m, short_e = F.col("_m") < each, F.col("_e") < each
    take_m = (
        F.when(short_m, F.col("_m"))
        .when(short_e, F.least("_m", F.col("_quota") - F.col("_e")))
        .otherwise(each)
    )
    take_e = (
        F.when(short_m, F.least("_e", F.col("_quota") - F.col("_m")))
        .when(short_e, F.col("_e"))
        .otherwise(each)
    )
    top = F.when(F.col("_half") == "m", F.col("_rank") <= take_m).when(F.col("_half") == "e", F.col("_rank") <= take_e)
    return d.withColumn("is_top_hour", F.coalesce(top, F.lit(False))).drop("_half", "_quota", "_m", "_e", "_rank")


def spike_risk(
    df: DataFrame,
    now: Column,
    *,
    price: str = "price",
    wind: str | None = "wind",
    series: str | Sequence[str] = (),
    ts: str = "ts",
    tz: str = MARKET_TZ,
) -> DataFrame:
    """Risk flag: future, priced, top hour of its day, and wind below the no-risk limit.
    Without a wind column the multiplier is one, so nothing is flagged."""
    d = top_price_hours(df, price, series, ts, tz)
    multiplier = wind_multiplier(wind) if wind and wind in df.columns else F.lit(RISK_MULTIPLIER_MIN)
    d = d.withColumns({"wind_multiplier": multiplier, "is_future": F.col(ts) >= risk_start(now, tz)})
    flag = (
        F.col("is_future")
        & F.col(price).isNotNull()
        & F.col("is_top_hour")
        & (F.col("wind_multiplier") > RISK_MULTIPLIER_MIN)
    )
    return d.withColumn("is_risk", F.coalesce(flag, F.lit(False)))


def scale_prices(df: DataFrame, now: Column, *, price: str = "price", **kw) -> DataFrame:
    """Price times multiplier on risk hours, 2 digits; null elsewhere."""
    d = spike_risk(df, now, price=price, **kw)
    return d.withColumn("price_scaled", F.when(F.col("is_risk"), F.round(F.col(price) * F.col("wind_multiplier"), 2)))


def apply_scaled(df: DataFrame, price: str = "price", scaled: str = "price_scaled") -> DataFrame:
    return df.withColumn(price, F.coalesce(scaled, price))


def risk_markers(df: DataFrame, now: Column, series: str | Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(epoch ms, scaled price or null) from the next full hour on."""
    return df.where(F.col(ts) >= ceil_hour(now)).select(
        *as_list(series), epoch_ms(ts).alias("ms"), F.col("price_scaled").alias("value")
    )


def risk_peak_per_day(
    df: DataFrame, price: str = "price", series: str | Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Hour of the highest-priced risk hour per local day (earliest on ties) and the
    surrounding hours, clamped to the day; a text line, 'none' without risk."""
    at = F.when(F.col("is_risk"), F.struct(F.col(price), -F.unix_seconds(ts)))
    out = df.groupBy(*as_list(series), "local_date").agg(F.max_by("local_hour", at).alias("peak_hour"))
    lo, hi = F.greatest(F.col("peak_hour") - 1, F.lit(0)), F.least(F.col("peak_hour") + 1, F.lit(23))
    # greatest and least skip nulls, so a day without risk must be tested first.
    line = F.when(F.col("peak_hour").isNull(), "none").otherwise(F.format_string("%d–%d", lo, hi))
    return out.withColumn("risk_text", line)
