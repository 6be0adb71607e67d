"""Complete time grids: every step present, missing values null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import (
    BUCKET,
    DEFAULT_BUCKET,
    as_list,
    bucket_of,
    bucket_start,
    in_order,
    inside,
    interval,
    seconds,
    with_carry,
)


def _instant(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


AT_ONCE = 720  # steps that one row emits


def emit_steps(df: DataFrame, steps: Column | str, name: str) -> DataFrame:
    """Each row once for every number from 0 to `steps`, as column `name`.

    In two levels, stretches of `AT_ONCE` steps and then the steps of a stretch, so that a gap of
    many years is never one array in one row.
    """
    df = df.withColumn("_steps", F.col(steps) if isinstance(steps, str) else steps)
    df = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_steps").cast("long"), F.lit(AT_ONCE).cast("long"))))
    upto = F.least(F.col("_from") + (AT_ONCE - 1), F.col("_steps").cast("long"))
    return df.withColumn(name, F.explode(F.sequence(F.col("_from"), upto))).drop("_steps", "_from")


def spine(
    series_df: DataFrame,
    series: str | Sequence[str],
    start,
    end,
    *,
    ts: str = "ts",
    step: str = "1 hour",
    bucket: str = DEFAULT_BUCKET,
) -> DataFrame:
    """Every step from start to end (inclusive) for each row of `series_df`.

    Built in two hops: whole buckets first, spread over the cluster, then the steps
    of a bucket, so that no task generates the grid of a whole series.
    """
    series, width = as_list(series), seconds(step)
    lo, hi = _instant(start), _instant(end)
    b = series_df.select(*series, lo.alias("_lo"), hi.alias("_hi")).where("_lo <= _hi").select(
        "*", F.explode(F.sequence(bucket_of("_lo", bucket), bucket_of("_hi", bucket))).alias(BUCKET)
    )
    b = b.repartition(*[F.col(c) for c in series], BUCKET)
    # First step of the bucket that lies on the grid anchored at the range start.
    edge = F.unix_seconds(bucket_start(BUCKET, bucket))
    base = F.unix_seconds("_lo")
    first = F.greatest(base, base + F.ceil((edge - base) / F.lit(width)) * F.lit(width))
    last = F.least(F.unix_seconds("_hi"), edge + F.lit(seconds(bucket) - 1))
    return (
        b.select(*series, first.alias("_first"), last.alias("_last"))
        .where("_first <= _last")
        .select(*series, F.explode(F.sequence("_first", "_last", F.lit(width).cast("long"))).alias("_s"))
        .select(*series, F.timestamp_seconds("_s").alias(ts))
    )


def complete_grid(
    df: DataFrame,
    series: str | Sequence[str],
    ts: str = "ts",
    *,
    step: str = "1 hour",
    start=None,
    end=None,
    bucket: str = DEFAULT_BUCKET,
) -> DataFrame:
    """Insert the missing steps of each series; other columns are null there.

    `df` holds one row per (series, ts), on the grid.  Each row emits itself and the
    steps up to the next row, so there is no join against a generated spine: one
    shuffle on (series, bucket).  `start`/`end` extend every series to a common range.
    """
    series, width = as_list(series), seconds(step)
    rest = [c for c in df.columns if c not in {*series, ts}]
    b = df.withColumn(BUCKET, bucket_of(ts, bucket))
    b = with_carry(
        b,
        series,
        {"_first": F.min(ts)},
        {
            "_following": F.lead("_first").over(in_order(series)),
            "_leads": F.row_number().over(in_order(series)) == 1,
        },
    )
    following = F.coalesce(F.lead(ts).over(inside(series, ts)), F.col("_following"))
    b = b.withColumn("_next", following)
    if start is not None:
        is_head = F.col("_leads") & (F.row_number().over(inside(series, ts)) == 1)
        b = b.withColumn("_head", is_head)
    if end is not None:
        stop = F.greatest(_instant(end), F.col(ts))
    else:
        stop = F.col(ts)
    last = F.coalesce(F.col("_next") - interval(width), stop)
    stretch = lambda a, z: F.struct(a.alias("a"), z.alias("z"))
    stretches = [stretch(F.col(ts), last)]
    if start is not None:
        before = F.col("_head") & (_instant(start) < F.col(ts))
        stretches.append(F.when(before, stretch(_instant(start), F.col(ts) - interval(width))))
    b = b.withColumn("_span", F.explode(F.array_compact(F.array(*stretches))))
    micros = F.lit(width * 1_000_000)
    count = F.floor((F.unix_micros("_span.z") - F.unix_micros("_span.a")) / micros)
    out = emit_steps(b.withColumn("_count", count).where("_count >= 0"), "_count", "_k")
    out = out.withColumn("_at", F.timestamp_micros(F.unix_micros("_span.a") + F.col("_k") * micros))
    own = F.col("_at") == F.col(ts)
    return out.select(
        *series,
        F.col("_at").alias(ts),
        *[F.when(own, F.col(c)).alias(c) for c in rest],
    )


def densify(
    df: DataFrame,
    value: str,
    series: str | Sequence[str],
    ts: str = "ts",
    *,
    step: str = "1 hour",
    method: str = "linear",
    bucket: str = DEFAULT_BUCKET,
) -> DataFrame:
    """Complete grid and fill in one: every step between a series' first and last known
    value, missing ones on the line between their neighbours ("linear") or equal to the
    last known one ("forward").

    Each known point emits the steps up to the next one with their values, which saves the
    second pass that filling a completed grid would take.
    """
    series, width = as_list(series), seconds(step)
    point = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    b = df.where(F.col(value).isNotNull()).select(*series, ts, value).withColumn(BUCKET, bucket_of(ts, bucket))
    b = with_carry(
        b,
        series,
        {"_head": F.min_by(point, ts)},
        {"_following": F.lead("_head").over(in_order(series))},
    )
    order = inside(series, ts)
    b = b.withColumns(
        {
            "_nt": F.coalesce(F.lead(ts).over(order), F.col("_following.t")),
            "_nv": F.coalesce(F.lead(value).over(order), F.col("_following.v")),
        }
    )
    gap = (F.unix_seconds("_nt") - F.unix_seconds(ts)) / F.lit(float(width))
    last = F.coalesce(F.ceil(gap).cast("int") - 1, F.lit(0))
    out = emit_steps(b.withColumn("_gap", gap), last, "_k")
    filled = F.col(value)
    if method == "linear":
        line = F.col(value) + (F.col("_nv") - F.col(value)) * F.col("_k") / F.col("_gap")
        filled = F.when(F.col("_k") == 0, F.col(value)).otherwise(line)
    elif method != "forward":
        raise ValueError(f"unknown method {method!r}")
    at = F.timestamp_seconds(F.unix_seconds(ts) + F.col("_k") * F.lit(width))
    return out.select(*series, at.alias(ts), filled.alias(value))


def reindex(df: DataFrame, grid: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Values of `df` at the keys of `grid`; nulls where absent."""
    return grid.join(df, as_list(keys), "left")


def forecast_spine(keys: DataFrame, series: str | Sequence[str], now, *, ts: str = "ts", days: int = 7) -> DataFrame:
    """Existing timestamps in [now - days, now + days], plus every hour up to the last
    hour of the UTC day `now + days`.  `now` is hour-aligned."""
    series = as_list(series)
    at = _instant(now)
    recent = keys.where(F.col(ts).between(at - interval(days, "DAY"), at + interval(days, "DAY")))
    last_hour = F.date_trunc("day", at + interval(days, "DAY")) + interval(23, "HOUR")
    ahead = spine(keys.select(*series).distinct(), series, at + interval(1, "HOUR"), last_hour, ts=ts)
    return recent.select(*series, ts).unionByName(ahead).distinct()


def recent_window(df: DataFrame, now, *, ts: str = "ts", days: int = 7) -> DataFrame:
    at = _instant(now)
    return df.where(F.col(ts).between(at - interval(days, "DAY"), at + interval(days, "DAY")))


def missing_steps(df: DataFrame, grid: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Grid keys without a row."""
    keys = as_list(keys)
    return grid.join(df.select(*keys), keys, "left_anti")
