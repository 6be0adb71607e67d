"""Ordered operators on an hourly series: moving averages, best windows, islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import (
    MARKET_TZ,
    local_date,
    local_hour,
    lookahead_hours_col,
    start_hour_mask,
)
from .buckets import (
    BUCKET,
    DEFAULT_BUCKET,
    as_list,
    bucket_of,
    hour_index,
    in_order,
    inside,
    interval,
    salted_join,
    with_carry,
    with_halo,
    with_position,
)

BLOCK = 720


def moving_average(df: DataFrame, n: int, series, ts: str = "ts", value: str = "value", *, block: int = BLOCK) -> DataFrame:
    """Mean of the last n rows, fewer at the start.  Rows are cut into position blocks;
    each block also sees the n - 1 rows before it."""
    series = as_list(series)
    if n <= 1:
        return df.withColumn("moving_average", F.col(value))
    block = max(block, n)
    b = with_halo(with_position(df, series, ts), "pos", block, before=n - 1)
    w = Window.partitionBy(*series, "_block").orderBy("pos").rowsBetween(-(n - 1), 0)
    out = b.withColumn("moving_average", F.avg(value).over(w)).where("_own")
    return out.select(*df.columns, "moving_average")


def contiguous_windows(
    df: DataFrame, hours: int | Sequence[int], series, ts: str = "ts", value: str = "value", *, block: int = BLOCK
) -> DataFrame:
    """Every run of h finite rows exactly one hour apart, for each wanted h: start, end,
    average.

    Blocks of the hour index overlap by the longest run, so each start hour is evaluated
    once, in the block that owns it, and one shuffle serves all lengths.
    """
    series = as_list(series)
    lengths = [hours] if isinstance(hours, int) else list(hours)
    longest = max(lengths)
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    b = df.where(ok).select(*series, ts, value).withColumn("_i", hour_index(ts))
    b = with_halo(b, "_i", max(block, longest), after=longest - 1)
    order = Window.partitionBy(*series, "_block").orderBy(ts)
    b = b.withColumn("_even", F.abs(F.unix_seconds(F.lead(ts).over(order)) - F.unix_seconds(ts) - 3600) <= 1)
    found = {}
    for h in lengths:
        span = order.rowsBetween(0, h - 1)
        whole = F.count(F.lit(1)).over(span) == h
        if h > 1:
            whole = whole & F.every("_even").over(order.rowsBetween(0, h - 2))
        found[f"_w{h}"] = F.when(whole, F.avg(value).over(span))
    b = b.withColumns(found).where("_own")
    rows = F.array(*[F.struct(F.lit(h).alias("hours"), F.col(f"_w{h}").alias("average")) for h in lengths])
    every = b.select(*series, F.col(ts).alias("start"), F.inline(rows)).where("average IS NOT NULL")
    return every.select(
        *series,
        "hours",
        "start",
        F.timestamp_seconds(F.unix_seconds("start") + F.col("hours") * 3600).alias("end"),
        "average",
    )


def cheapest_windows(
    df: DataFrame,
    now: Column | None,
    series,
    ts: str = "ts",
    value: str = "value",
    *,
    durations: Sequence[int] = (3, 6, 12),
    lookahead_days: float | None = None,
    start_hour: int | None = None,
    end_hour: int | None = None,
    tz: str = MARKET_TZ,
    digits: int | None = None,
) -> DataFrame:
    """Cheapest contiguous stretch of each duration per series, earliest on ties.

    With `now`, a window may begin up to hours - 1 before the current hour, must end by
    the lookahead limit, and windows that end after now are preferred over the others.
    """
    series = as_list(series)
    every = contiguous_windows(df, durations, series, ts, value)
    mask = start_hour_mask(local_hour("start", tz), start_hour, end_hour)
    if mask is not None:
        every = every.where(mask)
    if now is not None:
        anchor = F.date_trunc("hour", now)
        limit = F.timestamp_seconds(
            F.unix_seconds(anchor) + 3600 * lookahead_hours_col(local_hour(now, tz), lookahead_days)
        )
        earliest = F.timestamp_seconds(F.unix_seconds(anchor) - 3600 * (F.col("hours") - 1))
        every = every.where((F.col("start") >= earliest) & (F.col("end") <= limit))
        late = (F.col("end") < now).cast("int")
    else:
        late = F.lit(0)
    score = F.col("average") if digits is None else F.round("average", digits)
    best = F.min(F.struct(late.alias("late"), score.alias("average"), "start", "end"))
    return (
        every.groupBy(*series, "hours")
        .agg(best.alias("_w"))
        .select(*series, "hours", "_w.start", "_w.end", "_w.average")
    )


def gap_islands(
    df: DataFrame, series, ts: str = "ts", *, start=None, end=None, members: DataFrame | None = None, bucket: str = DEFAULT_BUCKET
) -> DataFrame:
    """Missing stretches of hourly rows as (gap_start, gap_end, hours).

    Found between neighbouring rows, so no spine is generated; with `start`/`end` the
    stretch before the first and after the last row counts too, and series of `members`
    without any row are missing from start to end.
    """
    series = as_list(series)
    b = df.select(*series, ts).withColumn(BUCKET, bucket_of(ts, bucket))
    b = with_carry(b, series, {"_first": F.min(ts)}, {"_following": F.lead("_first").over(in_order(series))})
    nxt = F.coalesce(F.lead(ts).over(inside(series, ts)), F.col("_following"))
    inner = b.withColumn("_next", nxt).where(F.col("_next") > F.col(ts) + interval(1, "HOUR"))
    gaps = inner.select(
        *series,
        (F.col(ts) + interval(1, "HOUR")).alias("gap_start"),
        (F.col("_next") - interval(1, "HOUR")).alias("gap_end"),
    )
    if start is not None or end is not None:
        ends = df.groupBy(*series).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
        as_ts = lambda v: v if isinstance(v, Column) else F.lit(v).cast("timestamp")
        if start is not None:
            lead = ends.where(F.col("_lo") > as_ts(start))
            gaps = gaps.unionByName(
                lead.select(*series, as_ts(start).alias("gap_start"), (F.col("_lo") - interval(1, "HOUR")).alias("gap_end"))
            )
        if end is not None:
            trail = ends.where(F.col("_hi") < as_ts(end))
            gaps = gaps.unionByName(
                trail.select(*series, (F.col("_hi") + interval(1, "HOUR")).alias("gap_start"), as_ts(end).alias("gap_end"))
            )
        if members is not None and start is not None and end is not None:
            empty = members.select(*series).distinct().join(ends, series, "left_anti")
            gaps = gaps.unionByName(empty.select(*series, as_ts(start).alias("gap_start"), as_ts(end).alias("gap_end")))
    span = (F.unix_seconds("gap_end") - F.unix_seconds("gap_start")) / 3600 + 1
    return gaps.withColumn("hours", span.cast("long"))


def autocorrelation(df: DataFrame, residual: str, series, ts: str = "ts", *, lags: int = 6, block: int = BLOCK) -> DataFrame:
    """Durbin-Watson statistic and biased, demeaned autocorrelations, one row per series.

    Lagged products are formed inside position blocks that see `lags` rows of the block
    before; everything else is a partial aggregate.
    """
    series = as_list(series)
    rows = df.where(F.col(residual).isNotNull()).select(*series, ts, residual)
    mean = rows.groupBy(*series).agg(F.avg(residual).alias("_m"))
    b = with_halo(with_position(rows, series, ts), "pos", max(block, lags), before=lags)
    order = Window.partitionBy(*series, "_block").orderBy("pos")
    lagged = {f"_l{k}": F.lag(residual, k).over(order) for k in range(1, lags + 1)}
    b = salted_join(b.withColumns(lagged).where("_own"), mean, series)
    e, m = F.col(residual), F.col("_m")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("_ee"),
        F.sum((e - F.col("_l1")) * (e - F.col("_l1"))).alias("_dd"),
        F.sum((e - m) * (e - m)).alias("_c0"),
    ]
    aggs += [F.coalesce(F.sum((e - m) * (F.col(f"_l{k}") - m)), F.lit(0.0)).alias(f"_c{k}") for k in range(1, lags + 1)]
    s = b.groupBy(*series).agg(*aggs)
    return s.select(
        *series,
        "n",
        F.try_divide("_dd", "_ee").alias("durbin_watson"),
        *[F.try_divide(f"_c{k}", "_c0").alias(f"acf_{k}") for k in range(1, lags + 1)],
    )


def calendar_matrix(
    df: DataFrame, series=(), ts: str = "ts", value: str = "value", *, now: Column | None = None, tz: str = MARKET_TZ
) -> DataFrame:
    """Local day by hour of day.  In the 25-hour day the later of the two equal hours is
    primary and both stay as detail; the skipped hour of the 23-hour day is empty.  Hours
    before the current one show no price.  A cell holds at most two rows."""
    series = as_list(series)
    cell = df.where(F.col(value).isNotNull()).groupBy(
        *series, local_date(ts, tz).alias("local_date"), local_hour(ts, tz).alias("hour")
    )
    seen = cell.agg(
        F.max_by(value, ts).alias("price"),
        F.max(ts).alias("at"),
        F.count(F.lit(1)).alias("n"),
        F.min_by(value, ts).alias("earlier_price"),
    )
    days = df.where(F.col(value).isNotNull())
    span = days.groupBy(*series).agg(
        (F.min(local_date(ts, tz)) if now is None else F.min(local_date(now, tz))).alias("_d0"),
        F.max(local_date(ts, tz)).alias("_d1"),
    )
    slots = (
        span.select(*series, F.explode(F.sequence("_d0", F.greatest("_d0", "_d1"))).alias("local_date"))
        .repartition(*[F.col(c) for c in series], "local_date")
        .select(*series, "local_date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    )
    out = slots.join(seen, [*series, "local_date", "hour"], "left")
    price = F.col("price") if now is None else F.when(F.col("at") >= F.date_trunc("hour", now), F.col("price"))
    return out.select(
        *series,
        "local_date",
        "hour",
        price.alias("price"),
        "at",
        F.when(F.col("n") > 1, F.col("earlier_price")).alias("earlier_price"),
    )


def calendar_wide(matrix: DataFrame, series=()) -> DataFrame:
    """One row per local day, columns h00 … h23."""
    hours = [f"h{h:02d}" for h in range(24)]
    named = matrix.withColumn("_h", F.format_string("h%02d", F.col("hour")))
    return named.groupBy(*as_list(series), "local_date").pivot("_h", hours).agg(F.first("price"))


def horizon_prune(df: DataFrame, hours: int | None, run="run_id", ts: str = "ts") -> DataFrame:
    """Rows less than `hours` after the first timestamp of their run; None keeps all."""
    if hours is None:
        return df
    keys = as_list(run)
    first = df.groupBy(*keys).agg(F.min(ts).alias("_t0"))
    return salted_join(df, first, keys).where(F.col(ts) < F.col("_t0") + interval(hours, "HOUR")).select(*df.columns)


def lead_time_cut(df: DataFrame, snapshot_date: str = "snapshot_date", ts: str = "ts", days: int = 2) -> DataFrame:
    bound = F.date_add(F.col(snapshot_date).cast("date"), days).cast("timestamp")
    return df.where(F.col(ts) >= bound)
