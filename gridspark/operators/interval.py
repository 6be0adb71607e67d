"""Interval joins as bucketed equi-joins on pre-aggregated sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import ceil_hour
from .buckets import as_list, interval
from .spine import emit_steps


def interval_sum(
    intervals: DataFrame,
    amount: Column,
    *,
    start: str = "start",
    end: str = "end",
    series: str | Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """Sum of `amount` over the intervals covering each full hour h, start <= h < end.

    An interval contributes to at most its own hours; the sums collapse map-side to one
    row per hour before the shuffle, so overlapping or hot hours do not pile up.
    """
    series = as_list(series)
    first = ceil_hour(start)
    last = ceil_hour(end) - interval(1, "HOUR")
    hours = intervals.withColumn("_amount", amount).where(first <= last)
    hours = hours.select(*series, "_amount", F.unix_seconds(first).alias("_first"), F.unix_seconds(last).alias("_last"))
    hours = emit_steps(hours, F.floor((F.col("_last") - F.col("_first")) / 3600), "_k")
    return (
        hours.select(*series, "_amount", F.timestamp_seconds(F.col("_first") + F.col("_k") * 3600).alias(ts))
        .groupBy(*series, ts)
        .agg(F.sum("_amount").alias("amount"))
    )


# Fixed value: installed capacity (MW) that outages are subtracted from.
INSTALLED_NUCLEAR_MW = 4372.0


def available_capacity(
    grid: DataFrame,
    outages: DataFrame,
    *,
    installed: float = INSTALLED_NUCLEAR_MW,
    ts: str = "ts",
    nominal: str = "nominal_power",
    available: str = "avail_qty",
    start: str = "start",
    end: str = "end",
    series: str | Sequence[str] = (),
) -> DataFrame:
    """Installed capacity minus what the outages take away; overlaps add, no floor."""
    series = as_list(series)
    lost = interval_sum(
        outages, F.col(nominal) - F.col(available), start=start, end=end, series=series, ts=ts
    )
    return grid.join(lost, [*series, ts], "left").withColumn(
        "capacity", F.lit(float(installed)) - F.coalesce("amount", F.lit(0.0))
    ).drop("amount")


def range_totals(
    ranges: DataFrame,
    facts: DataFrame,
    sums: dict[str, Column],
    *,
    ts: str = "ts",
    start: str = "start",
    end: str = "end",
    range_id: str = "range_id",
) -> DataFrame:
    """Sums of the facts in each [start, end] range, both ends inclusive.

    Facts are summed per timestamp and per day first.  A range takes whole days from the
    daily sums and single timestamps only for its first and last day, so the work per
    range is its number of days, not its number of rows.  Ranges without facts stay, with
    null sums.
    """
    per_ts = facts.groupBy(ts).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    per_ts = per_ts.withColumn("_day", F.to_date(ts))
    per_day = per_ts.groupBy("_day").agg(*[F.sum(n).alias(n) for n in sums])
    r = ranges.select(range_id, start, end).where(F.col(start) <= F.col(end))
    d0, d1 = F.to_date(start), F.to_date(end)
    rims = r.select(
        range_id, start, end, F.explode(F.array_distinct(F.array(d0, d1))).alias("_day")
    )
    rim_rows = rims.join(per_ts, "_day").where(F.col(ts).between(F.col(start), F.col(end)))
    whole = r.where(F.datediff(d1, d0) > 1).select(
        range_id, F.explode(F.sequence(F.date_add(d0, 1), F.date_sub(d1, 1))).alias("_day")
    )
    parts = rim_rows.select(range_id, *sums).unionByName(whole.join(per_day, "_day").select(range_id, *sums))
    totals = parts.groupBy(range_id).agg(*[F.sum(n).alias(n) for n in sums])
    return ranges.join(totals, range_id, "left")
