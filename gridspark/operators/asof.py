"""As-of lookup: the last known value at or before a timestamp."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import BUCKET, DEFAULT_BUCKET, as_list, before, bucket_of, salted_join, seconds


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    series: str | Sequence[str],
    ts: str = "ts",
    value: str = "value",
    *,
    step: str = "1 hour",
    bucket: str = DEFAULT_BUCKET,
    unique_left: bool = True,
) -> DataFrame:
    """Value of `right` at or before each row of `left`, both keyed by (series, ts).

    The right side is first reduced to one row per series and grid step: a partial
    aggregate, so a hot series or hour collapses before it is shuffled.  That is exact
    when the left timestamps lie on the grid; choose a step that divides them.  Then both sides meet in one shuffle on
    (series, bucket); older values arrive through the bucket summary.  A left side that
    repeats its keys (`unique_left=False`) is looked up per distinct key and joined back
    salted, so a hot hour does not gather its rows.
    """
    if not unique_left:
        wanted = left.select(*as_list(series), ts).distinct()
        hits = asof_backward(wanted, right, series, ts, value, step=step, bucket=bucket)
        return salted_join(left.drop(value), hits, [*as_list(series), ts])
    series, width = as_list(series), seconds(step)
    # A right row counts from the first grid step at or after it.
    grid = F.timestamp_seconds(
        F.ceil(F.unix_micros(ts) / F.lit(width * 1_000_000)) * F.lit(width)
    )
    points = (
        right.where(F.col(value).isNotNull())
        .groupBy(*series, grid.alias("_g"))
        .agg(F.max_by(value, ts).alias(value), F.max(ts).alias("_at"))
        .withColumn(BUCKET, bucket_of("_g", bucket))
    )
    tails = points.groupBy(*series, BUCKET).agg(F.max_by(F.struct(value, "_at"), "_g").alias("_tail"))
    asked = left.withColumn(BUCKET, bucket_of(ts, bucket)).withColumn("_g", F.col(ts))
    # Carry for every bucket the left side asks about, also where the right has no row.
    wanted = asked.select(*series, BUCKET).distinct().withColumn(
        "_tail", F.lit(None).cast(tails.schema["_tail"].dataType)
    )
    carry = (
        tails.unionByName(wanted)
        .groupBy(*series, BUCKET)
        .agg(F.first("_tail", ignorenulls=True).alias("_tail"))
        .select(*series, BUCKET, F.last("_tail", ignorenulls=True).over(before(series)).alias("_carry"))
    )
    marked = points.withColumn("_hit", F.struct(value, "_at")).withColumn("_side", F.lit(0)).drop(value, "_at")
    stacked = asked.withColumn("_side", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(*series, BUCKET).orderBy("_g", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = stacked.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).where("_side = 1")
    out = found.join(carry, [*series, BUCKET], "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    keep = [c for c in left.columns if c != value]
    return out.select(
        *keep, F.col(f"_hit.{value}").alias(value), F.col("_hit._at").alias("matched_ts")
    )


def daily_to_hourly(hours: DataFrame, daily: DataFrame, series, ts: str = "ts", value: str = "value") -> DataFrame:
    """Map a value keyed by UTC date onto the hours of that date."""
    series = as_list(series)
    day = daily.select(*series, F.col("date").alias("_day"), value)
    return (
        hours.withColumn("_day", F.to_date(ts)).join(day, [*series, "_day"], "left").drop("_day")
    )

