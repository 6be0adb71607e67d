"""Data-quality checks.  A check returns the violations; an empty frame means it passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import as_list
from .patch import update_frame
from .spine import spine
from .windows import gap_islands

MAX_MISSING_HOURS = 24


class QualityError(ValueError):
    pass


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Schema check on the driver; no data is read."""
    if gone := [c for c in columns if c not in df.columns]:
        raise QualityError(f"missing required columns: {gone}")
    return df


def require_empty(violations: DataFrame, message: str) -> None:
    first = violations.take(1)
    if first:
        raise QualityError(f"{message}: {first[0].asDict()}")


def too_many_missing(df: DataFrame, value: str, series: str | Sequence[str] = (), limit: int = MAX_MISSING_HOURS) -> DataFrame:
    """Series with more than `limit` null rows on the completed grid."""
    out = df.groupBy(*as_list(series)).agg(F.count_if(F.col(value).isNull()).alias("missing"))
    return out.where(F.col("missing") > limit)


def nulls_after_join(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that still hold nulls, with their counts."""
    return null_report(df, columns).where("nulls > 0")


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count per column, long form; one scan, one row out of each task."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count(F.lit(1)).alias("_rows"))
    return counts.unpivot(["_rows"], list(columns), "column_name", "nulls").withColumnRenamed("_rows", "rows")


def coverage(df: DataFrame, columns: Sequence[str], groups: str | Sequence[str] = ()) -> DataFrame:
    """Filled share per group and column."""
    groups = as_list(groups)
    agg = df.groupBy(*groups).agg(*[F.count(c).alias(c) for c in columns], F.count(F.lit(1)).alias("expected"))
    long = agg.unpivot([*groups, "expected"], list(columns), "column_name", "filled")
    return long.withColumns(
        {
            "missing": F.col("expected") - F.col("filled"),
            "coverage": F.try_divide(F.col("filled"), F.col("expected")),
        }
    )


def negatives(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value) < 0)


def clip_negatives(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.when(F.col(value) < 0, F.lit(0.0)).otherwise(F.col(value)))


def snapshot_violations(df: DataFrame, keys: str | Sequence[str], required: Sequence[str]) -> DataFrame:
    """Null keys, null required values and repeated keys, as (violation, rows)."""
    keys = as_list(keys)
    nulls = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in [*keys, *required]],
        (F.count(F.lit(1)) == 0).cast("long").alias("empty"),
    )
    names = [f"null_{c}" for c in [*keys, *required]] + ["empty"]
    out = nulls.unpivot([], names, "violation", "rows").where("rows > 0")
    repeats = df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("rows"))
    return out.unionByName(repeats.select(F.lit("repeated_key").alias("violation"), "rows").where("rows > 0"))


STORABLE = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def require_storable(df: DataFrame) -> DataFrame:
    """Nested columns do not go into the archive."""
    nested = [f.name for f in df.schema.fields if not isinstance(f.dataType, STORABLE)]
    if nested:
        raise QualityError(f"unsupported column types: {nested}")
    return df


# Fixed value: an outage longer than six months at zero power is taken for an error.
LONG_OUTAGE_HOURS = 4320


def outage_hours(start: str = "start", end: str = "end") -> Column:
    return (F.unix_seconds(end) - F.unix_seconds(start)) / F.lit(3600.0)


def anomalous_outages(df: DataFrame, *, start: str = "start", end: str = "end", available: str = "avail_qty") -> DataFrame:
    return df.withColumn("outage_hours", outage_hours(start, end)).where(
        (F.col("outage_hours") > LONG_OUTAGE_HOURS) & (F.col(available) == 0)
    )


def gap_plan(
    store: DataFrame,
    candidates: DataFrame,
    series: str | Sequence[str],
    columns: Sequence[str],
    start: Column,
    end: Column,
    now: Column,
    ts: str = "ts",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Backfill plan over the hourly index of [start, min(end, now)].

    Returns (updates, ranges, summary): candidate rows for incomplete hours, the missing
    stretches, and per series and column the expected, missing, filled and remaining hours.
    Nothing is written; apply the updates with a null-skipping upsert.
    """
    series, columns = as_list(series), list(columns)
    stop = F.least(end, F.date_trunc("hour", now))
    grid = spine(store.select(*series).distinct(), series, start, stop, ts=ts)
    held = store.select(*series, ts, *columns).where(F.col(ts).between(start, stop))
    slice_ = grid.join(held, [*series, ts], "left")
    hole = F.lit(False)
    for c in columns:
        hole = hole | F.col(c).isNull()
    fresh = candidates.select(*series, ts, *columns).where(F.col(ts).between(start, stop))
    updates = fresh.join(slice_.where(hole).select(*series, ts), [*series, ts], "left_semi").dropna(
        "all", subset=columns
    )
    complete = slice_.where(~hole)
    ranges = gap_islands(complete, series, ts, start=start, end=stop, members=store)
    merged = update_frame(slice_, fresh, [*series, ts])
    before = coverage(slice_, columns, series).select(*series, "column_name", "expected", F.col("missing").alias("missing_before"))
    after = coverage(merged, columns, series).select(*series, "column_name", F.col("missing").alias("remaining"))
    summary = before.join(after, [*series, "column_name"]).withColumn(
        "filled", F.col("missing_before") - F.col("remaining")
    )
    return updates, ranges, summary


def sample_windows(earliest, latest, days: int, samples: int, seed: int) -> list[tuple]:
    """Seeded audit windows on the hour; driver-side, one pair per sample."""
    import random
    from datetime import timedelta

    span = timedelta(days=days)
    if span <= timedelta(0):
        raise QualityError("the window must be positive")
    if earliest + span > latest:
        return [(earliest, latest)]
    rng, out = random.Random(seed), []
    room = int((latest - span - earliest).total_seconds() // 3600)
    for _ in range(samples):
        begin = earliest + timedelta(hours=rng.randint(0, room))
        out.append((begin, begin + span))
    return out


def window_audit(df: DataFrame, windows: DataFrame, series: str | Sequence[str], columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """Expected, missing and coverage per series and column over audit windows, with the
    per-series and overall totals of a roll-up.

    `windows` has (window_id, start, end) and is driver-made, a handful of rows; expected
    hours follow from the windows, present values from one pass over the facts.
    """
    series, columns = as_list(series), list(columns)
    hours = windows.select(
        "window_id", F.explode(F.sequence(F.col("start"), F.col("end"), F.expr("INTERVAL 1 HOUR"))).alias(ts)
    )
    n_expected = hours.agg(F.count(F.lit(1))).scalar()
    weights = hours.groupBy(ts).agg(F.count(F.lit(1)).alias("_w"))
    # Spark broadcasts the hours of the windows if they are few.
    held = df.join(weights, ts).groupBy(*series).agg(
        *[F.sum(F.when(F.col(c).isNotNull(), F.col("_w"))).alias(c) for c in columns]
    )
    every = df.select(*series).distinct().join(held, series, "left")
    long = every.unpivot(series, columns, "column_name", "present").select(
        *series, "column_name", n_expected.alias("expected"), F.coalesce("present", F.lit(0)).alias("present")
    )
    rolled = long.rollup(*series, "column_name").agg(F.sum("expected").alias("expected"), F.sum("present").alias("present"))
    return rolled.withColumns(
        {
            "missing": F.col("expected") - F.col("present"),
            "coverage": F.coalesce(F.try_divide("present", "expected"), F.lit(1.0)),
        }
    )


def worst_coverage(audit: DataFrame, series: str) -> DataFrame:
    """Stations by worst coverage, then most missing, then id."""
    per = audit.where(F.col(series).isNotNull() & F.col("column_name").isNotNull())
    worst = per.groupBy(series).agg(F.min("coverage").alias("worst_coverage"), F.sum("missing").alias("missing"))
    return worst.orderBy("worst_coverage", F.col("missing").desc(), series)
