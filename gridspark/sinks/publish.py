"""Published views: pair series, records in local time, snapshots, daily tables.

Each function returns the rows of a view; `write_*` puts them on storage as part files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import MARKET_TZ, epoch_ms, local_date, local_midnight, local_offset_iso
from ..operators.buckets import as_list
from ..operators.rollup import local_day_mean

SNAPSHOT = "snapshot_date"


def from_yesterday(df: DataFrame, now: Column, ts: str = "ts", tz: str = MARKET_TZ) -> DataFrame:
    """Rows from the start of the local yesterday.  The bound is computed once from `now`
    and compared with the stored column."""
    return df.where(F.col(ts) >= local_midnight(F.date_sub(local_date(now, tz), 1), tz))


def from_today(df: DataFrame, now: Column, ts: str = "ts", tz: str = MARKET_TZ) -> DataFrame:
    return df.where(F.col(ts) >= local_midnight(local_date(now, tz), tz))


def pair_series(df: DataFrame, value: str, keys: str | Sequence[str] = (), ts: str = "ts", digits: int | None = None) -> DataFrame:
    """(epoch ms, value) rows."""
    v = F.col(value) if digits is None else F.round(value, digits)
    return df.select(*as_list(keys), epoch_ms(ts).alias("ms"), v.alias("value"))


def pair_documents(df: DataFrame, value: str, keys: str | Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """One JSON document [[ms, value], …] per key and UTC month, in time order.

    Rows are first reduced to one per key and hour, the latest of the hour and of those the
    largest, so a month has at most 744 pairs, which bounds the array.
    """
    keys = as_list(keys)
    latest = F.max(F.struct(F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v")))
    hours = df.groupBy(*keys, F.date_trunc("hour", ts).alias("_hour")).agg(latest.alias("_l"))
    pair = F.array(epoch_ms("_hour").cast("double"), F.col("_l._v"))
    docs = hours.groupBy(*keys, F.date_trunc("month", "_hour").alias("month")).agg(F.sort_array(F.collect_list(pair)).alias("_p"))
    return docs.select(*keys, "month", F.to_json("_p").alias("payload"))


def local_records(df: DataFrame, ts: str = "ts", tz: str = MARKET_TZ) -> DataFrame:
    """Every column, the timestamp as ISO text with the local offset."""
    return df.withColumn(ts, local_offset_iso(ts, tz))


def local_day_averages(df: DataFrame, value: str, keys: str | Sequence[str] = (), ts: str = "ts", tz: str = MARKET_TZ) -> DataFrame:
    """(UTC ms of local midnight, mean of the day)."""
    out = local_day_mean(df, value, keys, ts, tz)
    return out.select(*as_list(keys), epoch_ms("day_start").alias("ms"), F.col(value).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_named_csv(df: DataFrame, path: str, name: str) -> None:
    """One file <name>.csv for each value of the column `name`, which need not be a column of the
    file; the values' number is that of stations or series.  Each is written by one task."""
    spark, staged = df.sparkSession, f"{path}/_staged"
    df.repartition(name).write.mode("error").partitionBy(name).csv(staged, header=True)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(hadoop(staged)):
        value = folder.getPath().getName().partition(f"{name}=")[2]
        if value:
            parts = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".csv")]
            if len(parts) != 1 or not fs.rename(parts[0], hadoop(f"{path}/{value}.csv")):
                raise RuntimeError(f"{len(parts)} files for {value}")


def write_snapshot(df: DataFrame, path: str, day: Column) -> None:
    """The day's snapshot partition; the last write of a day wins."""
    df.withColumn(SNAPSHOT, day.cast("date")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(SNAPSHOT).parquet(path)


def retained_snapshots(df: DataFrame, keep: int, day: str = SNAPSHOT) -> DataFrame:
    """Rows of the newest `keep` snapshot dates; names that are no date are ignored.

    The dates are found on the distinct dates alone, which are bounded by the calendar.
    """
    dated = df.withColumn("_d", F.col(day).try_cast("date")).where("_d IS NOT NULL")
    newest = dated.select("_d").distinct().orderBy(F.col("_d").desc()).limit(keep)
    return dated.join(F.broadcast(newest), "_d", "left_semi").drop("_d")


def outage_records(df: DataFrame, now: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Ongoing and future outages with their length in hours and availability ratio."""
    open_ = df.where(F.col(end) > now)
    return open_.withColumns(
        {
            "hours": (F.unix_seconds(end) - F.unix_seconds(start)) / F.lit(3600.0),
            "availability": F.try_divide("avail_qty", "nominal_power"),
        }
    )

