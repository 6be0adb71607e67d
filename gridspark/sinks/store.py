"""Writing the hourly store: upserts by staged partition overwrite, dumps, run tables.

Plain parquet has no MERGE.  An upsert reads only the dates its batch touches, writes the
merged rows to the shared scratch folder, and then overwrites exactly those date
partitions from the staged copy, so no plan reads and overwrites the same files and a
failed last step can be repeated from the copy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import as_list
from ..operators.patch import collapse_batch
from ..session import materialize
from ..sources.store import DATE, read_store


@dataclass(frozen=True)
class UpsertResult:
    inserted: int
    updated: int


def upsert_frame(
    store: DataFrame,
    batch: DataFrame,
    keys: str | Sequence[str],
    *,
    null_policy: str = "skip",
    default=None,
) -> DataFrame:
    """Store rows after the batch (unique on the keys) is applied.

    skip: a null in the batch keeps the old value.  overwrite: it replaces it.
    default: it becomes `default`.  Never deletes; batch columns the store lacks appear.
    """
    keys = as_list(keys)
    incoming = [c for c in batch.columns if c not in keys]
    new = batch.select(*keys, F.lit(True).alias("_in"), *[F.col(c).alias(f"_n_{c}") for c in incoming])
    both = store.withColumn("_out", F.lit(True)).join(new, keys, "full")
    out = []
    for c in [*store.columns, *[c for c in incoming if c not in store.columns]]:
        if c in keys or c not in incoming:
            out.append(F.col(c))
            continue
        fresh = F.col(f"_n_{c}")
        old = F.col(c) if c in store.columns else F.lit(None)
        if null_policy == "skip":
            merged = F.coalesce(fresh, old)
        elif null_policy == "overwrite":
            merged = F.when(F.col("_in"), fresh).otherwise(old)
        elif null_policy == "default":
            merged = F.when(F.col("_in"), F.coalesce(fresh, F.lit(default))).otherwise(old)
        else:
            raise ValueError(f"unknown null policy {null_policy!r}")
        out.append(merged.alias(c))
    kind = F.when(F.col("_out").isNull(), "inserted").when(F.col("_in").isNotNull(), "updated").otherwise("kept")
    return both.select(*out, kind.alias("_change"))


def update_existing(store: DataFrame, batch: DataFrame, keys, columns: Sequence[str]) -> DataFrame:
    """Overwrite columns of matched rows, nulls included; unmatched batch rows are ignored."""
    keys = as_list(keys)
    new = batch.select(*keys, F.lit(True).alias("_in"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    j = store.join(new, keys, "left")
    cols = {c: F.when(F.col("_in"), F.col(f"_n_{c}")).otherwise(F.col(c) if c in store.columns else F.lit(None)) for c in columns}
    return j.withColumns(cols).select(*store.columns, *[c for c in columns if c not in store.columns])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_store(df: DataFrame, path: str, ts: str = "ts", *, files_per_date: int = 1) -> None:
    """Rows into date partitions, each overwritten as a whole.  A date is spread over at least
    `files_per_date` tasks by a hash of its rows; the rebalancing exchange splits it further
    by size, so a hot date does not sit in one task."""
    out = df.withColumn(DATE, F.to_date(ts))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_date))
    out.withColumn("_spread", spread).hint("rebalance", DATE, "_spread").drop("_spread").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        DATE
    ).parquet(path)


def upsert(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    keys: str | Sequence[str] = "ts",
    *,
    ts: str = "ts",
    order: str | None = None,
    null_policy: str = "skip",
    default=None,
    files_per_date: int = 1,
) -> UpsertResult:
    """Null-skipping upsert; returns the numbers of inserted and updated rows.

    Repeated keys in the batch are applied in the order of the column `order`; without one the
    row with the largest values stands for its key.
    """
    keys = as_list(keys)
    batch = materialize(collapse_batch(batch, keys, order, null_policy), "batch")
    if not _exists(spark, path):
        write_store(batch, path, ts, files_per_date=files_per_date)
        return UpsertResult(batch.count(), 0)
    dates = batch.select(F.to_date(ts).alias(DATE)).distinct()
    # One row per touched date: its size is bounded by the calendar.
    old = read_store(spark, path).join(F.broadcast(dates), DATE, "left_semi").drop(DATE)
    merged = upsert_frame(old, batch, keys, null_policy=null_policy, default=default)
    staged = materialize(merged, "upsert")
    counts = {r["_change"]: r["n"] for r in staged.groupBy("_change").agg(F.count(F.lit(1)).alias("n")).collect()}
    write_store(staged.drop("_change"), path, ts, files_per_date=files_per_date)
    return UpsertResult(counts.get("inserted", 0), counts.get("updated", 0))


def dump_csv(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Whole table, sorted by time across the part files, nulls as empty fields."""
    df.orderBy(ts).write.mode("error").csv(path, header=True, nullValue="", emptyValue="")


def append_model_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("append").parquet(path)


def model_stats(spark: SparkSession, path: str, training_timestamp=None) -> DataFrame:
    df = spark.read.parquet(path)
    if training_timestamp is not None:
        return df.where(F.col("training_timestamp") == F.lit(training_timestamp).cast("timestamp"))
    return df.orderBy(F.col("training_timestamp").desc())

