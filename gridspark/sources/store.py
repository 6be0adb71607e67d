"""Reading the hourly store: full scans, keyed lookups, bounded and reindexed slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.buckets import as_list
from ..operators.spine import spine
from .tables import nan_to_null

DATE = "date"


def read_store(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The store is partitioned by UTC date.  Without a schema the parts' schemas are
    merged, which is how columns added later become visible.  NaN is read as null."""
    reader = spark.read
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")
    df = nan_to_null(reader.parquet(path))
    return df.withColumn(DATE, F.col(DATE).cast("date")) if DATE in df.columns else df


def lookup(store: DataFrame, keys: DataFrame, on: str | Sequence[str] = "ts") -> DataFrame:
    """Store rows for the wanted keys, sorted; a repeated key yields repeated rows."""
    on = as_list(on)
    return keys.select(*on).join(store, on, "inner").orderBy(*on)


def scan_between(store: DataFrame, start, end, columns: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Inclusive range, ascending.  The bounds stay literals on the stored column, so the
    scan can skip files; a date partition is bounded as well."""
    lo, hi = (F.lit(v).cast("timestamp") if not hasattr(v, "isNull") else v for v in (start, end))
    out = store.where(F.col(ts).between(lo, hi))
    if DATE in store.columns:
        out = out.where(F.col(DATE).between(F.to_date(lo), F.to_date(hi)))
    return (out.select(ts, *columns) if columns else out).orderBy(ts)


def slice_on_grid(store: DataFrame, series, start, end, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """Named columns on the complete hourly index of the range, nulls where absent."""
    series = as_list(series)
    grid = spine(store.select(*series).distinct(), series, start, end, ts=ts)
    lo, hi = (F.lit(v).cast("timestamp") if not hasattr(v, "isNull") else v for v in (start, end))
    held = store.where(F.col(ts).between(lo, hi)).select(*series, ts, *columns)
    return grid.join(held, [*series, ts], "left")


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dumped table; the schema is given, never inferred."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="")
