"""Versioned forecast archive: runs, archived predictions, actual prices.

Frames: runs(run_id, run_datetime, schema_version, columns_json),
predictions(run_id, ts, predicted, …), actuals(ts, actual, updated_at, source).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import is_true_forecast
from .buckets import salted_join
from .interval import range_totals
from .metrics import error_columns, error_metrics
from .patch import dedup, union_all

SCHEMA_VERSION = 2


def manifest(columns: Sequence[str]) -> str:
    """The run's column list as JSON text."""
    import json

    return json.dumps(list(columns))


def upsert_actuals(actuals: DataFrame, fresh: DataFrame) -> DataFrame:
    """Latest known actual per timestamp, by updated_at."""
    known = fresh.where(F.col("actual").isNotNull())
    return dedup(union_all(actuals, known), "ts", ["updated_at"], keep="last")


def sync_actuals(archived: DataFrame, canonical: DataFrame) -> DataFrame:
    """Set the archived actual where a canonical one exists and differs; adds `changed`."""
    c = canonical.select("ts", F.col("actual").alias("_canonical"))
    j = archived.join(c, "ts", "left")
    differs = F.col("_canonical").isNotNull() & ~F.col("_canonical").eqNullSafe(F.col("actual"))
    return (
        j.withColumn("changed", differs)
        .withColumn("actual", F.when(F.col("changed"), F.col("_canonical")).otherwise(F.col("actual")))
        .drop("_canonical")
    )


def with_actuals(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Predictions with the canonical actual, else the archived one.

    Actuals are one row per hour; predictions of an hour grow with the number of runs, so
    the join is salted against hours that many runs cover.
    """
    canonical = actuals.select("ts", F.col("actual").alias("_canonical"))
    wanted = predictions.select("ts").distinct().join(canonical, "ts", "left")
    j = salted_join(predictions, wanted, "ts")
    own = F.col("actual") if "actual" in predictions.columns else F.lit(None).cast("double")
    return j.withColumn("actual", F.coalesce("_canonical", own)).drop("_canonical")


def get_predictions(runs: DataFrame, predictions: DataFrame, actuals: DataFrame, wanted: DataFrame) -> DataFrame:
    """All archived predictions for the wanted timestamps, with run time and actual."""
    hits = predictions.join(wanted.select("ts").distinct(), "ts", "left_semi")
    scored = with_actuals(hits, actuals)
    return scored.join(runs.select("run_id", "run_datetime"), "run_id")


def range_errors(
    predictions: DataFrame,
    actuals: DataFrame,
    ranges: DataFrame,
    *,
    runs: DataFrame | None = None,
    true_forecasts_only: bool = False,
) -> DataFrame:
    """MAE, RMSE and MAPE per range over all runs; an empty range gives nulls.

    The predictions are dealt once, by hour, to meet the actuals; after that the errors are
    summed per hour within each task, so the range join sees one row per hour however many
    runs cover it, and one pass serves all ranges.
    """
    scored = with_actuals(predictions, actuals).where("actual IS NOT NULL")
    if true_forecasts_only:
        timed = scored.join(runs.select("run_id", "run_datetime"), "run_id")
        scored = timed.where(is_true_forecast("run_datetime", "ts"))
    return error_metrics(range_totals(ranges, scored, error_columns("actual", "predicted")))


def lead_time_errors(runs: DataFrame, predictions: DataFrame, actuals: DataFrame, bucket_hours: int = 24) -> DataFrame:
    """Error metrics of the true forecasts by lead-time bucket."""
    scored = with_actuals(predictions, actuals).where("actual IS NOT NULL")
    timed = scored.join(runs.select("run_id", "run_datetime"), "run_id").where(is_true_forecast("run_datetime", "ts"))
    lead = F.floor((F.unix_seconds("ts") - F.unix_seconds("run_datetime")) / F.lit(3600.0 * bucket_hours))
    sums = [F.sum(c).alias(n) for n, c in error_columns("actual", "predicted").items()]
    return error_metrics(timed.groupBy(lead.cast("long").alias("lead_bucket")).agg(*sums))


def run_info(runs: DataFrame, predictions: DataFrame, run_id: int | None = None) -> DataFrame:
    """Runs with their number of predictions, newest first.  Counting before the join
    leaves one row per run on both sides."""
    if run_id is not None:
        runs, predictions = runs.where(F.col("run_id") == run_id), predictions.where(F.col("run_id") == run_id)
    counts = predictions.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        runs.select("run_id", "run_datetime")
        .join(counts, "run_id", "left")
        .select("run_id", "run_datetime", F.coalesce("_n", F.lit(0)).alias("prediction_count"))
        .orderBy(F.col("run_datetime").desc(), F.col("run_id").desc())
    )


def schema_gap(archive: DataFrame, source: DataFrame) -> dict[str, str]:
    """Columns (with type) the archive lacks; from the schemas alone."""
    have = set(archive.columns)
    return {f.name: f.dataType.simpleString() for f in source.schema.fields if f.name not in have}


def actual_rows(df: DataFrame, price: str, updated_at: Column, source: str, ts: str = "ts") -> DataFrame:
    return df.where(F.col(price).isNotNull()).select(
        F.col(ts).alias("ts"), F.col(price).alias("actual"), updated_at.alias("updated_at"), F.lit(source).alias("source")
    )
