"""Gap filling over (series, ts), bucketed so that a long series uses many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import BUCKET, DEFAULT_BUCKET, after, as_list, before, bucket_of, from_here, up_to_here, with_carry


def _known(value: str, ts: str) -> Column:
    return F.when(F.col(value).isNotNull(), F.col(ts))


def _fill(df, values, series, ts, bucket, *, forward: bool, backward: bool, look_ahead_first: bool = False) -> DataFrame:
    values, series = as_list(values), as_list(series)
    summary, carry = {}, {}
    for i, v in enumerate(values):
        if forward:
            summary[f"_t{i}"] = F.max_by(v, _known(v, ts))
            carry[f"_p{i}"] = F.last(f"_t{i}", ignorenulls=True).over(before(series))
        if backward:
            summary[f"_h{i}"] = F.min_by(v, _known(v, ts))
            carry[f"_q{i}"] = F.last(f"_h{i}", ignorenulls=True).over(after(series))
    b = with_carry(df.withColumn(BUCKET, bucket_of(ts, bucket)), series, summary, carry)
    filled = {}
    for i, v in enumerate(values):
        back, ahead = [], []
        if forward:
            back = [F.last(v, ignorenulls=True).over(up_to_here(series, ts)), F.col(f"_p{i}")]
        if backward:
            ahead = [F.last(v, ignorenulls=True).over(from_here(series, ts)), F.col(f"_q{i}")]
        filled[v] = F.coalesce(*(ahead + back if look_ahead_first else back + ahead))
    return b.withColumns(filled).select(*df.columns)


def forward_fill(df: DataFrame, values, series, ts: str = "ts", *, bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """Last known value at or before the row; leading nulls stay."""
    return _fill(df, values, series, ts, bucket, forward=True, backward=False)


def backward_fill(df: DataFrame, values, series, ts: str = "ts", *, bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """Next known value at or after the row; trailing nulls stay."""
    return _fill(df, values, series, ts, bucket, forward=False, backward=True)


def fill_edges(df: DataFrame, values, series, ts: str = "ts", *, bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """Forward fill, then backward fill what leads."""
    return _fill(df, values, series, ts, bucket, forward=True, backward=True)


def back_then_forward(df: DataFrame, values, series, ts: str = "ts", *, bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """Backward fill, then forward fill what trails."""
    return _fill(df, values, series, ts, bucket, forward=True, backward=True, look_ahead_first=True)


def with_neighbours(
    df: DataFrame,
    values: str | Sequence[str],
    series,
    ts: str = "ts",
    *,
    at: str | None = None,
    extra: Sequence[str] = (),
    bucket: str = DEFAULT_BUCKET,
) -> DataFrame:
    """Nearest known points on both sides of every row, for all values in one pass.

    Adds per value structs `_prev_<value>` and `_next_<value>` of (x, y, *extra), and `_x`,
    where x is the column `at` (default: the timestamp in seconds) and y the value.  A
    known row is its own neighbour on both sides.
    """
    series, values = as_list(series), as_list(values)
    x = F.col(at).cast("double") if at else F.unix_micros(ts) / F.lit(1e6)
    b = df.withColumns({BUCKET: bucket_of(ts, bucket), "_x": x})
    extras = [F.col(c).alias(c) for c in extra]
    points = {
        f"_point_{v}": F.when(F.col(v).isNotNull(), F.struct(F.col("_x").alias("x"), F.col(v).alias("y"), *extras))
        for v in values
    }
    b = b.withColumns(points)
    summary, carry = {}, {}
    for v in values:
        summary[f"_tail_{v}"] = F.max_by(f"_point_{v}", _known(v, ts))
        summary[f"_head_{v}"] = F.min_by(f"_point_{v}", _known(v, ts))
        carry[f"_p_{v}"] = F.last(f"_tail_{v}", ignorenulls=True).over(before(series))
        carry[f"_q_{v}"] = F.last(f"_head_{v}", ignorenulls=True).over(after(series))
    b = with_carry(b, series, summary, carry)
    near = {}
    for v in values:
        prev = F.last(f"_point_{v}", ignorenulls=True).over(up_to_here(series, ts))
        nxt = F.last(f"_point_{v}", ignorenulls=True).over(from_here(series, ts))
        near[f"_prev_{v}"] = F.coalesce(prev, F.col(f"_p_{v}"))
        near[f"_next_{v}"] = F.coalesce(nxt, F.col(f"_q_{v}"))
    return b.withColumns(near).drop(BUCKET, *points, *carry)


def between_neighbours(value: str) -> Column:
    """Linear value of a row that `with_neighbours` prepared."""
    p, q = F.col(f"_prev_{value}"), F.col(f"_next_{value}")
    slope = (q["y"] - p["y"]) / (q["x"] - p["x"])
    return (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(p.isNull(), None)
        .when(q.isNull(), p["y"])
        .otherwise(p["y"] + slope * (F.col("_x") - p["x"]))
    )


def interpolate(
    df: DataFrame,
    values: str | Sequence[str],
    series,
    ts: str = "ts",
    *,
    at: str | None = None,
    bucket: str = DEFAULT_BUCKET,
) -> DataFrame:
    """Linear between known neighbours.  Trailing nulls repeat the last value, leading
    nulls stay null.  `at` names a position column to interpolate by row instead of time."""
    n = with_neighbours(df, values, series, ts, at=at, bucket=bucket)
    return n.withColumns({v: between_neighbours(v) for v in as_list(values)}).select(*df.columns)


def zero_to_last(df: DataFrame, value: str, series, ts: str = "ts", *, bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """Replace zeros (and nulls) by the last non-zero value; leading zeros stay."""
    cols = df.columns
    seen = df.withColumn("_nz", F.nullif(F.col(value), F.lit(0.0)))
    out = forward_fill(seen, "_nz", series, ts, bucket=bucket)
    return out.withColumn(value, F.coalesce("_nz", value)).select(*cols)


def accepted_or_previous(
    df: DataFrame, value: str, good: Column, series, ts: str = "ts", *, bucket: str = DEFAULT_BUCKET
) -> DataFrame:
    """Keep a value where the row is accepted, else the last accepted one."""
    return forward_fill(df.withColumn(value, F.when(good, F.col(value))), value, series, ts, bucket=bucket)


def fill_seeded(df: DataFrame, values, series, start, ts: str = "ts", *, bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """Forward fill that may start from rows before the wanted window."""
    return forward_fill(df, values, series, ts, bucket=bucket).where(F.col(ts) >= F.lit(start).cast("timestamp"))
