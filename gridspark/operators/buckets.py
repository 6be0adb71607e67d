"""Ordered work without one task per series.

A window over a whole series puts that series on one task.  Here every series is
cut into time buckets; a window runs inside (series, bucket), and what must cross a
bucket edge (last known value, next timestamp, row count) travels through a summary
with one row per (series, bucket).  On an hourly grid a bucket of 30 days holds at
most 720 rows, and the summary of a series at most 12.2 rows per year, so neither
side grows with the number of rows a series holds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = "30 days"
BUCKET = "_bucket"

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def seconds(span: str | timedelta | int) -> int:
    """'30 days', '1 hour', a timedelta or plain seconds."""
    if isinstance(span, timedelta):
        return int(span.total_seconds())
    if isinstance(span, int):
        return span
    m = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", span.lower())
    if not m or m.group(2) not in _UNIT_SECONDS:
        raise ValueError(f"not a time span: {span!r}")
    return int(m.group(1)) * _UNIT_SECONDS[m.group(2)]


def interval(n: int, unit: str = "SECOND") -> Column:
    return F.expr(f"INTERVAL '{n}' {unit}")


def bucket_of(ts: Column | str, width: str | int = DEFAULT_BUCKET) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(ts) / F.lit(seconds(width))).cast("long")


def bucket_start(bucket: Column | str, width: str | int = DEFAULT_BUCKET) -> Column:
    bucket = F.col(bucket) if isinstance(bucket, str) else bucket
    return F.timestamp_seconds(bucket * F.lit(seconds(width)))


# Frames that look ahead are written as frames that look back over the descending order:
# Spark extends a growing frame row by row, but evaluates a shrinking one anew for each row.


def inside(series: Sequence[str], ts: str):
    return Window.partitionBy(*series, BUCKET).orderBy(ts)


def up_to_here(series: Sequence[str], ts: str):
    return inside(series, ts).rowsBetween(Window.unboundedPreceding, 0)


def from_here(series: Sequence[str], ts: str):
    """Use `last`: the frame runs backwards in time, nearest row last."""
    down = Window.partitionBy(*series, BUCKET).orderBy(F.col(ts).desc())
    return down.rowsBetween(Window.unboundedPreceding, 0)


def before(series: Sequence[str]):
    """All earlier buckets of the series, in the summary table; nearest last."""
    return Window.partitionBy(*series).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def after(series: Sequence[str]):
    """All later buckets, nearest last."""
    return Window.partitionBy(*series).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)


def in_order(series: Sequence[str]):
    return Window.partitionBy(*series).orderBy(BUCKET)


def with_carry(
    df: DataFrame,
    series: Sequence[str],
    summary: dict[str, Column],
    carry: dict[str, Column],
) -> DataFrame:
    """Join to each row what its bucket receives from the other buckets of the series.

    `summary` aggregates one (series, bucket); `carry` are window columns over that
    summary.  `df` already has the bucket column.

    `df` is evaluated twice: once, column-pruned and reduced map-side, for the summary, and
    once for the rows.  Over a stored table that is the cheaper way, one more pruned scan
    instead of one more shuffle; a costly derived frame should go through
    `session.materialize` first.
    """
    keys = [*series, BUCKET]
    small = df.groupBy(*keys).agg(*[c.alias(n) for n, c in summary.items()])
    small = small.select(*keys, *[c.alias(n) for n, c in carry.items()])
    return df.join(small, keys, "inner")


def with_position(
    df: DataFrame,
    series: str | Sequence[str],
    ts: str = "ts",
    *,
    bucket: str = DEFAULT_BUCKET,
    name: str = "pos",
) -> DataFrame:
    """Zero-based row position inside each series, counted bucket by bucket."""
    series = as_list(series)
    b = df.withColumn(BUCKET, bucket_of(ts, bucket))
    b = with_carry(
        b,
        series,
        {"_n": F.count(F.lit(1))},
        {"_skip": F.coalesce(F.sum("_n").over(before(series)), F.lit(0))},
    )
    local = F.row_number().over(inside(series, ts)) - 1
    return b.withColumn(name, F.col("_skip") + local).drop("_skip", BUCKET)


def with_halo(df: DataFrame, index: str, block: int, *, before: int = 0, after: int = 0) -> DataFrame:
    """Cut an integer index into blocks and copy each block's rim into its neighbours.

    Adds `_block` and `_own`; a copied row has `_own` false and must be filtered out
    after the windows ran.  At most (before + after) / block of the rows are copied.
    """
    if before > block or after > block:
        raise ValueError("a halo must fit in one neighbouring block")
    home = F.floor(F.col(index) / F.lit(block)).cast("long")
    offset = F.col(index) - home * F.lit(block)
    place = lambda b, own: F.struct(b.alias("b"), F.lit(own).alias("own"))
    own, later, earlier = place(home, True), place(home + 1, False), place(home - 1, False)
    tail, head = offset >= block - before, offset < after
    homes = (
        F.when(tail & head, F.array(own, later, earlier))
        .when(tail, F.array(own, later))
        .when(head, F.array(own, earlier))
        .otherwise(F.array(own))
    )
    return df.select("*", F.inline(homes).alias("_block", "_own"))


def hour_index(ts: Column | str, step: str | int = "1 hour") -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(ts) / F.lit(seconds(step))).cast("long")


def salted_join(big: DataFrame, small: DataFrame, keys: str | Sequence[str], *, salts: int = 16) -> DataFrame:
    """Inner join of many rows per key with one row per key, safe for a hot key.

    The small side is repeated `salts` times and the big side's rows of a key are dealt
    over the copies by a hash of the whole row, so a key with a third of all rows still
    spreads over `salts` tasks.  Where the small side is small enough Spark broadcasts it
    instead and the salt costs nothing.
    """
    keys = as_list(keys)
    deal = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", deal).join(copies, [*keys, "_salt"]).drop("_salt")


HOT_ROWS = 100_000  # rows from which a key is dealt over several tasks


def hot_salted_join(big: DataFrame, small: DataFrame, keys: str | Sequence[str], *, hot_rows: int = HOT_ROWS, salts: int = 16) -> DataFrame:
    """`salted_join` for a small side that is large itself: only rows of hot keys are copied.

    The keys are counted first.  There is at most one hot key per `hot_rows` rows, and just these
    are broadcast, as long as their number allows it.
    """
    keys = as_list(keys)
    hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows).select(*keys, F.lit(True).alias("_hot"))
    deal = F.when(F.col("_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(0)
    dealt = big.join(hot, keys, "left").withColumn("_salt", deal).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    few = small.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(few, [*keys, "_salt"]).drop("_salt")
