"""Exact quantiles and ranks without gathering a group in one task.

`percentile` keeps every distinct value of a group in one buffer.  That is right for
groups of proven size (the hours of a day); for groups that grow with the table,
`exact_quantiles` and `global_average_rank` range-partition the values, and
`quantile_values` brackets the answer with bounded sketches, counts what lies below
exactly, and sorts only what lies inside the last bracket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .buckets import as_list

# Accuracy of the sketches that bracket a whole-column quantile.
ACCURACY = 10_000
# Whole-column quantiles sort at most GATHER * ACCURACY distinct values in one task.
GATHER = 10


def quantile_values(df: DataFrame, value: str, probs: Sequence[float], *, accuracy: int = ACCURACY) -> list[float | None]:
    """Linear-interpolated quantiles of a whole column, as numbers.

    Every job returns a bounded number of values to the driver: sketches, counts below and
    inside their brackets, and per wanted rank the one value that holds it.  Bracket bounds
    are literals, so later scans can skip row groups.
    """
    # Every narrowing reads the column again, so the column is written once.
    rows = materialize(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v")), "column")
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).first()
    if not n:
        return [None] * len(probs)
    exact = [p * (n - 1) for p in probs]
    ranks = sorted({r for x in exact for r in (math.floor(x), math.ceil(x))})
    at = _values_at(rows, lo, hi, 0, n, ranks, accuracy)
    out = []
    for x in exact:
        a, z = at[math.floor(x)], at[math.ceil(x)]
        out.append(a + (z - a) * (x - math.floor(x)))
    return out


def _values_at(rows: DataFrame, lo: float, hi: float, below: int, inside: int, ranks: list[int], accuracy: int) -> dict[int, float]:
    """Values at the wanted ranks, all of which lie in [lo, hi]: `below` rows are smaller
    than lo and `inside` rows lie between.  Brackets are narrowed by sketches until one is
    small, a single value, or made of ties that no sketch divides."""
    if lo == hi:
        return dict.fromkeys(ranks, lo)
    span = rows.where(F.col("_v").between(lo, hi))
    if inside > GATHER * accuracy:
        margin = 3.0 / accuracy
        # The two ranks around a quantile are neighbours and share a bracket.
        units = [[ranks[0]]]
        for r in ranks[1:]:
            if r == units[-1][-1] + 1:
                units[-1].append(r)
            else:
                units.append([r])
        share = [((u[0] - below) / (inside - 1), (u[-1] - below) / (inside - 1)) for u in units]
        low, high = span.agg(
            F.percentile_approx("_v", [max(0.0, p - margin) for p, _ in share], accuracy),
            F.percentile_approx("_v", [min(1.0, p + margin) for _, p in share], accuracy),
        ).first()
        brackets: dict[tuple[float, float], list[int]] = {}
        for i, unit in enumerate(units):
            a = lo if share[i][0] <= margin else low[i]
            z = hi if share[i][1] >= 1.0 - margin else high[i]
            brackets.setdefault((a, z), []).extend(unit)
        if list(brackets) != [(lo, hi)]:
            counts = span.agg(
                *[F.count_if(F.col("_v") < a) for a, _ in brackets], *[F.count_if(F.col("_v").between(a, z)) for a, z in brackets]
            ).first()
            found: dict[int, float] = {}
            for k, ((a, z), wanted) in enumerate(brackets.items()):
                first, size = below + counts[k], counts[len(brackets) + k]
                # A sketch may miss its rank; the counts are exact and tell on which side.
                parts = (
                    (a, z, first, size, [r for r in wanted if first <= r < first + size]),
                    (lo, a, below, first - below + 1, [r for r in wanted if r < first]),
                    (z, hi, None, below + inside - first - size + 1, [r for r in wanted if r >= first + size]),
                )
                for from_, to, under, held, ranks_ in parts:
                    if ranks_:
                        under = rows.where(F.col("_v") < from_).count() if under is None else under
                        found |= _values_at(rows, from_, to, under, held, ranks_, accuracy)
            return found
    w = Window.partitionBy(F.lit(0)).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    tied = span.groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = tied.withColumn("_last", F.lit(below) + F.sum("_c").over(w) - 1)
    first = F.col("_last") - F.col("_c") + 1
    row = upto.agg(*[F.max(F.when((first <= r) & (F.lit(r) <= F.col("_last")), F.col("_v"))) for r in ranks]).first()
    if any(v is None for v in row):
        raise ArithmeticError("a quantile lies outside its bracket")
    return dict(zip(ranks, row))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], groups: str | Sequence[str], *, slices: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles, one row per group, columns q0, q1, … in the order
    of `probs`, and `n`, the number of non-null values.

    Equal values collapse first; the distinct values are range-partitioned over all groups
    and written with the number of their partition.  Each (group, partition) is ranked by
    itself and shifted by the counts of the group's partitions before it, so a group of any
    size is spread over as many tasks as its share of the values.  `slices` defaults to the
    session's shuffle partitions.
    """
    keys = as_list(groups)
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    sliced = materialize(counts.repartitionByRange(slices, *keys, "_v").withColumn("_slice", F.spark_partition_id()), "quantiles")
    # A group has a row per partition that it reaches into: `slices` at most.
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_t"))
    prior = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_slice", F.coalesce(F.sum("_t").over(prior), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(*keys)).alias("n")
    )
    w = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(totals, [*keys, "_slice"]).withColumn("_last", F.col("_before") + F.sum("_c").over(w) - 1)
    held = lambda r: F.max(F.when((F.col("_last") - F.col("_c") < r) & (r <= F.col("_last")), F.col("_v")))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ends = ranked.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[held(F.floor(x)).alias(f"_a{i}") for i, x in enumerate(at)],
        *[held(F.ceil(x)).alias(f"_z{i}") for i, x in enumerate(at)],
    )
    line = [F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * (x - F.floor(x)) for i, x in enumerate(at)]
    return ends.select(*keys, "n", *[c.alias(f"q{i}") for i, c in enumerate(line)])


def quantile_scalar(df: DataFrame, value: str, p: float) -> Column:
    """One exact quantile of the whole frame, as a literal."""
    return F.lit(quantile_values(df, value, [p])[0]).cast("double")


def quantile_clip(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Clip a column to its own quantiles; nulls stay null."""
    lo, hi = quantile_values(df, value, [low, high])
    v = F.col(value)
    return df.withColumn(value, F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi))))


def iqr_filter(df: DataFrame, value: str, width: float = 2.5) -> DataFrame:
    """Rows within width interquartile ranges of the quartiles.  The fence is a literal
    bound, so the scan can skip row groups."""
    q1, q3 = quantile_values(df, value, [0.25, 0.75])
    if q1 is None:
        return df.limit(0)
    spread = width * (q3 - q1)
    return df.where(F.col(value).between(q1 - spread, q3 + spread))


def summary_quantiles(df: DataFrame, value: str, groups: str | Sequence[str]) -> DataFrame:
    """min, p10, median, p90, max per group."""
    q = exact_quantiles(df, value, [0.0, 0.1, 0.5, 0.9, 1.0], groups)
    names = ["min", "p10", "median", "p90", "max"]
    return q.select(*as_list(groups), "n", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])


def global_average_rank(df: DataFrame, value: str, *, slices: int | None = None) -> DataFrame:
    """Distinct values with their average rank over the whole frame (ties share it).

    Equal values collapse first.  The distinct values are range-partitioned and written with
    the number of their partition; each partition is then ranked by itself and shifted by
    the counts of the partitions before it, so no task sorts the whole column.  `slices`
    defaults to the session's shuffle partitions.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranged = counts.repartitionByRange(slices, "v").withColumn("_slice", F.spark_partition_id())
    sliced = materialize(ranged, "ranks")
    totals = sliced.groupBy("_slice").agg(F.sum("c").alias("_t"))
    # One row per slice.
    prior = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_slice", F.coalesce(F.sum("_t").over(prior), F.lit(0)).alias("_shift"))
    w = Window.partitionBy("_slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.join(F.broadcast(shift), "_slice").withColumn("_upto", F.col("_shift") + F.sum("c").over(w))
    return out.select(F.col("v").alias(value), (F.col("_upto") - (F.col("c") - 1) / F.lit(2.0)).alias("rank"))


def stable_hash(*cols: str | Column, seed: int = 42) -> Column:
    """Number in [0, 1) from the key columns: the same row falls on the same side of a
    split however the data is partitioned."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))

