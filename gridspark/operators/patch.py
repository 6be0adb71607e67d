"""Combining sources on a key: deduplication, patches, updates, unions, priorities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import as_list


def dedup(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    keep: str = "last",
) -> DataFrame:
    """One row per key: the one that sorts first or last by `order`.

    An aggregate, so a hot key collapses before the shuffle; equal orders are decided
    by the remaining columns, so the result does not depend on the partitioning.
    """
    keys, order = as_list(keys), as_list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.max if keep == "last" else F.min
    row = F.struct(*order, *rest)
    out = df.groupBy(*keys).agg(pick(row).alias("_row"))
    return out.select(*keys, "_row.*").select(*df.columns)


def best_source(df: DataFrame, keys, rank: str, value: str = "value") -> DataFrame:
    """Non-null value with the lowest source rank per key."""
    keys = as_list(keys)
    usable = F.when(F.col(value).isNotNull(), F.col(rank))
    return df.groupBy(*keys).agg(F.min_by(value, usable).alias(value), F.min(usable).alias(rank))


def patch(
    base: DataFrame,
    updates: DataFrame,
    keys: str | Sequence[str],
    columns: Sequence[str],
    *,
    prefer: str = "new",
    order: str | None = None,
) -> DataFrame:
    """Left join of `updates` and a null-skipping merge per column.

    Repeated keys of the updates are applied in the order of the column `order`, the last row
    wins; without an order the row with the largest values does.  Rows of the base never
    multiply.

    prefer="new": the patch wins where it has a value.  prefer="old": the patch only
    fills nulls.  A column the base lacks is created.
    """
    keys, columns = as_list(keys), as_list(columns)
    if not columns:
        raise ValueError("patch needs at least one column")
    for side in (base, updates):
        if missing := set(keys) - set(side.columns):
            raise ValueError(f"missing key columns: {sorted(missing)}")
    if missing := set(columns) - set(updates.columns):
        raise ValueError(f"missing update columns: {sorted(missing)}")
    right = last_rows(updates, keys, columns, order).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    merged = base.join(right, keys, "left")
    out = {}
    for c in columns:
        new = F.col(f"_new_{c}")
        if c not in base.columns:
            out[c] = new
        else:
            out[c] = F.coalesce(new, F.col(c)) if prefer == "new" else F.coalesce(F.col(c), new)
    order = [*base.columns, *[c for c in columns if c not in base.columns]]
    return merged.withColumns(out).select(*order)


def last_rows(df: DataFrame, keys, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the last by `order`, or the one with the largest values."""
    keys, columns = as_list(keys), [c for c in columns if c != order]
    chosen = [order] if order else columns[:1]
    kept = df.select(*keys, *dict.fromkeys([*chosen, *columns]))
    return dedup(kept, keys, chosen)


def update_frame(base: DataFrame, other: DataFrame, keys, *, order: str | None = None) -> DataFrame:
    """Overwrite with the other frame's non-nulls on shared keys and shared columns;
    no row and no column is added.  Repeated keys as in `patch`."""
    keys = as_list(keys)
    shared = [c for c in other.columns if c in base.columns and c not in keys and c != order]
    return patch(base, other, keys, shared, prefer="new", order=order)


def replace_feed(base: DataFrame, feed: DataFrame, keys, columns, *, order: str | None = None) -> DataFrame:
    """The feed wins completely: its columns are dropped from the base and joined anew.
    Repeated keys as in `patch`."""
    keys, columns = as_list(keys), as_list(columns)
    return base.drop(*columns).join(last_rows(feed, keys, columns, order).select(*keys, *columns), keys, "left")


def coalesce_suffixed(df: DataFrame, left: str = "_x", right: str = "_y") -> DataFrame:
    """Merge column pairs left by a suffixed join; the left one wins where present."""
    stems = [c[: -len(left)] for c in df.columns if c.endswith(left) and c[: -len(left)] + right in df.columns]
    out = []
    for c in df.columns:
        if c.endswith(left) and c[: -len(left)] in stems:
            stem = c[: -len(left)]
            out.append(F.coalesce(F.col(c), F.col(stem + right)).alias(stem))
        elif not (c.endswith(right) and c[: -len(right)] in stems):
            out.append(F.col(c))
    return df.select(*out)


def stack_sources(frames: dict[str, DataFrame], ranks: dict[str, int] | None = None) -> DataFrame:
    """Union of feeds with their source name and explicit rank (lower wins)."""
    parts = []
    for i, (name, df) in enumerate(frames.items()):
        rank = i if ranks is None else ranks[name]
        parts.append(df.withColumns({"source": F.lit(name), "source_rank": F.lit(rank)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def wide_by_location(df: DataFrame, location: str, names: Sequence[str], keys="ts", value: str = "value") -> DataFrame:
    """N-way full outer merge as one shuffle: one column per named location."""
    return df.groupBy(*as_list(keys)).pivot(location, list(names)).agg(F.first(value, ignorenulls=True))


def primary_or_backup(
    primary: DataFrame, backup: DataFrame, keys, value: str = "value", *, null_zero_backup: bool = True
) -> DataFrame:
    """Full outer merge; the backup serves where the primary has no value.  A backup
    that is zero everywhere carries no information and is dropped to null."""
    keys = as_list(keys)
    spare = backup.select(*keys, F.col(value).alias("_spare"))
    if null_zero_backup:
        any_nonzero = backup.agg(F.coalesce(F.bool_or(F.col(value) != 0), F.lit(False))).scalar()
        spare = spare.withColumn("_spare", F.when(any_nonzero, F.col("_spare")))
    both = primary.select(*keys, value).join(spare, keys, "full")
    return both.select(*keys, F.coalesce(value, "_spare").alias(value))


def merge_actual_forecast(actual: DataFrame, forecast: DataFrame, keys, value: str = "value") -> DataFrame:
    """Full outer merge, actual wins, finite values only.  One shuffle: a union reduced
    by source rank, rather than a join."""
    keys = as_list(keys)
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    rows = stack_sources({"actual": actual.select(*keys, value), "forecast": forecast.select(*keys, value)})
    return best_source(rows.where(ok), keys, "source_rank", value).drop("source_rank")


def choose_by_time(real: Column, forecast: Column, ts: Column, now) -> Column:
    """Up to now the reading, else the forecast; later only the forecast."""
    return F.when(ts <= F.lit(now).cast("timestamp"), F.coalesce(real, forecast)).otherwise(forecast)


def split_existing(batch: DataFrame, store: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows to update)."""
    keys = as_list(keys)
    present = store.select(*keys)
    return batch.join(present, keys, "left_anti"), batch.join(present, keys, "left_semi")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_keep_last(old: DataFrame, fresh: DataFrame, keys) -> DataFrame:
    """Union of store and fresh rows; the fresh row wins on equal keys."""
    rows = stack_sources({"old": old, "fresh": fresh})
    return dedup(rows, keys, "source_rank", keep="last").drop("source", "source_rank")


def collapse_batch(batch: DataFrame, keys, order: str | None, null_policy: str = "skip") -> DataFrame:
    """Repeated keys applied in order.  skip: per column the last non-null value; other
    policies: the last row, nulls included.  Without an order the row with the largest
    values stands for its key."""
    keys = as_list(keys)
    if order is None:
        return last_rows(batch, keys, [c for c in batch.columns if c not in keys])
    if null_policy != "skip":
        return dedup(batch, keys, order).drop(order)
    values = [c for c in batch.columns if c not in keys and c != order]
    return batch.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    )


def missing_columns(wanted: Sequence[str], df: DataFrame) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def keep_prefixed(df: DataFrame, prefixes: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Allowed columns of the given families, and every column outside them."""
    if gone := missing_columns(allowed, df):
        raise ValueError(f"missing configured columns: {gone}")
    keep = [c for c in df.columns if c in allowed or not c.startswith(tuple(prefixes))]
    return df.select(*keep)


def keep_original_and(df: DataFrame, original: Sequence[str], required: Sequence[str]) -> DataFrame:
    wanted = [*original, *[c for c in required if c not in original]]
    return df.select(*[c for c in wanted if c in df.columns])


def prefixed(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]
