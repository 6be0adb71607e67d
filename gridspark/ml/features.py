"""Feature tables and splits for the MLlib models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import production_share, row_mean, row_variance, safe_ratio
from ..functions.time import cyclic_time
from ..operators.buckets import as_list, salted_join
from ..operators.fill import forward_fill
from ..operators.quantile import exact_quantiles, quantile_clip, quantile_scalar, quantile_values, stable_hash
from ..operators.rollup import daily_features, volatility_label

CALENDAR = ["year", "day_of_week_sin", "day_of_week_cos", "hour_sin", "hour_cos"]

# Quantiles the price target is clipped to before training.
PRICE_CLIP = (0.0008, 0.9995)


def feature_list(base: Sequence[str], *families: Sequence[str]) -> list[str]:
    """Ordered, without repeats."""
    return list(dict.fromkeys([*base, *[c for fam in families for c in fam]]))


def price_features(
    df: DataFrame,
    target: str,
    drivers: Sequence[str],
    temperatures: Sequence[str] = (),
    *,
    ts: str = "ts",
    series=None,
    clip: tuple[float, float] | None = PRICE_CLIP,
    carry: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Rows with a target, calendar encodings, temperature mean and variance, target
    clipped to its quantiles; with `carry`, drivers are filled forward first."""
    out = df
    if carry:
        keys = as_list(series) if series else ["_one"]
        out = out if series else out.withColumn("_one", F.lit(0))
        out = forward_fill(out, list(drivers), keys, ts)
        out = out if series else out.drop("_one")
    out = cyclic_time(out.where(F.col(target).isNotNull()), ts)
    features = feature_list(CALENDAR, drivers, temperatures)
    if temperatures:
        out = out.withColumns({"temp_mean": row_mean(list(temperatures)), "temp_variance": row_variance(list(temperatures))})
        features = feature_list(features, ["temp_mean", "temp_variance"])
    if clip:
        out = quantile_clip(out, target, *clip)
    return out.dropna("any", subset=features), features


def wind_features(df: DataFrame, wind: str, capacity: str, speeds: Sequence[str], *, ts: str = "ts") -> tuple[DataFrame, list[str]]:
    """Capacity carried forward, production share as target, speed statistics, complete
    rows only."""
    out = forward_fill(df.withColumn("_one", F.lit(0)), capacity, "_one", ts).drop("_one")
    out = cyclic_time(out, ts).withColumns(
        {"share": production_share(wind, capacity), "speed_mean": row_mean(list(speeds)), "speed_variance": row_variance(list(speeds))}
    )
    # The variance of a single speed is undefined and must not empty the table.
    spread = ["speed_mean", "speed_variance"] if len(speeds) > 1 else []
    features = feature_list(["hour_sin", "hour_cos"], speeds, spread)
    return out.dropna("any", subset=["share", *features]), features


def volatility_table(df: DataFrame, price: str, sources: Sequence[str], wind: str, *, flag: str | None = None, ts: str = "ts", quantile: float = 0.80) -> tuple[DataFrame, list[str]]:
    """Daily features, wind variance relative to the other sources, and the label."""
    daily = daily_features(df, [*sources, wind], flag, ts)
    stable = sum([F.col(f"{c}_mean") for c in sources[1:]], F.col(f"{sources[0]}_mean"))
    daily = daily.withColumn("wind_impact", safe_ratio(f"{wind}_var", stable, 1e-6))
    daily = daily.withColumn("wind_impact", F.coalesce("wind_impact", quantile_scalar(daily, "wind_impact", 0.5)))
    label = volatility_label(df, price, ts, quantile).select("date", F.col("volatile").cast("double").alias("label"))
    out = daily.join(label, "date")
    return out, [c for c in out.columns if c not in ("date", "label")]


MAX_NULL_RATE = 0.1


def null_rates(df: DataFrame, features: Sequence[str], max_null_rate: float = MAX_NULL_RATE) -> DataFrame:
    """Null rate per feature and whether it is low enough; one scan."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features])
    return rates.unpivot([], list(features), "feature", "null_rate").withColumn("kept", F.col("null_rate") < max_null_rate)


def screen_features(df: DataFrame, features: Sequence[str], max_null_rate: float = MAX_NULL_RATE) -> list[str]:
    """Features whose null rate is below the limit, in their order."""
    kept = {r["feature"] for r in null_rates(df, features, max_null_rate).where("kept").collect()}
    return [c for c in features if c in kept]


def impute_median(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Nulls to the exact median of their column: all columns in one long selection, so
    the number of features does not multiply the scans."""
    long = df.select(*features).unpivot([], list(features), "feature", "v") if features else None
    if long is None:
        return df
    med = exact_quantiles(long, "v", [0.5], "feature")
    wide = med.groupBy().pivot("feature", list(features)).agg(F.first("q0"))
    one = wide.select(F.struct(*[F.col(c) for c in features]).alias("m")).scalar()
    out = df.withColumn("_m", one)
    return out.withColumns({c: F.coalesce(F.col(c), F.col("_m")[c]) for c in features}).drop("_m")


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns become zero."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features])
    one = stats.select(F.struct(*features)).scalar()
    out = df.withColumn("_z", one)
    scaled = {
        c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col("_z")[c]["m"], F.col("_z")[c]["s"]), F.lit(0.0)))
        for c in features
    }
    return out.withColumns(scaled).drop("_z")


# Splits.  Membership depends on the row's key, never on its partition, so a recomputed
# task sees the same split.


def random_split(df: DataFrame, key: str | Sequence[str], test_share: float = 0.1, seed: int = 42, name: str = "is_test") -> DataFrame:
    return df.withColumn(name, stable_hash(*as_list(key), seed=seed) < test_share)


def chronological_split(df: DataFrame, test_share: float = 0.1, ts: str = "ts", name: str = "is_test") -> DataFrame:
    """The last share of the rows by time."""
    at = df.withColumn("_s", F.unix_micros(ts).cast("double"))
    return at.withColumn(name, F.col("_s") > quantile_scalar(at, "_s", 1.0 - test_share)).drop("_s")


def stratified_split(df: DataFrame, label: str, key: str | Sequence[str], test_share: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    """The same share of every label."""
    h = df.withColumn("_h", stable_hash(*as_list(key), seed=seed))
    cut = exact_quantiles(h, "_h", [1.0 - test_share], label).select(label, F.col("q0").alias("_cut"))
    return salted_join(h, cut, label).withColumn(name, F.col("_h") > F.col("_cut")).drop("_h", "_cut")


def random_folds(df: DataFrame, key: str | Sequence[str], folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.floor(stable_hash(*as_list(key), seed=seed) * folds).cast("int"))


def time_folds(df: DataFrame, folds: int = 3, ts: str = "ts", name: str = "fold") -> DataFrame:
    """Equal consecutive stretches 0 … folds; training for test stretch k is everything
    before it, so stretch 0 is never tested."""
    at = df.withColumn("_s", F.unix_micros(ts).cast("double"))
    place: Column = F.lit(0)
    for cut in quantile_values(at, "_s", [i / (folds + 1) for i in range(1, folds + 1)]):
        place = place + (F.col("_s") > F.lit(cut)).cast("int")
    return at.withColumn(name, place).drop("_s")
