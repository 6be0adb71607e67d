"""Forecast accuracy as sufficient statistics: one partial aggregate, no row leaves its task."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .buckets import as_list, hot_salted_join
from .quantile import global_average_rank

MAPE_EPSILON = 1e-10


def pearson(x: str, y: str) -> Column:
    """Correlation over rows complete in both; null when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def error_columns(actual: str | Column, predicted: str | Column) -> dict[str, Column]:
    """Per-row terms whose sums give MAE, RMSE and MAPE."""
    a = F.col(actual) if isinstance(actual, str) else actual
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    err = F.abs(p - a)
    return {
        "n_scored": err.isNotNull().cast("long"),
        "sum_abs": err,
        "sum_sq": err * err,
        "sum_ape": err / (F.abs(a) + F.lit(MAPE_EPSILON)) * 100,
    }


def error_metrics(totals: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE from summed error columns; null where nothing was scored."""
    n = F.col("n_scored")
    return totals.withColumns(
        {
            "mae": F.try_divide("sum_abs", n),
            "rmse": F.sqrt(F.try_divide("sum_sq", n)),
            "mape": F.try_divide("sum_ape", n),
        }
    ).drop("sum_abs", "sum_sq", "sum_ape")


def forecast_evaluation(df: DataFrame, actual: str, predicted: str, groups: str | Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """MAE, MSE, RMSE, R2, sMAPE, Pearson and the time range over the complete pairs.
    Pairs that are both zero do not count towards sMAPE."""
    groups = as_list(groups)
    a, p = F.col(actual), F.col(predicted)
    rows = df.where(a.isNotNull() & p.isNotNull())
    g = rows.groupBy(*groups)
    out = g.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(a - p)).alias("mae"),
        F.avg((a - p) * (a - p)).alias("mse"),
        (2 * F.avg(F.try_divide(F.abs(a - p), F.abs(a) + F.abs(p))) * 100).alias("smape"),
        F.var_pop(actual).alias("_var"),
        pearson(actual, predicted).alias("pearson"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": 1 - F.try_divide("mse", "_var")}).drop("_var")


def spearman(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Correlation of average ranks over the complete pairs."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(actual, predicted)
    pairs = rows.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("_c"))
    ra = global_average_rank(rows, actual).withColumnRenamed("rank", "_ra")
    rp = global_average_rank(rows, predicted).withColumnRenamed("rank", "_rp")
    # One value may pair with very many others, but few do, and the rank tables are as long as the
    # values: only hot values are copied.
    j = hot_salted_join(hot_salted_join(pairs, ra, actual), rp, predicted)
    c, x, y = F.col("_c"), F.col("_ra"), F.col("_rp")
    n = j.agg(F.sum("_c")).scalar()
    # Ranks always have mean (n + 1) / 2, so centred products are exact sums.
    mid = (n + 1) / 2
    s = j.agg(
        F.sum(c * (x - mid) * (y - mid)).alias("_xy"),
        F.sum(c * (x - mid) * (x - mid)).alias("_xx"),
        F.sum(c * (y - mid) * (y - mid)).alias("_yy"),
    )
    return s.select(F.try_divide("_xy", F.sqrt(F.col("_xx") * F.col("_yy"))).alias("spearman"))


def classifier_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 per class and ROC AUC.

    AUC is the rank-sum statistic on average ranks, so equal scores count half.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        F.col(label).cast("boolean").alias("_y"), F.col(score).alias("_s")
    )
    hit = F.col("_s") >= threshold
    counts = rows.agg(
        F.count_if(F.col("_y") & hit).alias("tp"),
        F.count_if(~F.col("_y") & hit).alias("fp"),
        F.count_if(F.col("_y") & ~hit).alias("fn"),
        F.count_if(~F.col("_y") & ~hit).alias("tn"),
    )
    ranks = global_average_rank(rows, "_s")
    pos = rows.where("_y").groupBy("_s").agg(F.count(F.lit(1)).alias("_c")).join(ranks, "_s")
    rank_sum = pos.agg(F.sum(F.col("_c") * F.col("rank"))).scalar()
    n1, n0 = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    out = counts.withColumn("_rs", rank_sum)
    out = out.withColumns(
        {
            "auc": F.try_divide(F.col("_rs") - n1 * (n1 + 1) / 2, n1 * n0),
            "accuracy": F.try_divide(F.col("tp") + F.col("tn"), n1 + n0),
            "precision_1": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall_1": F.try_divide(F.col("tp"), n1),
            "precision_0": F.try_divide(F.col("tn"), F.col("tn") + F.col("fn")),
            "recall_0": F.try_divide(F.col("tn"), n0),
        }
    ).drop("_rs")
    f1 = lambda k: F.try_divide(
        2 * F.col(f"precision_{k}") * F.col(f"recall_{k}"), F.col(f"precision_{k}") + F.col(f"recall_{k}")
    )
    return out.withColumns({"f1_1": f1(1), "f1_0": f1(0)})


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight column: negatives over positives for the positive class, one otherwise."""
    pos = df.agg(F.count_if(F.col(label).cast("boolean"))).scalar()
    neg = df.agg(F.count_if(~F.col(label).cast("boolean"))).scalar()
    ratio = F.coalesce(F.try_divide(neg, pos), F.lit(1.0))
    return df.withColumn("weight", F.when(F.col(label).cast("boolean"), ratio).otherwise(F.lit(1.0)))


def sampled_metrics(
    df: DataFrame, actual: str, predicted: str, key: Sequence[str], *, replicates: int = 10, size: int = 500
) -> DataFrame:
    """Error metrics of seeded random samples of `size` rows, one row per replicate.

    Each replicate orders rows by its own hash of the key and takes exactly the first `size`
    (all, if there are fewer).  The rows are counted first, so that only those whose hash lies
    below a bound, which some more than `size` rows should do, are sorted: first within salted
    groups, of which Spark keeps `size` rows per task before the shuffle, then among the salts'
    winners.  A replicate that found too few (keys repeat) is taken again with a higher bound.
    """
    from pyspark.sql import Window

    from .quantile import stable_hash

    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    n = rows.count()
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*key), F.lit(salts)).alias("_salt")
    bound, todo, found = (size + 8 * math.sqrt(size) + 50) / max(n, 1), list(range(replicates)), []
    while todo:
        parts = F.array(*[F.struct(F.lit(r).alias("replicate"), stable_hash(*key, seed=r).alias("h")) for r in todo])
        sample = rows.select(actual, predicted, salt, F.explode(parts).alias("_r")).select(actual, predicted, "_salt", "_r.replicate", "_r.h")
        sample = sample.where(F.col("h") < bound)
        for group in (["replicate", "_salt"], ["replicate"]):
            w = Window.partitionBy(*group).orderBy("h", actual, predicted)
            sample = sample.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")
        sample = materialize(sample.select("replicate", actual, predicted), "sample")
        held = dict(sample.groupBy("replicate").count().collect())  # one row per replicate
        # Every hash is below one.
        todo = [r for r in todo if held.get(r, 0) < min(size, n)] if bound < 1 else []
        found.append(sample.where(~F.col("replicate").isin(todo)))
        bound *= 8
    sample = functools.reduce(DataFrame.unionByName, found)
    return forecast_evaluation(sample.withColumn("ts", F.lit(None).cast("timestamp")), actual, predicted, "replicate").drop(
        "first_ts", "last_ts"
    )
