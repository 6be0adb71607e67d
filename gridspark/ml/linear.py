"""Linear regression from sums of products.

One aggregate finds the sums of products of all features and the target, for every fold apart.
The sums of a training part are those of its folds added up, so any number of folds, parameter
sets and nested searches costs two passes over the rows; the equations themselves, features by
features, are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L2, L1 = 0.001, 0.0


@dataclass(frozen=True)
class Sums:
    """Sums of products of (1, features, target) by group, after a common shift of each column."""

    features: list[str]
    shift: np.ndarray
    by_group: dict[tuple[int, ...], np.ndarray]

    def of(self, take) -> np.ndarray:
        """Total over the groups that `take(group)` accepts."""
        size = len(self.shift) + 1
        return sum((m for g, m in self.by_group.items() if take(g)), np.zeros((size, size)))


def sums_of_products(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ()) -> Sums:
    """Rows with a missing value take no part.  `by` are columns of few whole numbers."""
    names = [*features, target]
    rows = df.select(*(F.col(c).cast("int").alias(f"by{k}") for k, c in enumerate(by)), *(F.col(f"`{c}`").cast("double").alias(f"v{k}") for k, c in enumerate(names)))
    values = [f"v{k}" for k in range(len(names))]
    rows = rows.dropna(subset=values)  # drops NaN as well
    # Shifted by their means, the columns' products lose no digits.
    shift = np.array([v or 0.0 for v in rows.agg(*(F.avg(c) for c in values)).first()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, ...], np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in values]
            x = np.column_stack([np.ones(len(batch)), *(c - s for c, s in zip(columns, shift))])
            groups = np.column_stack([np.zeros(len(batch), int), *(batch.column(f"by{k}").to_numpy(zero_copy_only=False) for k in range(len(by)))]).astype(int)
            for group in np.unique(groups, axis=0):
                part = x[(groups == group).all(1)]
                key = tuple(int(g) for g in group[1:])
                total[key] = total.get(key, 0) + part.T @ part
        i, j = np.triu_indices(len(values) + 1)
        for key, m in total.items():
            arrays = [pa.array([list(key)] * len(i), pa.list_(pa.int32())), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])]
            yield pa.RecordBatch.from_arrays(arrays, names=["group", "i", "j", "s"])

    found = rows.mapInArrow(run, "group array<int>, i int, j int, s double").groupBy("group", "i", "j").agg(F.sum("s").alias("s"))
    by_group: dict[tuple[int, ...], np.ndarray] = {}
    for r in found.collect():  # groups times columns squared
        m = by_group.setdefault(tuple(r["group"]), np.zeros((len(values) + 1,) * 2))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    return Sums(list(features), shift, by_group)


@dataclass(frozen=True)
class Linear:
    """A fitted model; `transform` adds `prediction`."""

    features: list[str]
    coefficients: np.ndarray
    intercept: float

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.coefficients):
            out = out + F.col(f"`{c}`").cast("double") * float(w)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.column())


def solve(sums: Sums, total: np.ndarray, l2: float = L2, l1: float = L1) -> Linear:
    """Least squares of the standardised target on the standardised features, with `l2` times half
    the squared coefficients and `l1` times the absolute ones added to half the mean square."""
    n = total[0, 0]
    if not n:
        return Linear(sums.features, np.zeros(len(sums.features)), 0.0)
    mean = total[0, 1:] / n
    cov = total[1:, 1:] / n - np.outer(mean, mean)
    std = np.sqrt(np.clip(np.diag(cov), 0, None))
    varies = std > 1e-9 * np.maximum(1.0, np.abs(mean + sums.shift))
    safe = np.where(varies, std, 1.0)
    corr = cov / np.outer(safe, safe)
    d = len(sums.features)
    use = np.flatnonzero(varies[:d])
    a, b = corr[np.ix_(use, use)], corr[use, d] if varies[d] else np.zeros(len(use))
    if l1:
        w = np.zeros(len(use))
        for _ in range(10_000):
            before = w.copy()
            for k in range(len(use)):
                rest = b[k] - a[k] @ w + a[k, k] * w[k]
                w[k] = np.sign(rest) * max(abs(rest) - l1, 0.0) / (a[k, k] + l2)
            if np.abs(w - before).max(initial=0) < 1e-13:
                break
    else:
        w = np.linalg.lstsq(a + l2 * np.eye(len(use)), b, rcond=None)[0]
    coefficients = np.zeros(d)
    coefficients[use] = w * safe[d] / safe[use]
    centre = mean + sums.shift
    return Linear(sums.features, coefficients, float(centre[d] - coefficients @ centre[:d]))


def mean_squared_error(sums: Sums, total: np.ndarray, model: Linear) -> float:
    """Of the rows that `total` sums up, without a pass over them."""
    w = np.concatenate([[model.intercept + model.coefficients @ sums.shift[:-1] - sums.shift[-1]], model.coefficients, [-1.0]])
    return float(max(0.0, w @ total @ w) / total[0, 0]) if total[0, 0] else float("nan")


def fold_predictions(df: DataFrame, models: dict[int, Linear], fold: str) -> DataFrame:
    """The rows of each fold with the `prediction` of that fold's model; one pass."""
    out = F.lit(None).cast("double")
    for k, model in models.items():
        out = F.when(F.col(fold) == k, model.column()).otherwise(out)
    return df.where(F.col(fold).isin(list(models))).withColumn("prediction", out)
