"""Not-a-knot cubic interpolation of long series.

The spline of a whole series couples all its points, but the pull of a knot fades by a
factor of about 0.27 per knot.  A chunk that also sees `halo` knots on each side therefore
gets second derivatives equal to those of the whole-series spline up to double precision.
Python only solves chunks of bounded size; the curve itself is evaluated as a column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .buckets import DEFAULT_BUCKET, as_list, with_halo, with_position
from .fill import with_neighbours

HALO = 48
CHUNK = 2000


def second_derivatives(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the not-a-knot cubic spline at its knots.  Two knots give a
    line, three the parabola through them."""
    n = len(x)
    if n < 3:
        return np.zeros(n)
    h = np.diff(x)
    slope = np.diff(y) / h
    if n == 3:
        return np.full(3, 2.0 * (slope[1] - slope[0]) / (h[0] + h[1]))
    # Inner rows: h0*m0 + 2(h0+h1)*m1 + h1*m2 = 6*(s1-s0).  The end rows state that the
    # third derivative does not jump at the second and the last but one knot; with them
    # the outer unknowns are eliminated and a tridiagonal system of n-2 remains.
    k = n - 2
    low, diag, up = h[:-1].copy(), 2.0 * (h[:-1] + h[1:]), h[1:].copy()
    rhs = 6.0 * np.diff(slope)
    first, last = h[0] / h[1], h[-1] / h[-2]
    diag[0] += h[0] * (1.0 + first)
    up[0] -= h[0] * first
    diag[-1] += h[-1] * (1.0 + last)
    low[-1] -= h[-1] * last
    for i in range(1, k):
        w = low[i] / diag[i - 1]
        diag[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    m = np.empty(n)
    m[k] = rhs[-1] / diag[-1]
    for i in range(k - 2, -1, -1):
        m[i + 1] = (rhs[i] - up[i] * m[i + 2]) / diag[i]
    m[0] = (1.0 + first) * m[1] - first * m[2]
    m[-1] = (1.0 + last) * m[-2] - last * m[-3]
    return m


def _solve_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_x")
    m = second_derivatives(pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float))
    return pdf.assign(_m=m)[pdf["_own"].to_numpy(bool)].drop(columns=["_own"])


def cubic_interpolate(
    df: DataFrame,
    value: str,
    series,
    ts: str = "ts",
    *,
    bucket: str = DEFAULT_BUCKET,
    chunk: int = CHUNK,
    halo: int = HALO,
) -> DataFrame:
    """Fill the nulls between known values; nothing is extrapolated past them."""
    series = as_list(series)
    hours = F.unix_seconds(ts) / F.lit(3600.0)
    known = df.where(F.col(value).isNotNull()).select(*series, ts, hours.alias("_x"), F.col(value).cast("double").alias("_y"))
    cut = with_halo(with_position(known, series, ts, bucket=bucket), "pos", chunk, before=halo, after=halo)
    cut = cut.select(*series, "_block", ts, "_x", "_y", "_own")
    schema = df.select(*series, ts).schema.add("_m", "double")
    solved = cut.groupBy(*series, "_block").applyInPandas(
        lambda pdf: _solve_chunk(pdf)[[*series, ts, "_m"]], schema=schema
    )
    # Written once: the neighbour search below reads its input twice.
    solved = materialize(solved, "spline")
    rows = df.join(solved, [*series, ts], "left").withColumn("_h", hours)
    n = with_neighbours(rows, value, series, ts, at="_h", extra=["_m"], bucket=bucket)
    p, q = F.col(f"_prev_{value}"), F.col(f"_next_{value}")
    h = q["x"] - p["x"]
    a, b = (q["x"] - F.col("_x")) / h, (F.col("_x") - p["x"]) / h
    curve = (
        a * p["y"]
        + b * q["y"]
        + ((a * a * a - a) * p["_m"] + (b * b * b - b) * q["_m"]) * h * h / F.lit(6.0)
    )
    out = F.when(F.col(value).isNotNull(), F.col(value)).when(p.isNotNull() & q.isNotNull(), curve)
    return n.withColumn(value, out).select(*df.columns)
