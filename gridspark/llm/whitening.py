"""Whitening of embeddings with MLlib's distributed block matrices.

The centred rows are indexed and cut into blocks of rows.  The product of the transposed matrix
with itself is the scatter, one small matrix; its eigenvectors are found locally and, divided by
the roots of their eigenvalues, multiply the block matrix of all rows.  Everything between the
table and the result stays in the JVM; the driver holds matrices of the vectors' length only and
one coordinate per block, of which there are at most `BLOCKS`.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .vectors import whole_vectors

COMPONENTS = 4
HEIGHT = 4096  # rows of a block
BLOCKS = 1 << 15  # of more rows than this many blocks hold, blocks get higher
NO_VARIANCE = 1e-12  # share of the trace up to which an eigenvalue counts as zero


def numbered(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """`rows`, written once, with their number `at` from 0 without gaps; how many there are."""
    low = (1 << 33) - 1
    rows = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned("_id", 33)
    counts = sorted(rows.groupBy(part.alias("part")).count().collect())  # one row per task that wrote
    ends = np.cumsum([0] + [r["count"] for r in counts])
    offsets = rows.sparkSession.createDataFrame(
        [(int(r["part"]), int(o)) for r, o in zip(counts, ends)], "_part long, _offset long"
    )
    rows = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return rows.withColumn("at", F.col("_offset") + F.col("_id").bitwiseAND(F.lit(low))).drop("_id", "_part", "_offset"), int(ends[-1])


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """`rows(at, values)` as blocks of at most `BLOCKS` heights; numbers without a row are zeros."""
    indexed = rows.select(F.col("at").alias("index"), array_to_vector("values").alias("vector"))
    indexed = MLUtils.convertVectorColumnsFromML(indexed, "vector")
    return IndexedRowMatrix(indexed, n, width).toBlockMatrix(max(HEIGHT, -(-n // BLOCKS)), width)


def scatter(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Transposed matrix times matrix of the centred `rows(at, values)`.

    MLlib would give the one resulting block, and with it every row, to one task: the sum over
    the rows is split into as many parts as there are shuffle partitions.
    """
    matrix = block_matrix(rows, n, width)
    java = matrix._java_matrix_wrapper._java_model
    parts = min(partitions(rows.sparkSession), java.numRowBlocks())
    product = java.transpose().multiply(java, parts)
    return BlockMatrix(product, width, width).toLocalMatrix().toArray()


def projected(rows: DataFrame, n: int, weights: np.ndarray) -> DataFrame:
    """`rows(at, values)` times `weights`: (at, values)."""
    width, k = weights.shape
    spark = rows.sparkSession
    small = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(weights)], "at long, values array<double>")
    small = small.select(F.col("at").alias("index"), array_to_vector("values").alias("vector"))
    right = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(small, "vector"), width, k).toBlockMatrix(width, k)
    product = block_matrix(rows, n, width).multiply(right).toIndexedRowMatrix()
    out = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return out.select(F.col("index").alias("at"), vector_to_array("vector").alias("values"))


def _numbers(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _deviation(x: Column, n: int, sums: list[int], largest: int) -> Column:
    """Sum of (n * x - S)^2, exact; null where it is beyond a long."""
    bound = n * largest + max(map(abs, sums))
    kind = "long" if len(sums) * bound * bound < 1 << 63 else "decimal(38,0)"
    if len(sums) * bound * bound >= 10**38:
        return F.lit(None).cast("long")
    square = lambda a, s: (a.cast(kind) * F.lit(n).cast(kind) - s) * (a.cast(kind) * F.lit(n).cast(kind) - s)
    squares = F.zip_with(x, _numbers(sums).cast(f"array<{kind}>"), lambda a, s: square(a, s).cast(kind))
    return F.aggregate(squares, F.lit(0).cast(kind), lambda t, v: (t + v).cast(kind)).try_cast("long")


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of `rows` that takes part and component: vec_id, component (from 1, by
    falling eigenvalue), n, deviation, whitened, explained, identity_error.

    An entry c becomes the whole number x = floor(256 * c).  The covariance is that of the
    distinct vectors (n of them), so copies do not weigh; every row, copies and repeated rows
    included, is returned.  Rows whose vector is null or has a null or non-finite entry, or
    another length than most, take no part.  Null ids are returned as null.  `whitened` is null
    for a component without variance (equal vectors, or fewer distinct ones than components),
    `explained` is null if nothing varies, `deviation` is null where it does not fit a long,
    `identity_error` covers the components that vary (null if none does).  Of tied eigenvalues
    any orthogonal directions may come, the same for all rows.  Extra columns are ignored,
    whatever their names.  An empty table gives an empty result.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    kept, total = numbered(whole_vectors(rows, vector_col, vec_id=F.col(id_col).cast("long")), "vectors")
    if not total:
        return spark.createDataFrame([], schema)
    distinct = materialize(kept.groupBy("x").agg(F.min("at").alias("at")), "distinct-vectors")
    value = F.col("value").cast("decimal(38,0)")
    columns = distinct.select(F.posexplode("x").alias("place", "value")).groupBy("place")
    columns = sorted(columns.agg(F.sum(value).alias("s"), F.max(F.abs(value)).alias("largest")).collect())
    n, width = distinct.count(), len(columns)
    if not width:
        return spark.createDataFrame([], schema)
    sums = [int(r["s"]) for r in columns]
    means = _numbers([s / n for s in sums])  # divided as whole numbers, rounded once
    centred = F.zip_with("x", means, lambda a, m: a.cast("double") - m).alias("values")

    covariance = scatter(distinct.select("at", centred), total, width) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, width)]
    trace = float(np.trace(covariance))
    varies = [bool(values[k] > NO_VARIANCE * trace) for k in order]
    scale = [1 / np.sqrt(values[k]) if v else 0.0 for k, v in zip(order, varies)]

    white = materialize(projected(kept.select("at", centred), total, vectors[:, order] * scale), "whitened")
    error = None
    if any(varies):
        fitted = white.join(distinct.select("at"), "at", "left_semi")
        centre = sorted(fitted.select(F.posexplode("values").alias("place", "value")).groupBy("place").agg(F.avg("value").alias("m")).collect())
        level = _numbers([r["m"] for r in centre])
        again = fitted.select("at", F.zip_with("values", level, lambda a, m: a - m).alias("values"))
        spread = (scatter(again, total, len(order)) / n)[np.ix_(varies, varies)]
        error = float(np.abs(spread - np.eye(len(spread))).max())

    deviation = _deviation(F.col("x"), n, sums, max(int(r["largest"]) for r in columns))
    out = kept.select("vec_id", "at", deviation.alias("deviation")).join(white, "at")
    out = out.select("vec_id", "deviation", F.posexplode("values").alias("place", "value"))
    share = _numbers([float(values[k]) / trace if trace > 0 else None for k in order]).cast("array<double>")
    return out.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.get(_numbers(varies), F.col("place")), F.col("value")).alias("whitened"),
        F.get(share, F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
