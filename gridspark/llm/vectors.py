"""Whole-number vectors from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole_vectors(rows: DataFrame, vector_col: str, **keep) -> DataFrame:
    """The columns `keep` (name=column) and x, an array of longs floor(256 * c).

    Rows take part if their vector is not null, has no null or non-finite entry, and is as long
    as most such vectors are (the longer length of two that are equally common).  Entries
    beyond the range of a long become its ends.
    """
    vector = F.col(vector_col)
    unfit = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = rows.where(vector.isNotNull() & ~unfit).select(vector.alias("_vector"), *(c.alias(n) for n, c in keep.items()))
    lengths = rows.groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("_vector") == (lengths["n"] if lengths else 0))
    return rows.select(*keep, F.transform("_vector", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))

