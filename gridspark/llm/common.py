"""Small helpers shared by the text operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

__all__ = ["lower_ascii", "materialize", "partitions", "scratch_path", "table", "whole_row"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character as it is; null as the empty text."""
    return F.translate(F.coalesce(c, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct; names may hold dots and backticks."""
    return F.struct(*("`" + c.replace("`", "``") + "`" for c in df.columns))
