"""Registry of the runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def nudge(digits: int) -> float:
    return 10.0 ** -(digits + 3)


def rnd(c, digits: int = 6):
    """Rounding that both engines do alike.  A mean of two prices often lies half-way
    between two roundings, where the last bit of the sum would decide; the nudge lifts
    such values off the edge."""
    return F.round(c + F.lit(nudge(digits)), digits)


def nudged(sql: str) -> str:
    """Every `round(x, n)` of the SQL in the same way; `ROUND(x, n)` is left alone."""
    out, i = [], 0
    while (at := sql.find("round(", i)) >= 0:
        out.append(sql[i:at])
        depth, comma, j = 0, -1, at + 6
        while depth or sql[j] != ")":
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            comma = j if sql[j] == "," and depth == 0 else comma
            j += 1
        inner, digits = nudged(sql[at + 6 : comma]), int(sql[comma + 1 : j])
        out.append(f"round(({inner}) + {nudge(digits):.0e}, {digits})")
        i = j + 1
    return "".join(out) + sql[i:]


def portable(df: DataFrame, digits: int) -> DataFrame:
    """Types both engines print alike: zone-free timestamps, dates as text, doubles
    rounded, integers long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Adding zero turns a negative zero into a plain one.
            c = rnd(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, *, digits: int = 6):
    """Register `fn(tables) -> DataFrame` under `name`, with its SQL where one exists."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return portable(fn(Tables(spark, folder)), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = nudged(sql.strip())
        return fn

    return register
