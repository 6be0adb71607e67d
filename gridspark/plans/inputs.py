"""The series the queries run on, each as a DataFrame and as the same SQL expression.

events     event_type is the series; its raw rows are an irregular feed
hourly     hourly mean of the events per event type
wide       the same with one column per event type: the hourly store of one site
ship       hourly mean of the lineitem price per return flag over seven years, so that
           both clock changes of every year are covered
daily      daily mean order price per priority; the order status is the source
archive    an order is a forecast run, its lineitems are the predicted prices
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables
from .registry import rnd

TYPES = ["click", "error", "purchase", "signup", "view"]


def with_sql(body: str, *ctes: str) -> str:
    """A body that begins with a comma adds expressions of its own."""
    if not ctes:
        return body
    glue = "" if body.startswith(",") else " "
    return f"WITH {', '.join(ctes)}{glue}{body}"


def hourly(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts")).agg(
        rnd(F.avg("value"), 6).alias("value")
    )


HOURLY = """hourly AS (
    SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS value
    FROM events GROUP BY 1, 2)"""

# The same without rounding, for operators that roll up the raw events themselves.
HOURLY_RAW = HOURLY.replace("round(avg(value), 6)", "avg(value)")

GRID = """grid AS (
    SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY 1),
  gapped AS (
    SELECT g.series_id, g.ts, h.value FROM grid g LEFT JOIN hourly h USING (series_id, ts))"""


def wide(t: Tables) -> DataFrame:
    out = t.events.groupBy(F.date_trunc("hour", "ts").alias("ts")).pivot("event_type", TYPES).agg(F.avg("value"))
    return out.select("ts", *[rnd(F.col(c)).alias(c) for c in TYPES])


WIDE = (
    "wide AS (SELECT date_trunc('hour', ts) AS ts, "
    + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{c}'), 6) AS {c}" for c in TYPES)
    + " FROM events GROUP BY 1)"
)


def ship(t: Tables) -> DataFrame:
    hour = (F.col("l_quantity").cast("long") % 24).cast("int")
    ts = F.timestamp_seconds(F.unix_seconds("l_shipdate") + hour * 3600)
    return t.lineitem.groupBy(F.col("l_returnflag").alias("series_id"), ts.alias("ts")).agg(
        rnd(F.avg("l_extendedprice") / 1000, 9).alias("value")
    )


SHIP = """ship AS (
    SELECT l_returnflag AS series_id,
           l_shipdate + to_hours(CAST(l_quantity AS BIGINT) % 24) AS ts,
           round(avg(l_extendedprice) / 1000, 9) AS value
    FROM lineitem GROUP BY 1, 2)"""

SHIP_GRID = """ship_grid AS (
    SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM ship GROUP BY 1),
  ship_gapped AS (
    SELECT g.series_id, g.ts, s.value FROM ship_grid g LEFT JOIN ship s USING (series_id, ts))"""


def daily(t: Tables) -> DataFrame:
    return t.orders.groupBy(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderdate").alias("ts")
    ).agg(rnd(F.avg("o_totalprice"), 6).alias("value"))


DAILY = """daily AS (
    SELECT o_orderpriority AS series_id, o_orderstatus AS source, o_orderdate AS ts,
           round(avg(o_totalprice), 6) AS value
    FROM orders GROUP BY 1, 2, 3)"""


def source(t: Tables, status: str) -> DataFrame:
    """Daily series of one source: F is the store, O the fresh feed, P the backup."""
    return daily(t).where(F.col("source") == status).drop("source")


def runs(t: Tables) -> DataFrame:
    """One run per order, started between 11 and 23 o'clock by its priority."""
    hour = 8 + 3 * F.substring("o_orderpriority", 1, 1).cast("int")
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.timestamp_seconds(F.unix_seconds("o_orderdate") + hour * 3600).alias("run_datetime"),
    )


RUNS = """runs AS (
    SELECT o_orderkey AS run_id,
           o_orderdate + to_hours(8 + 3 * CAST(substr(o_orderpriority, 1, 1) AS BIGINT)) AS run_datetime
    FROM orders)"""


def predictions(t: Tables) -> DataFrame:
    """Predicted and, for finished lines, archived actual price per run and day."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("ts")).agg(
        rnd(F.avg("l_extendedprice"), 6).alias("predicted"),
        rnd(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") * (1 - F.col("l_discount")))), 6).alias("actual"),
    )


PREDICTIONS = """predictions AS (
    SELECT l_orderkey AS run_id, l_shipdate AS ts, round(avg(l_extendedprice), 6) AS predicted,
           round(avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) END), 6) AS actual
    FROM lineitem GROUP BY 1, 2)"""


def actuals(t: Tables) -> DataFrame:
    """Canonical price per day: the mean price of finished orders."""
    return t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_orderdate").alias("ts")).agg(
        rnd(F.avg("o_totalprice") / 5, 6).alias("actual")
    )


ACTUALS = """actuals AS (
    SELECT o_orderdate AS ts, round(avg(o_totalprice) / 5, 6) AS actual
    FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


def now(t: Tables):
    """Hour-aligned instant a week before the last event, as a scalar subquery."""
    return t.events.agg((F.date_trunc("hour", F.max("ts")) - F.expr("INTERVAL 7 DAYS")).alias("now")).scalar()


NOW = "now_ AS (SELECT date_trunc('hour', max(ts)) - INTERVAL 7 DAY AS now FROM events)"

TZ = "Europe/Helsinki"


def local_sql(ts: str) -> str:
    """Wall time of a UTC timestamp in SQL."""
    return f"timezone('{TZ}', timezone('UTC', {ts}))"


def utc_sql(wall: str) -> str:
    """UTC timestamp of a wall time in SQL."""
    return f"timezone('UTC', timezone('{TZ}', {wall}))"


def ms_sql(ts: str) -> str:
    return f"CAST(epoch_us({ts}) // 1000 AS BIGINT)"
