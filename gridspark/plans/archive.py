"""Forecast archive, store writes and published files."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import archive as ar
from ..operators import patch
from ..session import scratch_path
from ..sinks import publish
from ..sinks.archive import Archive
from ..sinks.store import append_model_stats, dump_csv, model_stats, upsert, write_store
from ..sources.store import read_csv_table, read_store
from .aggregates import CONDITION_DAYS, SYMBOL_INPUT, SYMBOL_ROWS, WIND_DAYS, symbols
from .inputs import (
    ACTUALS,
    DAILY,
    HOURLY,
    NOW,
    PREDICTIONS,
    RUNS,
    SHIP,
    WIDE,
    actuals,
    hourly,
    local_sql,
    ms_sql,
    now,
    predictions,
    runs,
    ship,
    utc_sql,
    wide,
    with_sql,
)
from .joins import BATCH, FRESH, SNAPSHOTS, STORE, batch_rows, snapshots, source
from .registry import query
from .sources import OUTAGES, outages

SCORED = """scored AS (SELECT p.run_id, p.ts, p.predicted, coalesce(a.actual, p.actual) AS actual FROM predictions p LEFT JOIN actuals a USING (ts))"""
METRICS = """count(actual) AS n_scored, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 4) AS rmse,
    round(avg(abs(predicted - actual) / (abs(actual) + 1e-10) * 100), 4) AS mape"""


def ranges(t):
    """One overlapping range per month of the orders: from the third day, 06:00, on."""
    m = t.orders.select(F.date_trunc("month", "o_orderdate").alias("m")).distinct()
    first = F.unix_seconds("m")
    # Ranges are one per month, so numbering them by their month count is bounded.
    rid = (F.year("m") * 12 + F.month("m") - 1).cast("long")
    return m.select(
        rid.alias("range_id"),
        F.timestamp_seconds(first + 2 * 86400 + 6 * 3600).alias("start"),
        F.timestamp_seconds(first + 45 * 86400).alias("end"),
    )


RANGES = """ranges AS (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS range_id, date_trunc('month', o_orderdate) + INTERVAL 54 HOUR AS start,
    date_trunc('month', o_orderdate) + INTERVAL 45 DAY AS "end" FROM orders)"""


@query("j15_archive_join_chain", with_sql("SELECT s.run_id, s.ts, s.predicted, s.actual, r.run_datetime FROM scored s JOIN runs r USING (run_id) WHERE s.ts IN (SELECT DISTINCT o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT')", PREDICTIONS, ACTUALS, RUNS, SCORED))
def x5(t):
    wanted = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").alias("ts"))
    return ar.get_predictions(runs(t), predictions(t), actuals(t), wanted)


@query(
    "x6_range_errors",
    with_sql(
        f"""SELECT r.range_id, r.start, r."end", {METRICS} FROM ranges r JOIN scored s ON s.ts BETWEEN r.start AND r."end" AND s.actual IS NOT NULL GROUP BY 1, 2, 3
            UNION ALL SELECT range_id, start, "end", NULL, NULL, NULL, NULL FROM ranges r WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.ts BETWEEN r.start AND r."end" AND s.actual IS NOT NULL)""",
        PREDICTIONS, ACTUALS, SCORED, RANGES,
    ),
    digits=4,
)
def x6(t):
    """All ranges in one pass, over all runs."""
    return ar.range_errors(predictions(t), actuals(t), ranges(t))


TRUE = f"""CAST({local_sql('s.ts')} AS DATE) > CAST({local_sql('r.run_datetime')} AS DATE) + CASE WHEN hour({local_sql('r.run_datetime')}) >= 14 THEN 1 ELSE 0 END"""


@query(
    "x8_true_forecast_errors",
    with_sql(
        f""", tf AS (SELECT s.* FROM scored s JOIN runs r USING (run_id) WHERE {TRUE} AND s.actual IS NOT NULL)
            SELECT r.range_id, r.start, r."end", {METRICS.replace('count(actual)', 'nullif(count(actual), 0)')} FROM ranges r LEFT JOIN tf s ON s.ts BETWEEN r.start AND r."end" GROUP BY 1, 2, 3""",
        PREDICTIONS, ACTUALS, RUNS, SCORED, RANGES,
    ),
    digits=4,
)
def x8(t):
    return ar.range_errors(predictions(t), actuals(t), ranges(t), runs=runs(t), true_forecasts_only=True)


@query(
    "x8_lead_time_errors",
    with_sql(
        f"""SELECT CAST(floor((epoch(s.ts) - epoch(r.run_datetime)) / 2592000.0) AS BIGINT) AS lead_bucket, {METRICS}
            FROM scored s JOIN runs r USING (run_id) WHERE {TRUE} AND s.actual IS NOT NULL GROUP BY 1""",
        PREDICTIONS, ACTUALS, RUNS, SCORED,
    ),
    digits=4,
)
def x8_lead(t):
    return ar.lead_time_errors(runs(t), predictions(t), actuals(t), bucket_hours=720)


@query("x7_run_info", with_sql("SELECT run_id, run_datetime, coalesce(n, 0) AS prediction_count FROM runs LEFT JOIN (SELECT run_id, count(*) AS n FROM predictions GROUP BY 1) USING (run_id)", RUNS, PREDICTIONS))
def x7(t):
    return ar.run_info(runs(t), predictions(t))


@query(
    "x3_upsert_actuals",
    """SELECT date_trunc('hour', ts) AS ts, arg_max(value, ts) AS actual, max(ts) AS updated_at, arg_max(event_type, ts) AS source
       FROM events WHERE value >= 2 GROUP BY 1""",
)
def x3(t):
    """Purchases are the held actuals, all other events later updates; the latest wins."""
    rows = t.events.select(F.date_trunc("hour", "ts").alias("ts"), F.when(F.col("value") >= 2, F.col("value")).alias("actual"), F.col("ts").alias("updated_at"), F.col("event_type").alias("source"))
    held = rows.where("source = 'purchase' AND actual IS NOT NULL")
    return ar.upsert_actuals(held, rows.where("source <> 'purchase'"))


@query(
    "x2_archive_snapshots",
    with_sql(
        """SELECT 1 AS run_id, ts, view AS predicted, CASE WHEN purchase > 50 THEN purchase END AS actual, NULL AS extra FROM wide WHERE view IS NOT NULL
           UNION ALL SELECT 2, ts, round(view + 1, 6), CASE WHEN purchase > 50 THEN purchase END, click FROM wide WHERE view IS NOT NULL""",
        WIDE,
    ),
)
def x2(t):
    """Two runs archived on storage, the second with a new column, read back merged."""
    a = Archive(t.spark, scratch_path(t.spark, "archive"))
    frame = wide(t).where("view IS NOT NULL").select("ts", F.col("view").alias("predicted"), F.when(F.col("purchase") > 50, F.col("purchase")).alias("actual"), F.col("click").alias("extra"))
    a.insert_snapshot(frame.drop("extra"), datetime(2024, 2, 1, tzinfo=timezone.utc))
    a.insert_snapshot(frame.withColumn("predicted", F.col("predicted") + 1), datetime(2024, 2, 2, tzinfo=timezone.utc))
    return a.predictions().select("run_id", "ts", "predicted", "actual", "extra")


@query("x1_x4_schema_migration", with_sql("SELECT count(*) AS rows, count(click) AS click FROM (SELECT ts, view, NULL::DOUBLE AS click FROM wide WHERE view IS NOT NULL)", WIDE))
def x4(t):
    """Columns of the store added to an existing archive; repeating it changes nothing."""
    a = Archive(t.spark, scratch_path(t.spark, "archive"))
    a.insert_snapshot(wide(t).where("view IS NOT NULL").select("ts", F.col("view").alias("predicted")), datetime(2024, 2, 1, tzinfo=timezone.utc))
    first, again = a.migrate(wide(t)), a.migrate(wide(t))
    if again["missing_columns"] or "click" not in first["added_columns"]:
        raise RuntimeError("migration is not idempotent")
    return a.predictions().agg(F.count(F.lit(1)).alias("rows"), F.count("click").alias("click"))


@query("k1_upsert_on_storage", with_sql("SELECT coalesce(s.series_id, f.series_id) AS series_id, coalesce(s.ts, f.ts) AS ts, coalesce(f.value, s.value) AS value FROM store s FULL JOIN batch f ON f.series_id = s.series_id AND f.ts = s.ts", DAILY, STORE, FRESH, BATCH))
def k1_storage(t):
    """Store and batch cut to one partition per year, then read back."""
    path = scratch_path(t.spark, "upsert")
    yearly = lambda df: df.withColumn("year", F.date_trunc("year", "ts"))
    write_store(yearly(source(t, "F")), path, "year")
    upsert(t.spark, path, yearly(batch_rows(t)), ["series_id", "ts"], ts="year")
    return read_store(t.spark, path).select("series_id", "ts", "value")


@query("k4_table_dump", with_sql("SELECT * FROM wide", WIDE))
def k4(t):
    path = scratch_path(t.spark, "dump")
    w = wide(t)
    dump_csv(w.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), path)
    cols = ", ".join(f"{c} double" for c in w.columns if c != "ts")
    back = read_csv_table(t.spark, path, f"ts string, {cols}")
    return back.withColumn("ts", F.to_timestamp("ts"))


@query("k8_daily_snapshots", with_sql("SELECT CAST(CAST(date_trunc('year', day) AS DATE) AS VARCHAR) AS snapshot_date, ts, round(CASE WHEN year(day) >= 1999 THEN value + 1 ELSE value END, 6) AS value FROM snapshots", SNAPSHOTS))
def k8(t):
    """A snapshot per year; those from 1999 on are written again.  The last write of a
    snapshot wins and the others stay."""
    path = scratch_path(t.spark, "snapshots")
    s = snapshots(t)
    day = F.trunc(F.col("snapshot_date").cast("date"), "year")
    publish.write_snapshot(s, path, day)
    again = s.where("snapshot_date >= '1999-01-01'").withColumn("value", F.col("value") + 1)
    publish.write_snapshot(again, path, day)
    return t.spark.read.schema("ts timestamp, value double, snapshot_date string").parquet(path)


@query(
    "k11_daily_weather_json",
    with_sql("SELECT CAST(local_date AS VARCHAR) AS local_date, condition FROM cond", SYMBOL_INPUT, SYMBOL_ROWS, CONDITION_DAYS),
)
def k11(t):
    from ..operators.weather import representative_condition

    path = scratch_path(t.spark, "weather")
    publish.write_json(representative_condition(symbols(t)), path)
    return t.spark.read.schema("local_date string, condition string").json(path)


@query(
    "k11_weather_records_json",
    with_sql(
        f"""SELECT {ms_sql(utc_sql('CAST(local_date AS TIMESTAMP)') + ' + INTERVAL 12 HOUR')} AS timestamp, condition, wind_level AS "windLevel"
            FROM cond JOIN levels USING (local_date) WHERE series_id = 'click' AND wind_level IS NOT NULL""",
        HOURLY, SYMBOL_INPUT, SYMBOL_ROWS, CONDITION_DAYS, WIND_DAYS,
    ),
)
def k11_records(t):
    """The published records of all days: noon, condition and wind level."""
    from ..operators.weather import daily_weather

    path = scratch_path(t.spark, "weather-records")
    winds = hourly(t).where("series_id = 'click'").select("ts", (F.col("value") * 50).alias("wind"))
    first = t.events.agg(F.min("ts")).scalar()
    days = t.events.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] + 3
    records = daily_weather(symbols(t), winds, first, days=days)
    publish.write_json(records.select(F.col("noon_ms").alias("timestamp"), "condition", F.col("wind_level").alias("windLevel")), path)
    return t.spark.read.schema("timestamp long, condition string, windLevel string").json(path)


@query(
    "k12_daily_means_json",
    with_sql(
        f"""SELECT CAST(date AS VARCHAR) AS date, m AS click_mean FROM (
              SELECT CAST(ts AS DATE) AS date, ROUND(avg(click), 1) AS m FROM wide GROUP BY 1), now_
            WHERE date >= CAST({local_sql('now')} AS DATE) ORDER BY date LIMIT 6""",
        WIDE, NOW,
    ),
)
def k12(t):
    """The published record holds today and the days after it, six at most."""
    from ..functions.time import MARKET_TZ
    from ..operators.rollup import next_days_mean

    path = scratch_path(t.spark, "imports")
    today = F.to_date(F.from_utc_timestamp(now(t), MARKET_TZ))
    publish.write_json(next_days_mean(wide(t), "click", today), path)
    return t.spark.read.schema("date string, click_mean double").json(path)


@query(
    "k14_feature_profile_json",
    with_sql(
        """, e AS (SELECT * FROM wide WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL)
           SELECT feature, round(avg(v), 6) AS mean, round(coalesce(corr(v, purchase), 0), 6) AS correlation FROM (
             SELECT 'click' AS feature, click AS v, purchase FROM e UNION ALL SELECT 'error', error, purchase FROM e) GROUP BY 1""",
        WIDE,
    ),
)
def k14(t):
    from ..operators.serving import feature_profile

    path = scratch_path(t.spark, "profile")
    publish.write_json(feature_profile(wide(t), ["click", "error"], "purchase"), path)
    return t.spark.read.schema("feature string, mean double, correlation double").json(path)


@query(
    "k18_daily_statistics_csv",
    with_sql(
        """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, ROUND(avg(view), 1) AS view_mean, ROUND(avg(purchase), 1) AS purchase_mean, ROUND(avg(view) - avg(purchase), 1) AS error
           FROM wide WHERE ts >= (SELECT max(ts) - INTERVAL 15 DAY FROM wide) GROUP BY 1""",
        WIDE,
    ),
)
def k18(t):
    from ..operators.rollup import predicted_vs_actual_daily

    path = scratch_path(t.spark, "daily-statistics")
    stats = predicted_vs_actual_daily(wide(t), "purchase", "view")
    publish.write_csv(stats.select("date", "view_mean", "purchase_mean", "error"), path)
    return read_csv_table(t.spark, path, "date string, view_mean double, purchase_mean double, error double")


@query("k13_outages_json", with_sql('SELECT event_id, start, "end", avail_qty FROM outages', OUTAGES))
def k13_json(t):
    path = scratch_path(t.spark, "outages")
    publish.write_json(outages(t).select("event_id", "start", "end", "avail_qty"), path)
    return t.spark.read.schema("event_id long, start timestamp, `end` timestamp, avail_qty double").json(path)


@query(
    "k13_open_outages_json",
    with_sql('SELECT event_id, start, "end", avail_qty, nominal_power, round(avail_qty / nominal_power, 6) AS availability FROM outages, now_ WHERE "end" > now', OUTAGES, NOW),
)
def k13_open(t):
    """The published record: ongoing and future outages with their availability."""
    path = scratch_path(t.spark, "open-outages")
    publish.write_json(publish.outage_records(outages(t), now(t)).select("event_id", "start", "end", "avail_qty", "nominal_power", "availability"), path)
    return t.spark.read.schema("event_id long, start timestamp, `end` timestamp, avail_qty double, nominal_power double, availability double").json(path)


@query("k17_series_csv", with_sql("SELECT series_id, ts, round(value, 6) AS value FROM ship", SHIP))
def k17(t):
    path = scratch_path(t.spark, "series")
    publish.write_csv(ship(t).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), path)
    return read_csv_table(t.spark, path, "series_id string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))


@query(
    "k16_model_stats",
    with_sql("SELECT o_orderdate AS training_timestamp, round(avg(o_totalprice), 2) AS mae, count(*) AS n FROM orders GROUP BY 1"),
    digits=2,
)
def k16(t):
    """One training run per order date, appended in two halves, listed newest first."""
    path = scratch_path(t.spark, "model-stats")
    stats = t.orders.groupBy(F.col("o_orderdate").alias("training_timestamp")).agg(F.avg("o_totalprice").alias("mae"), F.count(F.lit(1)).alias("n"))
    old = F.col("training_timestamp") < "1998-01-01"
    append_model_stats(stats.where(old), path)
    append_model_stats(stats.where(~old), path)
    return model_stats(t.spark, path)


@query(
    "c17_brief_lookup",
    with_sql(
        f"""SELECT CAST(d AS VARCHAR) AS local_date, ROUND(min(p), 1) AS price_min, ROUND(max(p), 1) AS price_max, ROUND(avg(p), 1) AS price_mean,
              ROUND(min(wind), 0) AS wind_min, ROUND(max(wind), 0) AS wind_max, ROUND(avg(wind), 0) AS wind_mean,
              ROUND(avg(temp), 1) AS temperature_mean, bool_or(holiday <> 0) AS holiday_any, strftime(d, '%A') AS weekday
            FROM (SELECT CAST({local_sql('ts')} AS DATE) AS d, coalesce(purchase, view) AS p, click * 50 AS wind,
                         (error + signup) / 2 AS temp, CASE WHEN signup > 150 THEN 1 ELSE 0 END AS holiday
                  FROM wide, now_ WHERE ts >= now AND view IS NOT NULL AND click IS NOT NULL AND error IS NOT NULL AND signup IS NOT NULL) GROUP BY d""",
        WIDE, NOW,
    ),
)
def c17(t):
    """The stored hours from now on, looked up by their times and told by day."""
    from ..operators.serving import brief_table
    from ..sources.store import lookup

    store = wide(t).withColumns({"wind": F.col("click") * 50, "holiday": F.when(F.col("signup") > 150, 1).otherwise(0)})
    wanted = t.events.select(F.date_trunc("hour", "ts").alias("ts")).distinct().where(F.col("ts") >= now(t))
    return brief_table(lookup(store, wanted), "purchase", "view", "wind", ["error", "signup"], "holiday")


@query("u1_wide_union_allowing_missing", with_sql("SELECT ts, click, error, NULL::DOUBLE AS view FROM wide UNION ALL SELECT ts, click, NULL, view FROM wide", WIDE))
def u1_wide(t):
    w = wide(t)
    return patch.union_all(w.select("ts", "click", "error"), w.select("ts", "click", "view"))

