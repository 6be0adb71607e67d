"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import time as T
from .inputs import (
    HOURLY,
    NOW,
    PREDICTIONS,
    RUNS,
    SHIP,
    WIDE,
    hourly,
    local_sql,
    ms_sql,
    predictions,
    runs,
    ship,
    utc_sql,
    wide,
    with_sql,
)
from .registry import query
from .sources import OUTAGES, outages


@query(
    "f1_cyclic_time",
    """SELECT event_id, CAST(isodow(ts) AS BIGINT) AS day_of_week, CAST(hour(ts) AS BIGINT) AS hour, CAST(year(ts) AS BIGINT) AS year,
              round(sin(2 * pi() * isodow(ts) / 7), 6) AS day_of_week_sin, round(cos(2 * pi() * isodow(ts) / 7), 6) AS day_of_week_cos,
              round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos FROM events""",
)
def f1(t):
    return T.cyclic_time(t.events.select("event_id", "ts")).drop("ts")


@query(
    "f2_f3_calendar_parts",
    "SELECT o_orderkey, CAST(isodow(o_orderdate) AS BIGINT) AS weekday_1, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS weekday_0, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(hour(o_orderdate) AS BIGINT) AS hour FROM orders",
)
def f2(t):
    d = "o_orderdate"
    return t.orders.select(
        "o_orderkey", T.iso_weekday(d).alias("weekday_1"), F.weekday(d).alias("weekday_0"), F.year(d).alias("year"), F.month(d).alias("month"), F.hour(d).alias("hour")
    )


@query("f4_utc_iso_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def f4(t):
    return t.events.select("event_id", T.utc_iso("ts").alias("iso"))


@query(
    "f5_f30_coercing_parse",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS ts, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events",
)
def f5(t):
    """Errors have text that is no time, clicks text that is no number, views an epoch."""
    sec = F.date_trunc("second", "ts")
    at = F.when(F.col("event_type") == "error", "soon").when(F.col("event_type") == "view", F.unix_millis(sec).cast("string"))
    at = at.otherwise(F.concat(F.date_format(sec + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    v = F.when(F.col("event_type") == "click", "NaN").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", T.parse_utc(at).alias("ts"), S.number(v).alias("value"))


@query(
    "f6_floor_and_ceil",
    "SELECT event_id, date_trunc('day', ts) AS day, date_trunc('hour', ts) AS hour, date_trunc('hour', ts + INTERVAL '3599.999999' SECOND) AS next_hour FROM events",
)
def f6(t):
    return t.events.select("event_id", T.floor_day("ts").alias("day"), T.floor_hour("ts").alias("hour"), T.ceil_hour("ts").alias("next_hour"))


@query("f7_f8_epoch_ms", f"SELECT event_id, {ms_sql('ts')} AS ms, date_trunc('millisecond', ts) AS back FROM events")
def f7(t):
    return t.events.select("event_id", T.epoch_ms("ts").alias("ms"), T.from_epoch_ms(T.epoch_ms("ts")).alias("back"))


@query(
    "f9_electricity_day",
    with_sql(
        f"""SELECT series_id, ts, CAST(d AS VARCHAR) AS day, {utc_sql('CAST(d AS TIMESTAMP)')} + INTERVAL 1 HOUR AS day_start,
                   {utc_sql('CAST(d AS TIMESTAMP) + INTERVAL 1 DAY')} + INTERVAL 1 HOUR AS day_end
            FROM (SELECT *, CAST({local_sql('ts - INTERVAL 1 HOUR')} AS DATE) AS d FROM ship)""",
        SHIP,
    ),
)
def f9(t):
    return ship(t).select("series_id", "ts", T.electricity_day("ts").alias("day")).withColumns(
        {"day_start": T.electricity_day_start("day"), "day_end": T.electricity_day_end("day")}
    )


@query("f10_local_midnight", f"SELECT DISTINCT o_orderdate AS day, {utc_sql('o_orderdate')} AS midnight FROM orders")
def f10(t):
    return t.orders.select(F.col("o_orderdate").alias("day"), T.local_midnight(F.to_date("o_orderdate")).alias("midnight")).distinct()


@query("f11_local_time", with_sql(f"SELECT series_id, ts, {local_sql('ts')} AS wall, CAST(hour({local_sql('ts')}) AS BIGINT) AS local_hour, CAST(CAST({local_sql('ts')} AS DATE) AS VARCHAR) AS local_date FROM ship", SHIP))
def f11(t):
    return ship(t).select("series_id", "ts", T.local_time("ts").alias("wall"), T.local_hour("ts").alias("local_hour"), T.local_date("ts").alias("local_date"))


@query("f12_clip", "SELECT event_id, CASE WHEN value > 1 THEN least(greatest(value, 10), 100) END AS clipped, CASE WHEN value > 1 THEN round(greatest(value - 30, 0), 6) END AS floored FROM events")
def f12(t):
    v = F.when(F.col("value") > 1, F.col("value"))
    return t.events.select("event_id", S.clip(v, 10, 100).alias("clipped"), S.clip(v - 30, 0).alias("floored"))


@query("f13_round", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice, 0) AS r0, ROUND(l_extendedprice, 1) AS r1, ROUND(l_extendedprice, 2) AS r2 FROM lineitem")
def f13(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", *[F.round("l_extendedprice", d).alias(f"r{d}") for d in (0, 1, 2)])


@query(
    "f14_wind_multiplier",
    "SELECT event_id, round(CASE WHEN value > 1 THEN 1.0 + (1004.1304 - least(greatest(value * 20, 412.8883), 1004.1304)) / (1004.1304 - 412.8883) * 0.334 END, 6) AS multiplier FROM events",
)
def f14(t):
    return t.events.select("event_id", S.wind_multiplier(F.when(F.col("value") > 1, F.col("value") * 20)).alias("multiplier"))


@query(
    "f15_weather_condition",
    """SELECT s AS symbol, CASE WHEN s = 1 THEN 'clear-day' WHEN s = 2 THEN 'partly-cloudy-day' WHEN s IN (3, 91, 92) THEN 'overcast-day'
         WHEN s IN (21, 22, 23, 31, 32, 33) THEN 'rain' WHEN s IN (41, 42, 43, 51, 52, 53, 71, 72, 73, 81, 82, 83) THEN 'snow'
         WHEN s IN (61, 62, 63, 64) THEN 'thunderstorms-day' END AS condition, count(*) AS n
       FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS s FROM events) GROUP BY 1, 2""",
)
def f15(t):
    """The counter in the event properties, 0 to 99, read as a weather symbol."""
    s = t.events.select(F.get_json_object("props", "$.k").cast("long").alias("symbol"))
    return s.groupBy("symbol", S.weather_condition("symbol").alias("condition")).agg(F.count(F.lit(1)).alias("n"))


@query("f16_wind_level", "SELECT event_id, CASE WHEN value * 40 < 1000 THEN 'calm' WHEN value * 40 < 2500 THEN 'weak' WHEN value * 40 <= 3000 THEN 'normal' ELSE 'strong' END AS level FROM events")
def f16(t):
    return t.events.select("event_id", S.wind_level(F.col("value") * 40).alias("level"))


@query("f17_price_band", "SELECT event_id, CASE WHEN value <= 5 THEN 0 WHEN value <= 10 THEN 1 WHEN value <= 15 THEN 2 WHEN value <= 20 THEN 3 WHEN value <= 30 THEN 4 ELSE 5 END AS band FROM events")
def f17(t):
    return t.events.select("event_id", S.price_band("value").alias("band"))


@query(
    "f18_feature_group",
    """SELECT name, CASE WHEN name IN ('NuclearPowerMW', 'WindPowerMW') THEN 'generation' WHEN name LIKE 't\\_%' ESCAPE '\\' THEN 'temperature'
         WHEN name LIKE 'ws\\_%' ESCAPE '\\' THEN 'wind_speed' WHEN name LIKE 'eu\\_ws\\_%' ESCAPE '\\' THEN 'baltic_wind' WHEN name LIKE 'Hydro%' THEN 'hydrology' ELSE 'calendar' END AS feature_group, count(*) AS n
       FROM (SELECT CASE user_id % 6 WHEN 0 THEN 't_' || user_id WHEN 1 THEN 'ws_' || user_id WHEN 2 THEN 'eu_ws_' || user_id WHEN 3 THEN 'Hydro' || user_id WHEN 4 THEN 'WindPowerMW' ELSE 'hour_sin' END AS name FROM events) GROUP BY 1, 2""",
)
def f18(t):
    """Feature names made of the user ids in every family."""
    u, k = F.col("user_id").cast("string"), F.col("user_id") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("t_"), u)).when(k == 1, F.concat(F.lit("ws_"), u)).when(k == 2, F.concat(F.lit("eu_ws_"), u))
        .when(k == 3, F.concat(F.lit("Hydro"), u)).when(k == 4, "WindPowerMW").otherwise("hour_sin")
    )
    return t.events.select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("feature_group", S.feature_group("name"))


@query(
    "f19_true_forecast",
    with_sql(
        f"""SELECT p.run_id, p.ts, r.run_datetime, CAST({local_sql('p.ts')} AS DATE) > CAST({local_sql('r.run_datetime')} AS DATE)
              + CASE WHEN hour({local_sql('r.run_datetime')}) >= 14 THEN 1 ELSE 0 END AS is_true FROM predictions p JOIN runs r USING (run_id)""",
        PREDICTIONS, RUNS,
    ),
)
def f19(t):
    j = predictions(t).select("run_id", "ts").join(runs(t), "run_id")
    return j.withColumn("is_true", T.is_true_forecast("run_datetime", "ts"))


@query(
    "f20_risk_start",
    with_sql(
        f"""SELECT run_id, {utc_sql(f"date_trunc('day', {local_sql('up')}) + CASE WHEN hour({local_sql('up')}) < 14 THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END + INTERVAL 1 HOUR")} AS risk_start
            FROM (SELECT run_id, date_trunc('hour', run_datetime + INTERVAL 25 MINUTE + INTERVAL '3599.999999' SECOND) AS up FROM runs)""",
        RUNS,
    ),
)
def f20(t):
    """For every run of seven years, the first instant of the still unknown day."""
    return runs(t).select("run_id", T.risk_start(F.col("run_datetime") + F.expr("INTERVAL 25 MINUTES")).alias("risk_start"))


DAILY_RATIO = "SELECT CAST(ts AS DATE) AS date, var_samp(view) AS wv, avg(click) AS a, avg(error) AS b, avg(signup) AS c FROM wide GROUP BY 1"


@query(
    "f22_safe_ratio",
    with_sql(
        f""", d AS ({DAILY_RATIO}), r AS (SELECT date, CASE WHEN day(date) % 7 <> 0 THEN wv / (a + b + c + 1e-6) END AS x FROM d)
            SELECT CAST(date AS VARCHAR) AS date, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM r)), 6) AS impact FROM r""",
        WIDE,
    ),
)
def f22(t):
    """Every seventh day divides by zero; it gets the median of the others."""
    from ..operators.quantile import quantile_scalar

    d = wide(t).groupBy(F.to_date("ts").alias("date")).agg(
        F.var_samp("view").alias("wv"), (F.avg("click") + F.avg("error") + F.avg("signup")).alias("stable")
    )
    stable = F.when(F.dayofmonth("date") % 7 == 0, F.lit(-1e-6)).otherwise(F.col("stable"))
    r = d.select("date", S.safe_ratio("wv", stable, 1e-6).alias("impact"))
    return r.withColumn("impact", F.coalesce("impact", quantile_scalar(r, "impact", 0.5)))


@query("f23_production_share", with_sql("SELECT ts, round(click / nullif(error, 0), 6) AS share, round(click / nullif(error, 0) * error, 6) AS rescaled FROM wide", WIDE))
def f23(t):
    w = wide(t).select("ts", S.production_share("click", "error").alias("share"), "error")
    return w.select("ts", "share", (F.col("share") * F.col("error")).alias("rescaled"))


@query("f25_names", "SELECT DISTINCT o_orderdate AS day, strftime(o_orderdate, '%A') AS weekday, strftime(o_orderdate, '%B') AS month FROM orders")
def f25(t):
    return t.orders.select(F.col("o_orderdate").alias("day")).distinct().select("day", T.weekday_name("day").alias("weekday"), T.month_name("day").alias("month"))


@query("f26_start_hour_mask", with_sql(f"SELECT series_id, ts FROM hourly WHERE hour({local_sql('ts')}) >= 22 OR hour({local_sql('ts')}) <= 2", HOURLY))
def f26(t):
    return hourly(t).where(T.start_hour_mask(T.local_hour("ts"), 22, 2)).select("series_id", "ts")


@query("f27_lookahead_hours", with_sql(f"SELECT run_id, CAST(least(greatest(greatest(23 - hour({local_sql('run_datetime')}), 0) + 96, 1), 168) AS BIGINT) AS hours FROM runs", RUNS))
def f27(t):
    return runs(t).select("run_id", T.lookahead_hours_col(T.local_hour("run_datetime"), None).alias("hours"))


@query("f28_units", "SELECT event_id, round(value * 0.1, 6) AS ckwh, round(value * 125.5, 6) AS ckwh_vat, round(value * 0.001, 6) AS gw FROM events")
def f28(t):
    v = F.col("value")
    return t.events.select("event_id", (v * S.EUR_MWH_TO_CKWH).alias("ckwh"), (v * S.EUR_KWH_TO_CKWH_VAT).alias("ckwh_vat"), (v * S.MW_TO_GW).alias("gw"))


@query(
    "f29_strings",
    """SELECT c_custkey, lower(trim(c_name)) AS name, string_split(c_name, '#')[1] AS stem, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS number,
              starts_with(c_mktsegment, 'A') AS a_segment, c_mktsegment || '/' || c_nationkey AS path FROM customer""",
)
def f29(t):
    return t.customer.select(
        "c_custkey",
        F.lower(F.trim("c_name")).alias("name"),
        F.split("c_name", "#")[0].alias("stem"),
        F.regexp_extract("c_name", "([0-9]+)", 1).try_cast("long").alias("number"),
        F.col("c_mktsegment").startswith("A").alias("a_segment"),
        F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("path"),
    )


@query("f31_json_round_trip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS payload FROM events")
def f31(t):
    e = t.events.withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", "p.k", F.to_json("p").alias("payload"))


@query(
    "f32_arrays",
    with_sql("SELECT ts, len(v) AS present, round(coalesce(list_sum(v), 0), 6) AS total, round(list_max(v), 6) AS largest FROM (SELECT ts, list_filter([click, error, view], lambda x: x IS NOT NULL) AS v FROM wide)", WIDE),
)
def f32(t):
    w = wide(t).select("ts", S.row_values(["click", "error", "view"]).alias("v"))
    return w.select("ts", F.size("v").alias("present"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("v").alias("largest"))


@query("f33_last_days_list", with_sql("SELECT CAST(CAST(unnest(generate_series(CAST(now AS DATE) - 34, CAST(now AS DATE), INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS date FROM now_", NOW))
def f33(t):
    d = F.to_date(F.col("now"))
    latest = t.events.agg((F.date_trunc("hour", F.max("ts")) - F.expr("INTERVAL 7 DAYS")).alias("now"))
    return latest.select(F.explode(F.sequence(F.date_sub(d, 34), d)).alias("date"))


@query("f35_null_and_infinity", "SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN -1 ELSE value END AS value FROM events")
def f35(t):
    """Errors arrive as NaN, clicks as infinity."""
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("event_type") == "click", F.lit(float("inf"))).otherwise(F.col("value"))
    return t.events.select("event_id", F.coalesce(S.finite(v), F.lit(-1.0)).alias("value"))


@query("p9_outage_predicates", with_sql("SELECT event_type, count(*) AS n FROM outages GROUP BY 1", OUTAGES))
def p9(t):
    return outages(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
