"""Aggregations, quality checks and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import row_mean, row_variance
from ..functions.time import MARKET_TZ
from ..operators import metrics, quality, quantile, rollup, serving, weather, windows
from ..operators.spine import complete_grid
from .inputs import (
    GRID,
    HOURLY,
    HOURLY_RAW,
    NOW,
    SHIP,
    TYPES,
    WIDE,
    hourly,
    local_sql,
    ms_sql,
    now,
    predictions,
    ship,
    utc_sql,
    wide,
    with_sql,
)
from .registry import query, rnd
from .sources import OUTAGES, outages


@query("a1_hourly_mean", with_sql("SELECT series_id, ts, round(value, 6) AS value FROM gapped", HOURLY_RAW, GRID))
def a1(t):
    rows = t.events.select(F.col("event_type").alias("series_id"), "ts", "value")
    return rollup.resample_hourly(rows, "series_id")


@query(
    "a2_across_locations",
    with_sql(
        """SELECT ts, round(coalesce(sum(value), 0), 6) AS sum_value, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value,
                  min(value) AS min_value, max(value) AS max_value FROM gapped GROUP BY 1""",
        HOURLY, GRID,
    ),
)
def a2(t):
    return rollup.across_locations(complete_grid(hourly(t), "series_id"))


@query(
    "a3_total_capacity",
    with_sql(
        """, zeroed AS (SELECT ts, CASE WHEN click > 25 THEN click ELSE 0 END AS click, CASE WHEN error > 25 THEN error ELSE 0 END AS error FROM wide),
             s AS (SELECT ts, click, error, coalesce(click, 0) + coalesce(error, 0) AS total FROM zeroed)
           SELECT ts, click, error, round(coalesce(last_value(nullif(total, 0) IGNORE NULLS) OVER (ORDER BY ts), total), 6) AS total FROM s""",
        WIDE,
    ),
)
def a3(t):
    """Small hourly values become zero flows; a zero total repeats the last non-zero."""
    h = hourly(t).withColumnRenamed("series_id", "border")
    flows = h.where("border IN ('click', 'error')").withColumn("value", F.when(F.col("value") > 25, F.col("value")).otherwise(0.0))
    every = wide(t).select("ts")
    total = rollup.total_capacity(flows.unionByName(every.select("ts", F.lit("click").alias("border"), F.lit(None).cast("double").alias("value")).join(flows.select("ts"), "ts", "left_anti")), ["click", "error"])
    return total.select("ts", F.coalesce("click", F.lit(0.0)).alias("click"), F.coalesce("error", F.lit(0.0)).alias("error"), "total")


DAILY_FEATURES = """daily_features AS (
    SELECT CAST(ts AS DATE) AS date, avg(click) AS nuclear_mean, var_samp(click) AS nuclear_var, avg(error) AS imports_mean, var_samp(error) AS imports_var,
           avg(view) AS wind_mean, var_samp(view) AS wind_var, avg(signup) AS solar_mean, var_samp(signup) AS solar_var,
           max(CASE WHEN signup > 150 THEN 1 ELSE 0 END) AS holiday_max FROM wide GROUP BY 1)"""


def energy_frame(t):
    """The hourly store of one site under the names the daily model uses."""
    w = wide(t).withColumnsRenamed({"click": "nuclear", "error": "imports", "view": "wind", "signup": "solar", "purchase": "price"})
    return w.withColumn("holiday", F.when(F.col("solar") > 150, 1).otherwise(0))


def daily_model_features(t):
    return rollup.daily_features(energy_frame(t), ["nuclear", "imports", "wind", "solar"], "holiday")


_DF = ["nuclear", "imports", "wind", "solar"]


@query(
    "a4_daily_features",
    with_sql(
        "SELECT CAST(date AS VARCHAR) AS date, "
        + ", ".join(f"round({c}_{k}, 6) AS {c}_{k}" for c in _DF for k in ("mean", "var"))
        + ", CAST(holiday_max AS BIGINT) AS holiday_max FROM daily_features",
        WIDE, DAILY_FEATURES,
    ),
)
def a4(t):
    return daily_model_features(t)


@query(
    "a5_volatility_label",
    with_sql(
        """, d AS (SELECT CAST(ts AS DATE) AS date, var_samp(purchase) AS v FROM wide GROUP BY 1)
           SELECT CAST(date AS VARCHAR) AS date, round(v, 6) AS price_variance,
                  coalesce(v >= (SELECT quantile_cont(v, 0.8) FROM d), false) AS volatile FROM d""",
        WIDE,
    ),
)
def a5(t):
    return rollup.volatility_label(wide(t), "purchase")


@query(
    "a6_next_days_mean",
    with_sql(
        f"""SELECT CAST(date AS VARCHAR) AS date, m AS click_mean FROM (
              SELECT CAST(ts AS DATE) AS date, ROUND(avg(click), 1) AS m FROM wide GROUP BY 1), now_
            WHERE date >= CAST({local_sql('now')} AS DATE) ORDER BY date LIMIT 6""",
        WIDE, NOW,
    ),
)
def a6(t):
    at = now(t)
    return rollup.next_days_mean(wide(t), "click", F.to_date(F.from_utc_timestamp(at, MARKET_TZ)))


@query(
    "a7_local_day_mean",
    with_sql(
        f"""SELECT series_id, CAST(d AS VARCHAR) AS local_date, round(avg(value), 6) AS value, {utc_sql('CAST(d AS TIMESTAMP)')} AS day_start
            FROM (SELECT *, CAST({local_sql('ts')} AS DATE) AS d FROM ship) GROUP BY series_id, d""",
        SHIP,
    ),
)
def a7(t):
    """Seven years, so both clock changes of each year are inside."""
    return rollup.local_day_mean(ship(t), "value", "series_id")


@query(
    "a8_daily_brief",
    with_sql(
        f"""SELECT CAST(d AS VARCHAR) AS local_date, ROUND(min(p), 1) AS price_min, ROUND(max(p), 1) AS price_max, ROUND(avg(p), 1) AS price_mean,
              ROUND(min(wind), 0) AS wind_min, ROUND(max(wind), 0) AS wind_max, ROUND(avg(wind), 0) AS wind_mean,
              ROUND(avg(temp), 1) AS temperature_mean, bool_or(holiday <> 0) AS holiday_any, strftime(d, '%A') AS weekday
            FROM (SELECT CAST({local_sql('ts')} AS DATE) AS d, coalesce(purchase, view) AS p, click * 50 AS wind,
                         (error + signup) / 2 AS temp, CASE WHEN signup > 150 THEN 1 ELSE 0 END AS holiday
                  FROM wide WHERE view IS NOT NULL AND click IS NOT NULL AND error IS NOT NULL AND signup IS NOT NULL) GROUP BY d""",
        WIDE,
    ),
)
def a8(t):
    w = wide(t).withColumns({"wind": F.col("click") * 50, "holiday": F.when(F.col("signup") > 150, 1).otherwise(0)})
    return serving.brief_table(w, "purchase", "view", "wind", ["error", "signup"], "holiday")


@query(
    "a9_predicted_vs_actual",
    with_sql(
        """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, ROUND(avg(view), 1) AS view_mean, ROUND(min(view), 1) AS view_min, ROUND(max(view), 1) AS view_max,
             ROUND(avg(purchase), 1) AS purchase_mean, ROUND(min(purchase), 1) AS purchase_min, ROUND(max(purchase), 1) AS purchase_max,
             ROUND(avg(view) - avg(purchase), 1) AS error FROM wide WHERE ts >= (SELECT max(ts) - INTERVAL 15 DAY FROM wide) GROUP BY 1""",
        WIDE,
    ),
)
def a9(t):
    return rollup.predicted_vs_actual_daily(wide(t), "purchase", "view")


@query(
    "a10_row_mean_variance",
    with_sql(
        """SELECT ts, round((SELECT avg(x) FROM (SELECT unnest([click, error, view]) AS x)), 6) AS mean,
                  round((SELECT var_samp(x) FROM (SELECT unnest([click, error, view]) AS x)), 6) AS variance FROM wide""",
        WIDE,
    ),
)
def a10(t):
    cols = ["click", "error", "view"]
    return wide(t).select("ts", row_mean(cols).alias("mean"), row_variance(cols).alias("variance"))


@query(
    "a10_row_statistics_long",
    with_sql("SELECT ts, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance FROM hourly GROUP BY 1", HOURLY),
)
def a10_long(t):
    return rollup.row_statistics(hourly(t))


PLACES = """places AS (
    SELECT c_nationkey AS place, o_orderdate AS ts, round(avg(o_totalprice), 4) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  pgrid AS (SELECT place, unnest(generate_series(min(ts), (SELECT max(ts) FROM places), INTERVAL 1 DAY)) AS ts FROM places GROUP BY 1),
  filled AS (SELECT g.place, g.ts, p.value IS NOT NULL AS raw,
                    last_value(p.value IGNORE NULLS) OVER (PARTITION BY g.place ORDER BY g.ts) AS value
             FROM pgrid g LEFT JOIN places p USING (place, ts))"""


def places(t):
    """The 25 nations as gauges: mean price of their customers' orders per day."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("place"), F.col("o_orderdate").alias("ts")).agg(
        rnd(F.avg("o_totalprice"), 4).alias("value")
    )


A11 = """SELECT ts, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.1), 4) AS p10,
                  count(*) FILTER (WHERE raw) AS coverage FROM filled GROUP BY 1"""


@query("a11_daily_place_quantiles", with_sql(A11, PLACES), digits=4)
def a11(t):
    """Every nation carried forward to the last day of the table."""
    p = places(t)
    return rollup.daily_place_quantiles(p, "place", end=p.agg(F.max("ts")).scalar())


@query("a11_place_quantiles_many_places", with_sql(A11, PLACES), digits=4)
def a11_many(t):
    """The same over two groups of places at once: each alone, then the one that is asked for."""
    p = places(t).withColumn("half", F.explode(F.array(F.lit("all"), F.when(F.col("place") % 2 == 0, "even").otherwise("odd"))))
    out = rollup.daily_place_quantiles(p, "place", end=places(t).agg(F.max("ts")).scalar(), groups="half")
    return out.where("half = 'all'").drop("half")


@query(
    "a11_place_quantiles_with_guard",
    with_sql(
        """, d AS (SELECT ts, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.1) AS q, count(*) FILTER (WHERE raw) AS coverage FROM filled GROUP BY 1)
           SELECT ts, round(last_value(CASE WHEN coverage >= 4 THEN m END IGNORE NULLS) OVER (ORDER BY ts), 4) AS median,
                  round(last_value(CASE WHEN coverage >= 4 THEN q END IGNORE NULLS) OVER (ORDER BY ts), 4) AS p10, coverage FROM d""",
        PLACES,
    ),
    digits=4,
)
def a11_guard(t):
    """Days with fewer than four raw readings repeat the last accepted day."""
    p = places(t)
    return rollup.daily_place_quantiles(p, "place", end=p.agg(F.max("ts")).scalar(), min_coverage=4)


@query("d1_required_columns", with_sql("SELECT count(*) AS rows, count(purchase) AS purchase FROM wide", WIDE))
def d1(t):
    """Rows of a table that has the columns asked for; a table that lacks one is refused."""
    w = quality.require_columns(wide(t), ["ts", "purchase", "view"])
    return w.agg(F.count(F.lit(1)).alias("rows"), F.count("purchase").alias("purchase"))


@query(
    "f36_plain_identifiers",
    "SELECT props AS name, count(*) AS n, regexp_matches(props, '^[A-Za-z_][A-Za-z0-9_]*$') AS plain FROM events GROUP BY 1 UNION ALL "
    "SELECT event_type, count(*), regexp_matches(event_type, '^[A-Za-z_][A-Za-z0-9_]*$') FROM events GROUP BY 1",
)
def f36(t):
    """Which values could name a column."""
    from ..functions.scalar import plain_identifier

    names = t.events.select(F.explode(F.array("props", "event_type")).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("plain", plain_identifier("name"))


@query(
    "a12_coverage",
    with_sql(
        """SELECT series_id, 'value' AS column_name, count(*) AS expected, count(value) AS filled, count(*) - count(value) AS missing,
                  round(count(value) / count(*), 6) AS coverage FROM gapped GROUP BY 1""",
        HOURLY, GRID,
    ),
)
def a12(t):
    return quality.coverage(complete_grid(hourly(t), "series_id"), ["value"], "series_id")


@query(
    "a13_forecast_evaluation",
    with_sql(
        """, e AS (SELECT *, purchase AS a, view AS p FROM wide WHERE purchase IS NOT NULL AND view IS NOT NULL)
           SELECT count(*) AS n, round(avg(abs(a - p)), 6) AS mae, round(avg((a - p) * (a - p)), 6) AS mse,
             round(2 * avg(abs(a - p) / nullif(abs(a) + abs(p), 0)) * 100, 6) AS smape, round(corr(a, p), 6) AS pearson,
             min(ts) AS first_ts, max(ts) AS last_ts, round(sqrt(avg((a - p) * (a - p))), 6) AS rmse,
             round(1 - avg((a - p) * (a - p)) / var_pop(a), 6) AS r2 FROM e""",
        WIDE,
    ),
)
def a13(t):
    return metrics.forecast_evaluation(wide(t), "purchase", "view")


SPEARMAN = """, e AS ({rows}),
             r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
                          rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM e)
           SELECT round(corr(ra, rp), 6) AS spearman FROM r"""


@query(
    "a13_spearman",
    with_sql(SPEARMAN.format(rows="SELECT purchase AS a, view AS p FROM wide WHERE purchase IS NOT NULL AND view IS NOT NULL"), WIDE),
)
def a13_spearman(t):
    return metrics.spearman(wide(t), "purchase", "view")


@query("a13_spearman_with_ties", "WITH " + SPEARMAN.format(rows="SELECT l_quantity AS a, l_extendedprice AS p FROM lineitem")[2:])
def a13_spearman_ties(t):
    """Fifty distinct quantities over all lineitems: nearly every rank is shared."""
    return metrics.spearman(t.lineitem, "l_quantity", "l_extendedprice")


@query(
    "a15_run_info",
    """SELECT o_orderkey AS run_id, o_orderdate + to_hours(8 + 3 * CAST(substr(o_orderpriority, 1, 1) AS BIGINT)) AS run_datetime,
              coalesce(n, 0) AS prediction_count
       FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_shipdate) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def a15(t):
    from ..operators.archive import run_info
    from .inputs import runs

    return run_info(runs(t), predictions(t))


@query(
    "a16_summaries",
    with_sql(
        "SELECT series_id, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM hourly GROUP BY 1",
        HOURLY,
    ),
)
def a16(t):
    return rollup.summaries(hourly(t), "value", "series_id")


@query(
    "a17_feature_profile",
    with_sql(
        """, e AS (SELECT *, 1.0 AS fixed FROM wide WHERE coalesce(click + error + signup + view + purchase, NULL) IS NOT NULL)
           SELECT (SELECT count(*) FROM e) AS rows, feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
                  round(coalesce(corr(v, purchase), 0), 6) AS correlation, arg_max(v, ts) AS latest,
                  CASE feature WHEN 't_click' THEN 'temperature' WHEN 'ws_error' THEN 'wind_speed' WHEN 'HydroSignup' THEN 'hydrology' ELSE 'calendar' END AS feature_group
           FROM (SELECT ts, purchase, 't_click' AS feature, click AS v FROM e UNION ALL SELECT ts, purchase, 'ws_error', error FROM e
                 UNION ALL SELECT ts, purchase, 'HydroSignup', signup FROM e UNION ALL SELECT ts, purchase, 'view', view FROM e) GROUP BY feature""",
        WIDE,
    ),
)
def a17(t):
    """The constant feature must drop out."""
    w = wide(t).withColumnsRenamed({"click": "t_click", "error": "ws_error", "signup": "HydroSignup"}).withColumn("fixed", F.lit(1.0))
    return serving.feature_profile(w, ["t_click", "ws_error", "HydroSignup", "view", "fixed"], "purchase")


# Weather codes cycle over the stations' readings; the list repeats so that ties occur.
SYMBOLS = "[1, 2, 3, 21, 31, 41, 61, 91, 7, 2]"
SYMBOL_ROWS = f"""symbol_rows AS (
    SELECT event_type AS station, ts, {SYMBOLS}[1 + CAST(floor(value) AS BIGINT) % 10] AS symbol FROM hourly_ts)"""
SYMBOL_INPUT = "hourly_ts AS (SELECT event_type, ts, value FROM events)"
CONDITION_SQL = """CASE WHEN symbol = 1 THEN 'clear-day' WHEN symbol = 2 THEN 'partly-cloudy-day' WHEN symbol IN (3, 91, 92) THEN 'overcast-day'
    WHEN symbol IN (21, 22, 23, 31, 32, 33) THEN 'rain' WHEN symbol IN (41, 42, 43, 51, 52, 53, 71, 72, 73, 81, 82, 83) THEN 'snow'
    WHEN symbol IN (61, 62, 63, 64) THEN 'thunderstorms-day' END"""
CONDITION_DAYS = f"""cond AS (
    SELECT local_date, condition FROM (
      SELECT local_date, condition, row_number() OVER (PARTITION BY local_date ORDER BY count(*) DESC,
             list_position(['clear-day', 'partly-cloudy-day', 'overcast-day', 'rain', 'snow', 'thunderstorms-day'], condition) DESC) AS k
      FROM (SELECT *, min(off) OVER (PARTITION BY local_date) AS nearest FROM (
              SELECT CAST({local_sql('ts')} AS DATE) AS local_date, abs(hour({local_sql('ts')}) - 12) AS off, {CONDITION_SQL} AS condition FROM symbol_rows))
      WHERE off = nearest AND condition IS NOT NULL GROUP BY local_date, condition) WHERE k = 1)"""


def symbols(t):
    codes = F.array(*[F.lit(c) for c in (1, 2, 3, 21, 31, 41, 61, 91, 7, 2)])
    at = (1 + F.floor("value") % 10).cast("int")
    return t.events.select(F.col("event_type").alias("station"), "ts", F.element_at(codes, at).alias("symbol"))


@query(
    "a18_representative_condition",
    with_sql("SELECT CAST(local_date AS VARCHAR) AS local_date, condition FROM cond", SYMBOL_INPUT, SYMBOL_ROWS, CONDITION_DAYS),
)
def a18(t):
    return weather.representative_condition(symbols(t))


LEVEL_SQL = "CASE WHEN m < 1000 THEN 'calm' WHEN m < 2500 THEN 'weak' WHEN m <= 3000 THEN 'normal' WHEN m IS NOT NULL THEN 'strong' END"
WIND_DAYS = f"""levels AS (
    SELECT series_id, local_date, CASE WHEN q < 1000 THEN 'calm' ELSE {LEVEL_SQL} END AS wind_level FROM (
      SELECT series_id, CAST({local_sql('ts')} AS DATE) AS local_date, quantile_cont(value * 50, 0.25) AS q, avg(value * 50) AS m FROM hourly GROUP BY 1, 2))"""


@query("a19_daily_wind_level", with_sql("SELECT series_id, CAST(local_date AS VARCHAR) AS local_date, wind_level FROM levels", HOURLY, WIND_DAYS))
def a19(t):
    return weather.daily_wind_level(hourly(t).withColumn("wind", F.col("value") * 50), "series_id")


@query(
    "a20_daily_weather",
    with_sql(
        f"""SELECT CAST(local_date AS VARCHAR) AS local_date, {ms_sql(utc_sql('CAST(local_date AS TIMESTAMP)') + ' + INTERVAL 12 HOUR')} AS noon_ms, condition, wind_level
            FROM cond JOIN levels USING (local_date), now_
            WHERE series_id = 'click' AND local_date BETWEEN CAST({local_sql('now')} AS DATE) AND CAST({local_sql('now')} AS DATE) + 7""",
        HOURLY, SYMBOL_INPUT, SYMBOL_ROWS, CONDITION_DAYS, WIND_DAYS, NOW,
    ),
)
def a20(t):
    winds = hourly(t).where("series_id = 'click'").select("ts", (F.col("value") * 50).alias("wind"))
    return weather.daily_weather(symbols(t), winds, now(t))


@query(
    "a21_electricity_day_summary",
    with_sql(
        f"""SELECT series_id, CAST(day AS VARCHAR) AS day, round(avg(value), 6) AS price_avg, round(min(value), 6) AS price_min, round(max(value), 6) AS price_max,
                   {utc_sql('CAST(day AS TIMESTAMP)')} + INTERVAL 1 HOUR AS day_start, {utc_sql('CAST(day AS TIMESTAMP) + INTERVAL 1 DAY')} + INTERVAL 1 HOUR AS day_end
            FROM (SELECT *, CAST({local_sql('ts - INTERVAL 1 HOUR')} AS DATE) AS day FROM ship) GROUP BY series_id, day""",
        SHIP,
    ),
)
def a21(t):
    return rollup.electricity_day_summary(ship(t), {"price": F.col("value")}, "series_id")


@query(
    "a21_electricity_day_metrics",
    with_sql(
        f"""SELECT CAST(day AS VARCHAR) AS day, {', '.join(f'round({f}({c}), 6) AS {n}_{f}' for n, c in (('price', 'coalesce(purchase, view)'), ('wind', 'click'), ('temperature', 'temp')) for f in ('avg', 'min', 'max'))},
                   {utc_sql('CAST(day AS TIMESTAMP)')} + INTERVAL 1 HOUR AS day_start, {utc_sql('CAST(day AS TIMESTAMP) + INTERVAL 1 DAY')} + INTERVAL 1 HOUR AS day_end
            FROM (SELECT *, (SELECT avg(x) FROM (SELECT unnest([error, signup]) AS x)) AS temp, CAST({local_sql('ts - INTERVAL 1 HOUR')} AS DATE) AS day FROM wide) GROUP BY day""",
        WIDE,
    ),
)
def a21_wide(t):
    m = {"price": F.coalesce("purchase", "view"), "wind": F.col("click"), "temperature": row_mean(["error", "signup"])}
    return rollup.electricity_day_summary(wide(t), m)


@query(
    "a22_time_bins",
    with_sql(
        f"""SELECT series_id, {utc_sql("CAST(d AS TIMESTAMP) + to_hours(h)")} AS ts, round(avg(value), 6) AS value FROM (
              SELECT series_id, value, CAST({local_sql('ts')} AS DATE) AS d, CAST(floor(hour({local_sql('ts')}) / 6) * 6 AS BIGINT) AS h FROM ship) GROUP BY series_id, d, h""",
        SHIP,
    ),
)
def a22(t):
    return rollup.time_bins(ship(t), 6, "series_id")


RESIDUALS = """resid AS (SELECT series_id, ts, value - avg(value) OVER (PARTITION BY series_id) + 1 AS e,
    row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM ship)"""


@query(
    "a23_durbin_watson_acf",
    with_sql(
        """, c AS (SELECT *, avg(e) OVER (PARTITION BY series_id) AS m, lag(e, 1) OVER w AS e1, """
        + ", ".join(f"lag(e, {k}) OVER w AS l{k}" for k in range(1, 7))
        + """ FROM resid WINDOW w AS (PARTITION BY series_id ORDER BY ts))
           SELECT series_id, count(*) AS n, round(sum((e - e1) * (e - e1)) / sum(e * e), 6) AS durbin_watson, """
        + ", ".join(f"round(sum((e - m) * (l{k} - m)) / sum((e - m) * (e - m)), 6) AS acf_{k}" for k in range(1, 7))
        + " FROM c GROUP BY 1",
        SHIP, RESIDUALS,
    ),
)
def a23(t):
    from ..operators.buckets import salted_join

    s = ship(t)
    mean = s.groupBy("series_id").agg(F.avg("value").alias("_m"))
    resid = salted_join(s, mean, "series_id").select("series_id", "ts", (F.col("value") - F.col("_m") + 1).alias("e"))
    return windows.autocorrelation(resid, "e", "series_id")


@query("a24_time_bounds", with_sql("SELECT min(ts) AS earliest, least(max(ts), (SELECT now FROM now_)) AS latest FROM hourly", HOURLY, NOW))
def a24(t):
    return rollup.time_bounds(hourly(t), now(t))


AUDIT_WINDOWS = [("1996-03-28 05:00:00", "1996-04-03 05:00:00"), ("1998-10-22 00:00:00", "1998-10-28 00:00:00"), ("1998-10-25 00:00:00", "1998-10-31 00:00:00")]


@query(
    "a25_station_audit",
    with_sql(
        """, w(a, b) AS (VALUES """
        + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in AUDIT_WINDOWS)
        + """), hours AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM w),
             held AS (SELECT series_id, count(value) AS value, count(CASE WHEN value > 20 THEN 1 END) AS wind FROM hours JOIN ship USING (ts) GROUP BY 1),
             long AS (SELECT s.series_id, c AS column_name, (SELECT count(*) FROM hours) AS expected, coalesce(CASE c WHEN 'value' THEN value ELSE wind END, 0) AS present
                      FROM (SELECT DISTINCT series_id FROM ship) s CROSS JOIN (VALUES ('value'), ('wind')) v(c) LEFT JOIN held USING (series_id))
           SELECT series_id, column_name, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(present) AS BIGINT) AS present,
                  CAST(sum(expected) - sum(present) AS BIGINT) AS missing, round(sum(present) / sum(expected), 6) AS coverage
           FROM long GROUP BY ROLLUP (series_id, column_name)""",
        SHIP,
    ),
)
def a25(t):
    frame = ship(t).withColumn("wind", F.when(F.col("value") > 20, F.col("value")))
    w = t.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(AUDIT_WINDOWS)], "window_id int, a string, b string")
    w = w.select("window_id", F.col("a").cast("timestamp").alias("start"), F.col("b").cast("timestamp").alias("end"))
    return quality.window_audit(frame, w, "series_id", ["value", "wind"])


@query(
    "a26_distribution_summary",
    """SELECT l_returnflag AS series_id, count(*) AS n, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10,
              round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, max(l_extendedprice) AS max
       FROM lineitem GROUP BY 1""",
)
def a26(t):
    """Exact quantiles of groups that hold a third of all rows each."""
    return quantile.summary_quantiles(t.lineitem.withColumnRenamed("l_returnflag", "series_id"), "l_extendedprice", "series_id")


@query(
    "a27_classifier_metrics",
    """WITH s AS (SELECT l_returnflag = 'R' AS y, l_quantity / 50 AS s FROM lineitem),
            c AS (SELECT count(*) FILTER (WHERE y AND s >= 0.5) AS tp, count(*) FILTER (WHERE NOT y AND s >= 0.5) AS fp,
                         count(*) FILTER (WHERE y AND s < 0.5) AS fn, count(*) FILTER (WHERE NOT y AND s < 0.5) AS tn FROM s),
            r AS (SELECT sum(k) AS rs FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM s) WHERE y)
       SELECT tp, fp, fn, tn, round((rs - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)), 6) AS auc,
              round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision_1, round(tp / (tp + fn), 6) AS recall_1,
              round(tn / (tn + fn), 6) AS precision_0, round(tn / (tn + fp), 6) AS recall_0,
              round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1_1, round(2.0 * tn / (2 * tn + fp + fn), 6) AS f1_0 FROM c, r""",
)
def a27(t):
    rows = t.lineitem.select((F.col("l_returnflag") == "R").alias("y"), (F.col("l_quantity") / 50).alias("s"))
    return metrics.classifier_metrics(rows, "y", "s")


@query(
    "a29_class_weight",
    with_sql(
        """, d AS (SELECT CAST(ts AS DATE) AS date, var_samp(purchase) AS v FROM wide GROUP BY 1),
             l AS (SELECT date, coalesce(v >= (SELECT quantile_cont(v, 0.8) FROM d), false) AS volatile FROM d)
           SELECT CAST(date AS VARCHAR) AS date, volatile, round(CASE WHEN volatile THEN (SELECT count(*) FILTER (WHERE NOT volatile) / count(*) FILTER (WHERE volatile) FROM l) ELSE 1.0 END, 6) AS weight FROM l""",
        WIDE,
    ),
)
def a29(t):
    label = rollup.volatility_label(wide(t), "purchase").select("date", "volatile")
    return metrics.class_weight(label, "volatile")


@query(
    "a31_delivered_day_mean",
    with_sql(
        f"""SELECT series_id, round(avg(value), 6) AS day_mean, count(*) AS hours FROM hourly
            WHERE ts >= {utc_sql("TIMESTAMP '2024-01-16'")} AND ts < {utc_sql("TIMESTAMP '2024-01-17'")} GROUP BY 1""",
        HOURLY_RAW,
    ),
)
def a31(t):
    rows = t.events.select(F.col("event_type").alias("series_id"), "ts", "value")
    return rollup.delivered_day_mean(rows, "2024-01-16", "series_id")


@query("a32_value_distribution", "SELECT CASE WHEN l_discount > 0 THEN l_discount END AS discount, count(*) AS n FROM lineitem GROUP BY 1")
def a32(t):
    return rollup.value_distribution(t.lineitem.select(F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount")), "discount")


@query("w18_latest_value", "SELECT event_type AS series_id, arg_max(value, ts) FILTER (WHERE value < 50) AS value, max(ts) FILTER (WHERE value < 50) AS ts FROM events GROUP BY 1")
def w18(t):
    rows = t.events.select(F.col("event_type").alias("series_id"), "ts", F.when(F.col("value") < 50, F.col("value")).alias("value"))
    return rollup.latest_value(rows, "series_id")


# Checks


@query("d3_nulls_after_join", with_sql(" UNION ALL ".join(f"SELECT (SELECT count(*) FROM wide) AS rows, '{c}' AS column_name, count(*) AS nulls FROM wide WHERE {c} IS NULL HAVING count(*) > 0" for c in TYPES), WIDE))
def d3(t):
    return quality.nulls_after_join(wide(t), TYPES)


@query("d4_negative_readings", "SELECT event_id, round(value - 20, 6) AS value FROM events WHERE value - 20 < 0")
def d4(t):
    return quality.negatives(t.events.select("event_id", (F.col("value") - 20).alias("value")), "value")


@query("d4_clipped_readings", "SELECT event_id, round(greatest(value - 20, 0), 6) AS value FROM events")
def d4_clip(t):
    return quality.clip_negatives(t.events.select("event_id", (F.col("value") - 20).alias("value")), "value")


@query(
    "d5_snapshot_violations",
    """SELECT * FROM (SELECT 'null_value' AS violation, count(*) AS rows FROM events WHERE value < 1
         UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT 1 FROM events GROUP BY event_type, date_trunc('hour', ts) HAVING count(*) > 1)) WHERE rows > 0""",
)
def d5(t):
    """Raw events keyed by hour repeat their keys, and small values are sent as missing."""
    rows = t.events.select("event_type", F.date_trunc("hour", "ts").alias("ts"), F.when(F.col("value") >= 1, F.col("value")).alias("value"))
    return quality.snapshot_violations(rows, ["event_type", "ts"], ["value"])


@query(
    "d6_long_outages",
    """SELECT o_orderkey, CAST(4000 + (o_orderkey % 500) AS DOUBLE) AS outage_hours FROM orders
       WHERE 4000 + (o_orderkey % 500) > 4320 AND o_orderstatus = 'F'""",
)
def d6(t):
    """Every order is an outage of 4000 to 4499 hours; finished ones are at zero power."""
    rows = t.orders.select(
        "o_orderkey",
        F.col("o_orderdate").alias("start"),
        F.timestamp_seconds(F.unix_seconds("o_orderdate") + (4000 + F.col("o_orderkey") % 500) * 3600).alias("end"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice")).alias("avail_qty"),
    )
    return quality.anomalous_outages(rows).select("o_orderkey", "outage_hours")


@query("d7_null_report", with_sql(" UNION ALL ".join(f"SELECT count(*) AS rows, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM wide" for c in TYPES), WIDE))
def d7(t):
    return quality.null_report(wide(t), TYPES)


@query(
    "f24_quantile_clip",
    """SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 4) AS price FROM lineitem,
         (SELECT quantile_cont(l_extendedprice, 0.0008) AS lo, quantile_cont(l_extendedprice, 0.9995) AS hi FROM lineitem)""",
    digits=4,
)
def f24(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return quantile.quantile_clip(rows, "price", 0.0008, 0.9995)


@query(
    "f21_outage_length_availability",
    with_sql(
        """SELECT event_id, round(epoch("end") / 3600 - epoch(start) / 3600, 3) AS hours, round(avail_qty / nominal_power, 6) AS availability
           FROM outages, now_ WHERE "end" > now""",
        OUTAGES, NOW,
    ),
)
def f21(t):
    from ..sinks.publish import outage_records

    return outage_records(outages(t), now(t)).select("event_id", F.col("hours"), "availability")


