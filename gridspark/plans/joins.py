"""Joins, patches, set operations, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import number
from ..functions.time import MARKET_TZ, floor_hour
from ..operators import asof, interval, patch, quantile, rollup, serving, spine, windows
from ..operators.fill import forward_fill
from ..sinks import publish
from ..sinks.store import update_existing, upsert_frame
from .inputs import (
    ACTUALS,
    DAILY,
    GRID,
    HOURLY,
    NOW,
    PREDICTIONS,
    SHIP,
    TYPES,
    WIDE,
    actuals,
    hourly,
    local_sql,
    now,
    predictions,
    ship,
    source,
    utc_sql,
    wide,
    with_sql,
)
from .registry import query, rnd
from .sources import HOLIDAYS, OUTAGES, holiday_days, outages

LOCAL_TODAY = utc_sql(f"date_trunc('day', {local_sql('now')})")
STORE = "store AS (SELECT series_id, ts, value FROM daily WHERE source = 'F')"
FRESH = "fresh AS (SELECT series_id, ts, value FROM daily WHERE source = 'O')"
BACKUP = "backup AS (SELECT series_id, ts, value FROM daily WHERE source = 'P')"


@query(
    "j1_feed_left_join",
    with_sql(
        "SELECT s.series_id, s.ts, s.value, f.value AS feed FROM store s LEFT JOIN fresh f USING (series_id, ts)",
        DAILY, STORE, FRESH,
    ),
)
def j1(t):
    feed = source(t, "O").withColumnRenamed("value", "feed")
    return patch.replace_feed(source(t, "F"), feed, ["series_id", "ts"], ["feed"])


@query(
    "j2_patch_new_wins",
    with_sql(
        "SELECT s.series_id, s.ts, coalesce(f.value, s.value) AS value FROM store s LEFT JOIN fresh f USING (series_id, ts)",
        DAILY, STORE, FRESH,
    ),
)
def j2(t):
    return patch.patch(source(t, "F"), source(t, "O"), ["series_id", "ts"], ["value"], prefer="new")


@query(
    "j2_patch_repeated_keys",
    with_sql(
        """, feed AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_max_null(value, event_id) AS value
                      FROM (SELECT * REPLACE (CASE WHEN value > 20 THEN value END AS value) FROM events) GROUP BY 1, 2)
           SELECT h.series_id, h.ts, round(coalesce(f.value, h.value), 6) AS value FROM hourly h LEFT JOIN feed f USING (series_id, ts)""",
        HOURLY,
    ),
)
def j2_repeated(t):
    """Every event is an update of its hour: the last one decides, and no hour multiplies."""
    feed = t.events.select(
        F.col("event_type").alias("series_id"), floor_hour("ts").alias("ts"), "event_id", F.when(F.col("value") > 20, F.col("value")).alias("value")
    )
    return patch.patch(hourly(t), feed, ["series_id", "ts"], ["value"], prefer="new", order="event_id")


GRID_DAILY = """dgrid AS (
    SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM store GROUP BY 1),
  dgapped AS (SELECT g.series_id, g.ts, s.value FROM dgrid g LEFT JOIN store s USING (series_id, ts))"""


@query(
    "j3_patch_old_wins",
    with_sql(
        "SELECT g.series_id, g.ts, coalesce(g.value, f.value) AS value FROM dgapped g LEFT JOIN fresh f USING (series_id, ts)",
        DAILY, STORE, FRESH, GRID_DAILY,
    ),
)
def j3(t):
    grid = spine.complete_grid(source(t, "F"), "series_id", step="1 day", bucket="365 days")
    return patch.patch(grid, source(t, "O"), ["series_id", "ts"], ["value"], prefer="old")


@query(
    "j4_frame_update",
    with_sql(
        """SELECT w.ts, round(coalesce(r.click, w.click), 6) AS click, w.error, coalesce(r.view, w.view) AS view
           FROM wide w LEFT JOIN (SELECT ts, click + 1 AS click, CASE WHEN view > 50 THEN view END AS view, 1 AS other FROM wide, now_
                WHERE ts BETWEEN now - INTERVAL 7 DAY AND now + INTERVAL 7 DAY) r USING (ts)""",
        WIDE, NOW,
    ),
)
def j4(t):
    base = wide(t).select("ts", "click", "error", "view")
    recent = spine.recent_window(wide(t), now(t)).select(
        "ts", (F.col("click") + 1).alias("click"), F.when(F.col("view") > 50, F.col("view")).alias("view"), F.lit(1).alias("other")
    )
    return patch.update_frame(base, recent, "ts")


@query("j5_outer_merge_wide", with_sql("SELECT * FROM wide", WIDE))
def j5(t):
    return patch.wide_by_location(hourly(t), "series_id", TYPES)


@query(
    "j6_primary_or_backup",
    with_sql(
        """, b AS (SELECT coalesce(s.series_id, p.series_id) AS series_id, coalesce(s.ts, p.ts) AS ts, coalesce(s.value, p.value) AS v
             FROM store s FULL JOIN backup p ON s.series_id = p.series_id AND s.ts = p.ts)
           SELECT series_id, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts) AS value FROM b""",
        DAILY, STORE, BACKUP,
    ),
)
def j6(t):
    both = patch.primary_or_backup(source(t, "F"), source(t, "P"), ["series_id", "ts"])
    return forward_fill(both, "value", "series_id", bucket="365 days")


@query(
    "j7_label_features_join",
    with_sql(
        """, f AS (SELECT CAST(ts AS DATE) AS date, round(avg(click), 6) AS click_mean FROM wide GROUP BY 1),
             l AS (SELECT CAST(ts AS DATE) AS date, round(var_samp(purchase), 6) AS price_variance FROM wide GROUP BY 1)
           SELECT CAST(date AS VARCHAR) AS date, click_mean, price_variance FROM f JOIN l USING (date)""",
        WIDE,
    ),
)
def j7(t):
    features = rollup.daily_features(wide(t), ["click"]).select("date", "click_mean")
    label = rollup.volatility_label(wide(t), "purchase").select("date", "price_variance")
    return features.join(label, "date")


@query(
    "j8_interval_sum",
    with_sql(
        """SELECT g.ts, round(4372 - coalesce(sum(o.nominal_power - o.avail_qty), 0), 6) AS capacity
           FROM (SELECT DISTINCT ts FROM hourly) g LEFT JOIN outages o ON o.start <= g.ts AND g.ts < o."end" GROUP BY 1""",
        HOURLY, OUTAGES,
    ),
)
def j8(t):
    return interval.available_capacity(hourly(t).select("ts").distinct(), outages(t))


@query(
    "j9_daily_to_hourly",
    with_sql(
        """SELECT h.series_id, h.ts, d.daily FROM hourly h
           LEFT JOIN (SELECT series_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS daily FROM hourly GROUP BY 1, 2) d
           ON d.series_id = h.series_id AND d.date = CAST(h.ts AS DATE)""",
        HOURLY,
    ),
)
def j9(t):
    h = hourly(t)
    per_day = h.groupBy("series_id", F.to_date("ts").alias("date")).agg(F.avg("value").alias("daily"))
    return asof.daily_to_hourly(h.select("series_id", "ts"), per_day, "series_id", value="daily")


@query(
    "j10_asof_backward",
    with_sql(
        """, f AS (SELECT event_type AS series_id, ts AS at, value FROM events)
           SELECT h.series_id, h.ts, f.value, f.at AS matched_ts FROM hourly h
           ASOF LEFT JOIN f ON h.series_id = f.series_id AND h.ts >= f.at""",
        HOURLY,
    ),
)
def j10(t):
    """The last event at or before each hour."""
    feed = t.events.select(F.col("event_type").alias("series_id"), "ts", "value")
    return asof.asof_backward(hourly(t).select("series_id", "ts"), feed, "series_id")


@query(
    "j10_asof_repeated_keys",
    with_sql(
        """, f AS (SELECT event_type AS series_id, ts AS at, value FROM events)
           SELECT e.event_id, f.value, f.at AS matched_ts FROM events e
           ASOF LEFT JOIN f ON e.event_type = f.series_id AND date_trunc('hour', e.ts) >= f.at""".replace(", f AS", "WITH f AS", 1),
    ),
)
def j10_repeated(t):
    """Every event with the last event before its hour began."""
    feed = t.events.select(F.col("event_type").alias("series_id"), "ts", "value")
    left = t.events.select("event_id", F.col("event_type").alias("series_id"), floor_hour("ts").alias("ts"))
    return asof.asof_backward(left, feed, "series_id", unique_left=False).select("event_id", "value", "matched_ts")


@query(
    "j10_asof_daily_on_hours",
    with_sql(
        """, f AS (SELECT o_orderdate AS at, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1)
           SELECT s.series_id, s.ts, f.value FROM ship s ASOF LEFT JOIN f ON s.ts >= f.at""",
        SHIP,
    ),
)
def j10_daily(t):
    """Daily values expanded over seven years of hours."""
    d = t.orders.groupBy(F.col("o_orderdate").alias("ts")).agg(rnd(F.avg("o_totalprice")).alias("value"))
    left = ship(t).select("series_id", "ts")
    # Each series gets its own copy of the daily values; series are a few, days are bounded.
    right = d.withColumn("series_id", F.explode(F.array(*[F.lit(c) for c in ("A", "N", "R")])))
    return asof.asof_backward(left, right, "series_id").drop("matched_ts")


@query(
    "j11_semi_join",
    with_sql("SELECT series_id, ts, value FROM store s WHERE EXISTS (SELECT 1 FROM fresh f WHERE f.series_id = s.series_id AND f.ts = s.ts)", DAILY, STORE, FRESH),
)
def j11(t):
    return source(t, "F").join(source(t, "O").select("series_id", "ts"), ["series_id", "ts"], "left_semi")


@query(
    "j12_insert_update_split",
    with_sql(
        """SELECT f.series_id, f.ts, f.value, CASE WHEN s.ts IS NULL THEN 'insert' ELSE 'update' END AS kind
           FROM fresh f LEFT JOIN store s ON f.series_id = s.series_id AND f.ts = s.ts""",
        DAILY, STORE, FRESH,
    ),
)
def j12(t):
    new, old = patch.split_existing(source(t, "O"), source(t, "F"), ["series_id", "ts"])
    return new.withColumn("kind", F.lit("insert")).unionByName(old.withColumn("kind", F.lit("update")))


@query("j13_complete_grid", with_sql("SELECT series_id, ts, round(value, 6) AS value FROM ship_gapped", SHIP, """ship_grid AS (
    SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM ship GROUP BY 1),
  ship_gapped AS (SELECT g.series_id, g.ts, s.value FROM ship_grid g LEFT JOIN ship s USING (series_id, ts))"""))
def j13(t):
    """Seven years of hours per series, without generating a spine."""
    return spine.complete_grid(ship(t), "series_id")


@query(
    "j13_common_range_grid",
    with_sql(
        """SELECT s.series_id, r.ts, h.value FROM (SELECT DISTINCT series_id FROM hourly) s
           CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02 03:00:00', INTERVAL 1 HOUR)) AS ts) r
           LEFT JOIN hourly h ON h.series_id = s.series_id AND h.ts = r.ts""",
        HOURLY,
    ),
)
def j13_common(t):
    return spine.complete_grid(hourly(t), "series_id", start="2023-12-30 00:00:00", end="2024-02-02 03:00:00")


@query(
    "j13_forecast_spine",
    with_sql(
        """SELECT series_id, ts FROM hourly, now_ WHERE ts BETWEEN now - INTERVAL 7 DAY AND now + INTERVAL 7 DAY
           UNION SELECT s.series_id, unnest(generate_series(now + INTERVAL 1 HOUR, date_trunc('day', now + INTERVAL 7 DAY) + INTERVAL 23 HOUR, INTERVAL 1 HOUR))
           FROM (SELECT DISTINCT series_id FROM hourly) s, now_""",
        HOURLY, NOW,
    ),
)
def j13_forecast(t):
    return spine.forecast_spine(hourly(t), "series_id", now(t))


@query(
    "j14_correlated_update",
    with_sql(
        """SELECT p.run_id, p.ts, p.predicted, CASE WHEN a.actual IS NOT NULL AND a.actual IS DISTINCT FROM p.actual THEN a.actual ELSE p.actual END AS actual,
                  a.actual IS NOT NULL AND a.actual IS DISTINCT FROM p.actual AS changed
           FROM predictions p LEFT JOIN actuals a USING (ts)""",
        PREDICTIONS, ACTUALS,
    ),
)
def j14(t):
    from ..operators.archive import sync_actuals

    return sync_actuals(predictions(t), actuals(t))


@query(
    "j17_actual_forecast_merge",
    with_sql(
        """SELECT coalesce(a.series_id, f.series_id) AS series_id, coalesce(a.ts, f.ts) AS ts, coalesce(a.value, f.value) AS value
           FROM store a FULL JOIN fresh f ON a.series_id = f.series_id AND a.ts = f.ts""",
        DAILY, STORE, FRESH,
    ),
)
def j17(t):
    return patch.merge_actual_forecast(source(t, "F"), source(t, "O"), ["series_id", "ts"])


@query(
    "j18_three_source_priority",
    with_sql(
        """, k AS (SELECT series_id, ts FROM store UNION SELECT series_id, ts FROM fresh UNION SELECT series_id, ts FROM backup)
           SELECT k.series_id, k.ts, coalesce(s.value, f.value, b.value) AS value FROM k
           LEFT JOIN store s USING (series_id, ts) LEFT JOIN fresh f USING (series_id, ts) LEFT JOIN backup b USING (series_id, ts)""",
        DAILY, STORE, FRESH, BACKUP,
    ),
)
def j18(t):
    return serving.select_price(source(t, "F"), source(t, "O"), source(t, "P"), "series_id")


@query(
    "j19_choose_by_time",
    with_sql("SELECT ts, CASE WHEN ts <= now THEN coalesce(purchase, view) ELSE view END AS value FROM wide, now_", WIDE, NOW),
)
def j19(t):
    at = now(t)
    w = wide(t)
    chosen = F.when(F.col("ts") <= at, F.coalesce("purchase", "view")).otherwise(F.col("view"))
    return w.select("ts", chosen.alias("value"))


@query("j20_known_value_substitution", with_sql("SELECT run_id, ts, coalesce(actual, predicted) AS price FROM predictions", PREDICTIONS))
def j20(t):
    return predictions(t).select("run_id", "ts", F.coalesce("actual", "predicted").alias("price"))


@query("u1_union_sources", with_sql("SELECT series_id, ts, value, source FROM daily", DAILY))
def u1(t):
    return patch.stack_sources({s: source(t, s) for s in ("F", "O", "P")}).drop("source_rank")


@query(
    "u2_union_keep_last",
    with_sql(
        """SELECT coalesce(f.series_id, s.series_id) AS series_id, coalesce(f.ts, s.ts) AS ts, coalesce(f.value, s.value) AS value
           FROM store s FULL JOIN fresh f ON f.series_id = s.series_id AND f.ts = s.ts""",
        DAILY, STORE, FRESH,
    ),
)
def u2(t):
    return patch.union_keep_last(source(t, "F"), source(t, "O"), ["series_id", "ts"])


@query("u3_index_union", with_sql("SELECT ts FROM store UNION SELECT ts FROM fresh", DAILY, STORE, FRESH))
def u3(t):
    return source(t, "F").select("ts").union(source(t, "O").select("ts")).distinct()


@query("u4_missing_hours", with_sql("SELECT series_id, ts FROM grid EXCEPT SELECT series_id, ts FROM hourly", HOURLY, GRID))
def u4(t):
    h = hourly(t)
    bounds = h.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = spine.spine(bounds, "series_id", F.col("lo"), F.col("hi"))
    return spine.missing_steps(h, grid, ["series_id", "ts"])


@query("u5_distinct_ids", "SELECT user_id AS id FROM events UNION SELECT o_custkey FROM orders")
def u5(t):
    return t.events.select(F.col("user_id").alias("id")).union(t.orders.select("o_custkey")).distinct()


@query(
    "w9_dedup_keep_last",
    """SELECT event_type, date_trunc('hour', ts) AS hour, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value,
              max(ts) AS ts FROM events GROUP BY 1, 2""",
)
def w9(t):
    rows = t.events.select("event_type", floor_hour("ts").alias("hour"), "ts", "event_id", "value")
    return patch.dedup(rows, ["event_type", "hour"], "ts", keep="last")


@query(
    "w9_dedup_keep_first",
    """SELECT event_type, date_trunc('hour', ts) AS hour, arg_min(event_id, ts) AS event_id, arg_min(value, ts) AS value,
              min(ts) AS ts FROM events GROUP BY 1, 2""",
)
def w9_first(t):
    rows = t.events.select("event_type", floor_hour("ts").alias("hour"), "ts", "event_id", "value")
    return patch.dedup(rows, ["event_type", "hour"], "ts", keep="first")


UPSERT = """SELECT coalesce(s.series_id, f.series_id) AS series_id, coalesce(s.ts, f.ts) AS ts, {value} AS value,
           CASE WHEN s.ts IS NULL THEN 'inserted' WHEN f.ts IS NULL THEN 'kept' ELSE 'updated' END AS _change
           FROM store s FULL JOIN batch f ON f.series_id = s.series_id AND f.ts = s.ts"""
BATCH = "batch AS (SELECT series_id, ts, CASE WHEN value > 200000 THEN value END AS value FROM fresh)"


def batch_rows(t):
    """Fresh rows whose small values are missing."""
    return source(t, "O").withColumn("value", F.when(F.col("value") > 200000, F.col("value")))


@query("k1_null_skipping_upsert", with_sql(UPSERT.format(value="coalesce(f.value, s.value)"), DAILY, STORE, FRESH, BATCH))
def k1(t):
    return upsert_frame(source(t, "F"), batch_rows(t), ["series_id", "ts"])


@query(
    "k1_upsert_repeated_keys",
    """SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
              arg_max(CASE WHEN value > 20 THEN value END, event_id) AS value,
              arg_max(CASE WHEN user_id > 50 THEN user_id END, event_id) AS user_id FROM events GROUP BY 1, 2""",
)
def k1_repeated(t):
    """Events applied in order as updates of their hour; a null never erases."""
    rows = t.events.select(
        F.col("event_type").alias("series_id"),
        floor_hour("ts").alias("ts"),
        "event_id",
        F.when(F.col("value") > 20, F.col("value")).alias("value"),
        F.when(F.col("user_id") > 50, F.col("user_id")).alias("user_id"),
    )
    return patch.collapse_batch(rows, ["series_id", "ts"], "event_id")


@query(
    "k2_update_existing_rows",
    with_sql(
        "SELECT s.series_id, s.ts, CASE WHEN f.ts IS NOT NULL THEN f.value ELSE s.value END AS value FROM store s LEFT JOIN batch f ON f.series_id = s.series_id AND f.ts = s.ts",
        DAILY, STORE, FRESH, BATCH,
    ),
)
def k2(t):
    return update_existing(source(t, "F"), batch_rows(t), ["series_id", "ts"], ["value"])


@query(
    "k3_overwrite_repeated_keys",
    with_sql(
        """, feed AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_max_null(value, event_id) AS value
                      FROM (SELECT * REPLACE (CASE WHEN value > 20 THEN value END AS value) FROM events WHERE event_type IN ('click', 'view', 'error')) GROUP BY 1, 2)
           SELECT h.series_id, h.ts, round(CASE WHEN f.ts IS NULL THEN h.value ELSE f.value END, 6) AS value,
                  CASE WHEN f.ts IS NULL THEN 'kept' ELSE 'updated' END AS _change FROM hourly h LEFT JOIN feed f USING (series_id, ts)""",
        HOURLY,
    ),
)
def k3_repeated(t):
    """The events of three types overwrite their hour one after the other; a last null erases."""
    batch = t.events.where("event_type IN ('click', 'view', 'error')").select(
        F.col("event_type").alias("series_id"), floor_hour("ts").alias("ts"), "event_id", F.when(F.col("value") > 20, F.col("value")).alias("value")
    )
    batch = patch.collapse_batch(batch, ["series_id", "ts"], "event_id", "overwrite")
    return upsert_frame(hourly(t), batch, ["series_id", "ts"], null_policy="overwrite")


@query(
    "k3_upsert_overwrite",
    with_sql(UPSERT.format(value="CASE WHEN f.ts IS NOT NULL THEN f.value ELSE s.value END"), DAILY, STORE, FRESH, BATCH),
)
def k3_overwrite(t):
    return upsert_frame(source(t, "F"), batch_rows(t), ["series_id", "ts"], null_policy="overwrite")


@query(
    "k3_upsert_default",
    with_sql(UPSERT.format(value="CASE WHEN f.ts IS NOT NULL THEN coalesce(f.value, 0) ELSE s.value END"), DAILY, STORE, FRESH, BATCH),
)
def k3_default(t):
    return upsert_frame(source(t, "F"), batch_rows(t), ["series_id", "ts"], null_policy="default", default=0.0)


# Projections and filters


@query(
    "p1_recent_window",
    with_sql("SELECT series_id, ts, value FROM hourly, now_ WHERE ts BETWEEN now - INTERVAL 7 DAY AND now + INTERVAL 7 DAY", HOURLY, NOW),
)
def p1(t):
    return spine.recent_window(hourly(t), now(t))


@query("p2_allowed_columns", with_sql("SELECT ts, click AS ws_click, purchase, signup, view FROM wide", WIDE))
def p2(t):
    """Of the ws_ family only the configured column stays; others pass."""
    w = wide(t).withColumnsRenamed({"click": "ws_click", "error": "ws_error"})
    return patch.keep_prefixed(w, ["ws_", "t_"], ["ws_click"])


@query("p3_keep_original_and_required", with_sql("SELECT ts, click, view FROM wide", WIDE))
def p3(t):
    return patch.keep_original_and(wide(t), ["ts", "click"], ["view", "absent"])


@query("p4_prefix_columns", with_sql("SELECT ts, purchase, view FROM wide", WIDE))
def p4(t):
    w = wide(t)
    return w.select("ts", *patch.prefixed(w, "p", "v"))


@query("p5_drop_columns", with_sql("SELECT ts, click, error, purchase FROM wide", WIDE))
def p5(t):
    return wide(t).drop("view", "signup", "no_such_column")


@query(
    "p6_refreshed_columns",
    with_sql(
        "SELECT s.series_id, s.ts, f.value FROM store s LEFT JOIN fresh f USING (series_id, ts)", DAILY, STORE, FRESH,
    ),
)
def p6(t):
    """The feed wins completely, also where it is missing."""
    return patch.replace_feed(source(t, "F"), source(t, "O"), ["series_id", "ts"], ["value"])


@query("p7_drop_incomplete", with_sql("SELECT * FROM wide WHERE click IS NOT NULL AND purchase IS NOT NULL", WIDE))
def p7(t):
    return wide(t).dropna("any", subset=["click", "purchase"])


@query(
    "p8_coerce_and_drop",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value FROM events WHERE value >= 10",
)
def p8(t):
    """Text coerced to numbers; text that is no number drops the row."""
    text = F.when(F.col("value") >= 10, F.col("value").cast("string")).otherwise("bad")
    rows = t.events.select("event_id", number(F.get_json_object("props", "$.k")).alias("k"), number(text).alias("value"))
    return rows.dropna("any")


@query(
    "p8_drop_all_null",
    with_sql("SELECT * FROM wide WHERE coalesce(click, error, purchase, signup, view) IS NOT NULL", WIDE),
)
def p8_all(t):
    return wide(t).dropna("all", subset=TYPES)


@query("p10_open_outages", with_sql('SELECT event_id, start, "end" FROM outages, now_ WHERE "end" > now', OUTAGES, NOW))
def p10(t):
    return outages(t).where(F.col("end") > now(t)).select("event_id", "start", "end")


@query(
    "p11_from_start_of_yesterday",
    with_sql(
        f"""SELECT series_id, ts, value FROM hourly, now_
            WHERE ts >= {utc_sql(f"date_trunc('day', {local_sql('now')}) - INTERVAL 1 DAY")}""",
        HOURLY, NOW,
    ),
)
def p11(t):
    return publish.from_yesterday(hourly(t), now(t))


@query("p12_inclusive_range", with_sql("SELECT series_id, ts, round(value, 6) AS value FROM ship WHERE ts >= TIMESTAMP '1997-03-30' AND ts <= TIMESTAMP '1999-10-31 02:00:00'", SHIP))
def p12(t):
    return serving.between(ship(t), "1997-03-30 00:00:00", "1999-10-31 02:00:00")


@query(
    "p13_horizon_prune",
    with_sql(
        """SELECT run_id, ts, predicted FROM predictions p JOIN (SELECT run_id, min(ts) AS t0 FROM predictions GROUP BY 1) f USING (run_id)
           WHERE ts < t0 + INTERVAL 720 HOUR""",
        PREDICTIONS,
    ),
)
def p13(t):
    return windows.horizon_prune(predictions(t), 720).select("run_id", "ts", "predicted")


SNAPSHOTS = """snapshots AS (
    SELECT o_orderdate AS day, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS snapshot_date, l_shipdate AS ts, round(avg(l_extendedprice), 6) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""


def snapshots(t):
    """The lineitems of a day's orders are that day's forecast of the ship dates."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.to_date("o_orderdate").cast("string").alias("snapshot_date"), F.col("l_shipdate").alias("ts")).agg(
        rnd(F.avg("l_extendedprice")).alias("value")
    )


@query(
    "p14_lead_time_cut",
    with_sql("SELECT snapshot_date, ts, value FROM snapshots WHERE ts >= day + INTERVAL 2 DAY", SNAPSHOTS),
)
def p14(t):
    return windows.lead_time_cut(snapshots(t))


@query(
    "p15_forecast_after_actual",
    with_sql(
        "SELECT series_id, ts, value FROM hourly WHERE series_id <> 'purchase' AND ts >= (SELECT max(ts) + INTERVAL 1 HOUR FROM hourly, now_ WHERE series_id = 'purchase' AND ts <= now)",
        HOURLY, NOW,
    ),
)
def p15(t):
    h, at = hourly(t), now(t)
    actual = h.where((F.col("series_id") == "purchase") & (F.col("ts") <= at))
    return serving.forecast_after_actual(h.where("series_id <> 'purchase'"), actual, at)


@query(
    "p16_publication_display",
    with_sql(
        f"""SELECT series_id, ts, value FROM hourly, now_
            WHERE CAST({local_sql('ts')} AS DATE) > CAST({local_sql('now')} AS DATE) + 1
               OR (CAST({local_sql('ts')} AS DATE) = CAST({local_sql('now')} AS DATE) + 1 AND hour({local_sql('now')}) < 14)""",
        HOURLY, NOW,
    ),
)
def p16(t):
    return serving.display_filter(hourly(t), now(t))


@query(
    "p17_iqr_filter",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem,
         (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
       WHERE l_extendedprice BETWEEN q1 - 0.3 * (q3 - q1) AND q3 + 0.3 * (q3 - q1)""",
)
def p17(t):
    """A narrow width, so that both tails are really cut."""
    return quantile.iqr_filter(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 0.3)


@query("p18_finite_pairs", "SELECT event_id, ts, CASE WHEN value >= 4 THEN value END AS value FROM events WHERE value >= 4 AND event_type <> 'error'")
def p18(t):
    """Small values become null, errors NaN; neither is a pair."""
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("value") >= 4, F.col("value"))
    return serving.finite_pairs(t.events.select("event_id", "ts", v.alias("value")))


@query(
    "p19_from_local_today",
    with_sql(f"SELECT series_id, ts, value FROM hourly, now_ WHERE ts >= {LOCAL_TODAY}", HOURLY, NOW),
)
def p19(t):
    return publish.from_today(hourly(t), now(t))


@query("p20_last_days", with_sql("SELECT series_id, ts, value FROM hourly WHERE ts >= (SELECT max(ts) - INTERVAL 15 DAY FROM hourly)", HOURLY))
def p20(t):
    return rollup.last_days(hourly(t), 15)


@query(
    "p21_real_range",
    with_sql("SELECT ts, purchase IS NULL AS to_predict FROM wide WHERE ts <= (SELECT max(ts) FROM wide WHERE signup > 100)", WIDE),
)
def p21(t):
    w = wide(t)
    last_real = w.where("signup > 100").agg(F.max("ts")).scalar()
    return w.where(F.col("ts") <= last_real).select("ts", F.col("purchase").isNull().alias("to_predict"))


@query(
    "p22_daily_view_window",
    with_sql(
        f"""SELECT series_id, ts, value FROM hourly, now_
            WHERE CAST({local_sql('ts')} AS DATE) BETWEEN CAST({local_sql('now')} AS DATE) AND CAST({local_sql('now')} AS DATE) + 7""",
        HOURLY, NOW,
    ),
)
def p22(t):
    day, first = F.to_date(F.from_utc_timestamp("ts", MARKET_TZ)), F.to_date(F.from_utc_timestamp(now(t), MARKET_TZ))
    return hourly(t).where(day.between(first, F.date_add(first, 7)))


@query("p23_rename", with_sql("SELECT series_id AS station, ts AS measured_at, value AS temperature FROM hourly", HOURLY))
def p23(t):
    return hourly(t).withColumnsRenamed({"series_id": "station", "ts": "measured_at", "value": "temperature"})


@query(
    "j9_holiday_hours_on_grid",
    with_sql(
        f"""SELECT s.series_id, s.ts, coalesce(CAST(h.holiday AS BIGINT), 0) AS holiday FROM ship s LEFT JOIN (
              SELECT ts, max(kind_id) AS holiday FROM (
                SELECT kind_id, unnest(generate_series({utc_sql('CAST(date AS TIMESTAMP)')},
                  {utc_sql('CAST(date AS TIMESTAMP) + INTERVAL 1 DAY')} - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM days) GROUP BY 1) h USING (ts)""",
        SHIP, HOLIDAYS,
    ),
)
def c8_holidays(t):
    from ..operators.feeds import holidays
    from ..sources.feeds import holiday_hours

    return holidays(ship(t).select("series_id", "ts"), holiday_hours(holiday_days(t), MARKET_TZ))


@query(
    "dimension_join_region",
    """SELECT r_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    digits=2,
)
def dimension_join(t):
    """Orders are summed per customer before they meet the dimensions."""
    per = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    j = per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    j = j.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "o_orderstatus").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


