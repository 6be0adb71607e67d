"""Fills, windows, sorts and domain composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds, fill, quality, risk, rollup, serving, windows
from ..operators.cubic import cubic_interpolate
from ..operators.spine import complete_grid, densify
from ..sinks import publish
from .aggregates import PLACES, places
from .inputs import (
    ACTUALS,
    DAILY,
    GRID,
    HOURLY,
    HOURLY_RAW,
    NOW,
    SHIP,
    SHIP_GRID,
    WIDE,
    actuals,
    hourly,
    local_sql,
    ms_sql,
    now,
    ship,
    utc_sql,
    wide,
    with_sql,
)
from .joins import BACKUP, FRESH, GRID_DAILY, SNAPSHOTS, STORE, snapshots, source
from .registry import query
from .sources import INTERP, OUTAGES, outages

FWD = "last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BWD = "first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
# Ship hours with the low prices taken out, on the complete grid of a common range, so that
# nulls lead, trail and run across many buckets.
SPARSE = """sparse AS (
    SELECT s.series_id, r.ts, CASE WHEN h.value > 60 THEN h.value END AS value FROM (SELECT DISTINCT series_id FROM ship) s
    CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1994-12-20', TIMESTAMP '2001-12-01', INTERVAL 1 HOUR)) AS ts) r
    LEFT JOIN ship h ON h.series_id = s.series_id AND h.ts = r.ts)"""


def sparse(t):
    grid = complete_grid(ship(t), "series_id", start="1994-12-20 00:00:00", end="2001-12-01 00:00:00")
    return grid.withColumn("value", F.when(F.col("value") > 60, F.col("value")))


@query("w1_forward_fill", with_sql(f"SELECT series_id, ts, round({FWD}, 6) AS value FROM sparse", SHIP, SPARSE))
def w1(t):
    return fill.forward_fill(sparse(t), "value", "series_id")


@query("w2_backward_fill", with_sql(f"SELECT series_id, ts, round({BWD}, 6) AS value FROM sparse", SHIP, SPARSE))
def w2(t):
    return fill.backward_fill(sparse(t), "value", "series_id")


@query("w2_back_then_forward", with_sql(f"SELECT series_id, ts, round(coalesce({BWD}, {FWD}), 6) AS value FROM sparse", SHIP, SPARSE))
def w2_forward(t):
    return fill.back_then_forward(sparse(t), "value", "series_id")


@query("w3_fill_edges", with_sql(f"SELECT series_id, ts, round(coalesce({FWD}, {BWD}), 6) AS value FROM sparse", SHIP, SPARSE))
def w3(t):
    return fill.fill_edges(sparse(t), "value", "series_id")


@query("w4_linear_interpolation", with_sql("SELECT series_id, ts, round(value, 6) AS value FROM lerped", SHIP, SPARSE, INTERP.format(src="sparse")))
def w4(t):
    return fill.interpolate(sparse(t), "value", "series_id")


@query(
    "w4_positional_interpolation",
    with_sql(
        """, s AS (SELECT series_id, ts, CASE WHEN value > 60 THEN value END AS value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM ship),
             k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, last_value(value IGNORE NULLS) OVER p AS v0,
                          first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER n AS i1, first_value(value IGNORE NULLS) OVER n AS v1
                   FROM s WINDOW p AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                                 n AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
           SELECT series_id, ts, round(CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0
                  ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 6) AS value FROM k""",
        SHIP,
    ),
)
def w4_positional(t):
    """By row position: gaps in time do not count."""
    from ..operators.buckets import with_position

    s = ship(t).withColumn("value", F.when(F.col("value") > 60, F.col("value")))
    return fill.interpolate(with_position(s, "series_id"), "value", "series_id", at="pos").drop("pos")


@query(
    "w5_cubic_interpolation",
    with_sql(
        """SELECT series_id, ts, round(value, 6) AS known, count(value) OVER (PARTITION BY series_id ORDER BY ts) > 0
             AND count(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 0 AS inside, TRUE AS passes FROM sparse""",
        SHIP, SPARSE,
    ),
)
def w5(t):
    """Not-a-knot spline: it passes through the known prices and fills all between them.  Tests
    compare its values with a dense solve."""
    known = sparse(t).select("series_id", "ts", F.col("value").alias("known"))
    ends = known.where("known IS NOT NULL").groupBy("series_id").agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    out = cubic_interpolate(sparse(t), "value", "series_id").join(known, ["series_id", "ts"]).join(ends, "series_id", "left")
    inside = F.coalesce(F.col("ts").between(F.col("_a"), F.col("_z")), F.lit(False))
    passes = F.when(F.col("known").isNotNull(), F.col("value") == F.col("known")).otherwise(~inside | F.col("value").isNotNull())
    return out.select("series_id", "ts", "known", inside.alias("inside"), passes.alias("passes"))


@query("w6_resample_and_interpolate", with_sql("SELECT series_id, ts, round(value, 6) AS value FROM lerped", SHIP, SHIP_GRID, INTERP.format(src="ship_gapped")))
def w6(t):
    return densify(ship(t), "value", "series_id")


@query("w6_resample_and_carry", with_sql(f"SELECT series_id, ts, round({FWD}, 6) AS value FROM ship_gapped", SHIP, SHIP_GRID))
def w6_forward(t):
    return densify(ship(t), "value", "series_id", method="forward")


@query(
    "w7_zero_to_last",
    with_sql(
        """, z AS (SELECT series_id, ts, CASE WHEN value > 60 THEN value ELSE 0 END AS value FROM ship)
           SELECT series_id, ts, round(coalesce(last_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts), value), 6) AS value FROM z""",
        SHIP,
    ),
)
def w7(t):
    return fill.zero_to_last(ship(t).withColumn("value", F.when(F.col("value") > 60, F.col("value")).otherwise(0.0)), "value", "series_id")


TOP = f"""loc AS (SELECT series_id, ts, value, CAST({local_sql('ts')} AS DATE) AS d, hour({local_sql('ts')}) AS h FROM ship),
  halves AS (SELECT *, CASE WHEN h BETWEEN 6 AND 11 THEN 'm' WHEN h BETWEEN 16 AND 21 THEN 'e' END AS half FROM loc),
  quota AS (SELECT series_id, d, ceil(count(*) FILTER (WHERE h BETWEEN 6 AND 21) * 0.19) AS n,
                   count(*) FILTER (WHERE half = 'm') AS m, count(*) FILTER (WHERE half = 'e') AS e FROM halves GROUP BY 1, 2),
  takes AS (SELECT *, CASE WHEN m < ceil(n / 2) THEN m WHEN e < ceil(n / 2) THEN least(m, n - e) ELSE ceil(n / 2) END AS tm,
                   CASE WHEN m < ceil(n / 2) THEN least(e, n - m) WHEN e < ceil(n / 2) THEN e ELSE ceil(n / 2) END AS te FROM quota),
  top AS (SELECT series_id, ts, value, d, h, coalesce(CASE half WHEN 'm' THEN k <= tm WHEN 'e' THEN k <= te END, false) AS is_top_hour FROM (
            SELECT *, row_number() OVER (PARTITION BY series_id, d, half ORDER BY value DESC, ts) AS k FROM halves) JOIN takes USING (series_id, d))"""


@query(
    "w8_top_price_hours",
    with_sql("SELECT series_id, ts, CAST(d AS VARCHAR) AS local_date, h AS local_hour, is_top_hour FROM top", SHIP, TOP),
)
def w8(t):
    return risk.top_price_hours(ship(t), "value", "series_id").drop("value")


@query(
    "w10_gap_islands",
    with_sql(
        """, m AS (SELECT series_id, ts FROM ship_gapped WHERE value IS NULL),
             k AS (SELECT *, ts - to_hours(row_number() OVER (PARTITION BY series_id ORDER BY ts)) AS island FROM m)
           SELECT series_id, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS hours FROM k GROUP BY series_id, island""",
        SHIP, SHIP_GRID,
    ),
)
def w10(t):
    return windows.gap_islands(ship(t), "series_id")


@query(
    "w10_gap_islands_with_edges",
    with_sql(
        """, r AS (SELECT s.series_id, g.ts FROM (SELECT DISTINCT series_id FROM hourly) s
               CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-02', INTERVAL 1 HOUR)) AS ts) g),
             m AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM hourly h WHERE h.series_id = r.series_id AND h.ts = r.ts)),
             k AS (SELECT *, ts - to_hours(row_number() OVER (PARTITION BY series_id ORDER BY ts)) AS island FROM m)
           SELECT series_id, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS hours FROM k GROUP BY series_id, island""",
        HOURLY,
    ),
)
def w10_edges(t):
    return windows.gap_islands(hourly(t), "series_id", start="2023-12-31 00:00:00", end="2024-02-02 00:00:00")


@query(
    "w11_moving_average",
    with_sql("SELECT series_id, ts, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM ship", SHIP),
)
def w11(t):
    return windows.moving_average(ship(t), 24, "series_id")


@query(
    "w12_daily_average_on_hours",
    with_sql(f"SELECT series_id, ts, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY series_id, CAST({local_sql('ts - INTERVAL 1 HOUR')} AS DATE)), 6) AS day_average FROM ship", SHIP),
)
def w12(t):
    return rollup.local_day_average_on_rows(ship(t), "series_id")


def cheapest_sql(src: str, hours, where: str = "true", late: str = "0", prefix: str = "") -> str:
    """Windows by self-description: h rows, first to last exactly h - 1 hours apart."""
    parts = [
        f"""SELECT series_id, {h} AS hours, ts AS start, ts + INTERVAL {h} HOUR AS "end",
               avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) AS average,
               lead(ts, {h - 1}) OVER (PARTITION BY series_id ORDER BY ts) AS last_ts FROM {src}"""
        for h in hours
    ]
    return f"""{prefix} all_w AS ({' UNION ALL '.join(parts)}),
      ok AS (SELECT *, {late} AS late, round(average, 9) AS a FROM all_w, now_ WHERE last_ts = ts_plus AND {where})
      SELECT series_id, hours, start, "end", round(average, 6) AS average FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id, hours ORDER BY late, a, start) AS k FROM ok) WHERE k = 1""".replace(
        "ts_plus", "start + to_hours(hours - 1)"
    )


@query(
    "w13_cheapest_windows",
    with_sql(
        cheapest_sql("lerped", (3, 6, 12), prefix=","),
        HOURLY_RAW, GRID, INTERP.format(src="gapped"), NOW,
    ),
)
def w13(t):
    """Cheapest 3, 6 and 12 hour stretch of each series: hourly mean, complete grid,
    linear interpolation, window search."""
    rows = t.events.select(F.col("event_type").alias("series_id"), "ts", "value")
    full = densify(rollup.hourly_mean(rows, "series_id"), "value", "series_id")
    return windows.cheapest_windows(full, None, "series_id", digits=9)


@query(
    "w13_cheapest_windows_long",
    with_sql(cheapest_sql("ship_lerped", (3, 6, 12), prefix=","), SHIP, SHIP_GRID, INTERP.format(src="ship_gapped").replace("known AS", "ship_known AS").replace("lerped AS", "ship_lerped AS").replace("FROM known", "FROM ship_known"), NOW),
)
def w13_long(t):
    full = densify(ship(t), "value", "series_id")
    return windows.cheapest_windows(full, None, "series_id", digits=9)


LOOKAHEAD = f"""start >= date_trunc('hour', now) - to_hours(hours - 1)
   AND "end" <= date_trunc('hour', now) + to_hours(least(greatest(greatest(23 - hour({local_sql('now')}), 0) + 24 * 4, 1), 168))"""
NIGHT = f"(hour({local_sql('start')}) >= 22 OR hour({local_sql('start')}) <= 5)"


@query(
    "w13_cheapest_windows_from_now",
    with_sql(cheapest_sql("hourly", (3, 6, 12), LOOKAHEAD, 'CAST("end" < now AS INTEGER)', prefix=","), HOURLY, NOW),
)
def w13_now(t):
    """Gaps in the hourly series break a stretch; four days of lookahead."""
    return windows.cheapest_windows(hourly(t), now(t), "series_id", digits=9)


@query(
    "c20_cheapest_windows_user_limits",
    with_sql(cheapest_sql("hourly", (2, 3), f"{LOOKAHEAD.replace('24 * 4', '24 * 7')} AND {NIGHT}", 'CAST("end" < now AS INTEGER)', prefix=","), HOURLY, NOW),
)
def c20(t):
    """Starts between 22 and 5 o'clock local; nine days asked for, seven granted."""
    return windows.cheapest_windows(
        hourly(t), now(t), "series_id", durations=(2, 3), lookahead_days=9, start_hour=22, end_hour=5, digits=9
    )


@query(
    "w15_coverage_guard",
    with_sql(
        """, good AS (SELECT series_id, ts, n, CASE WHEN n >= 66 THEN value END AS value FROM d)
           SELECT series_id, ts, n, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts) AS value FROM good""",
        "d AS (SELECT event_type AS series_id, date_trunc('day', ts) AS ts, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)",
    ),
)
def w15(t):
    from .registry import rnd

    d = t.events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("value")
    )
    return fill.accepted_or_previous(d, "value", F.col("n") >= 66, "series_id")


@query("w16_seeded_fill", with_sql(f"SELECT * FROM (SELECT series_id, ts, round({FWD}, 6) AS value FROM sparse) WHERE ts >= TIMESTAMP '1998-01-01'", SHIP, SPARSE))
def w16(t):
    return fill.fill_seeded(sparse(t), "value", "series_id", "1998-01-01 00:00:00")


MATRIX = f"""cells AS (SELECT series_id, CAST({local_sql('ts')} AS DATE) AS d, hour({local_sql('ts')}) AS h, arg_max(value, ts) AS price, max(ts) AS "at",
      CASE WHEN count(*) > 1 THEN arg_min(value, ts) END AS earlier_price FROM ship GROUP BY 1, 2, 3),
  slots AS (SELECT series_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM cells GROUP BY 1),
  matrix AS (SELECT s.series_id, s.d, hh.h, c.price, c."at", c.earlier_price FROM slots s CROSS JOIN (SELECT unnest(range(24)) AS h) hh
             LEFT JOIN cells c ON c.series_id = s.series_id AND c.d = s.d AND c.h = hh.h)"""


@query(
    "w17_calendar_matrix",
    with_sql('SELECT series_id, CAST(d AS VARCHAR) AS local_date, h AS hour, round(price, 6) AS price, "at", round(earlier_price, 6) AS earlier_price FROM matrix', SHIP, MATRIX),
)
def w17(t):
    return windows.calendar_matrix(ship(t), "series_id")


@query(
    "w17_calendar_wide",
    with_sql(
        "SELECT series_id, CAST(d AS VARCHAR) AS local_date, "
        + ", ".join(f"round(max(price) FILTER (WHERE h = {h}), 6) AS h{h:02d}" for h in range(24))
        + " FROM matrix GROUP BY series_id, d",
        SHIP, MATRIX,
    ),
)
def w17_wide(t):
    return windows.calendar_wide(windows.calendar_matrix(ship(t), "series_id"), "series_id")


# Spike risk


RISK_START = f"""risk_ AS (SELECT {utc_sql(f"date_trunc('day', {local_sql('up')}) + CASE WHEN hour({local_sql('up')}) < 14 THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END + INTERVAL 1 HOUR")} AS future
    FROM (SELECT date_trunc('hour', now - INTERVAL 20 DAY + INTERVAL '3599.999999' SECOND) AS up FROM now_))"""
MULT = "1.0 + (1004.1304 - least(greatest(wind, 412.8883), 1004.1304)) / (1004.1304 - 412.8883) * (1.334 - 1.0)"
RISK = f"""site AS (SELECT ts, view AS value, 'site' AS series_id, click * 20 AS wind FROM wide),
  {TOP.replace('FROM ship', 'FROM site WHERE value IS NOT NULL')},
  risk AS (SELECT s.ts, s.value AS price, CAST({local_sql('s.ts')} AS DATE) AS d, hour({local_sql('s.ts')}) AS h, coalesce(top.is_top_hour, false) AS is_top_hour,
                  CASE WHEN wind IS NOT NULL THEN {MULT} END AS wind_multiplier, s.ts >= future AS is_future
           FROM site s LEFT JOIN top ON top.ts = s.ts, risk_),
  flagged AS (SELECT *, coalesce(is_future AND price IS NOT NULL AND is_top_hour AND wind_multiplier > 1, false) AS is_risk FROM risk)"""


def risk_input(t):
    return wide(t).select("ts", F.col("view").alias("price"), (F.col("click") * 20).alias("wind"))


def risk_now(t):
    return t.events.agg((F.date_trunc("hour", F.max("ts")) - F.expr("INTERVAL 27 DAYS")).alias("now")).scalar()


@query(
    "c12_spike_risk",
    with_sql(
        "SELECT ts, price, CAST(d AS VARCHAR) AS local_date, h AS local_hour, is_top_hour, round(wind_multiplier, 6) AS wind_multiplier, is_future, is_risk FROM flagged",
        WIDE, NOW, RISK_START, RISK,
    ),
)
def c12(t):
    return risk.spike_risk(risk_input(t), risk_now(t)).drop("wind")


@query(
    "c13_scaled_prices",
    with_sql(
        "SELECT ts, price, is_risk, ROUND(CASE WHEN is_risk THEN price * wind_multiplier END, 2) AS price_scaled FROM flagged",
        WIDE, NOW, RISK_START, RISK,
    ),
)
def c13(t):
    return risk.scale_prices(risk_input(t), risk_now(t)).select("ts", "price", "is_risk", "price_scaled")


@query(
    "j21_scaled_price_replaces",
    with_sql("SELECT ts, coalesce(ROUND(CASE WHEN is_risk THEN price * wind_multiplier END, 2), price) AS price FROM flagged", WIDE, NOW, RISK_START, RISK),
)
def j21(t):
    return risk.apply_scaled(risk.scale_prices(risk_input(t), risk_now(t))).select("ts", "price")


@query(
    "k10_risk_markers",
    with_sql(
        f"SELECT {ms_sql('ts')} AS ms, ROUND(CASE WHEN is_risk THEN price * wind_multiplier END, 2) AS value FROM flagged, now_ WHERE ts >= now - INTERVAL 20 DAY",
        WIDE, NOW, RISK_START, RISK,
    ),
)
def k10(t):
    return risk.risk_markers(risk.scale_prices(risk_input(t), risk_now(t)), risk_now(t))


@query("a30_peak_hour", with_sql(", p AS (SELECT d, h AS peak_hour FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY price DESC, ts) AS k FROM flagged WHERE is_risk) WHERE k = 1) SELECT CAST(a.d AS VARCHAR) AS local_date, peak_hour FROM (SELECT DISTINCT d FROM flagged) a LEFT JOIN p USING (d)", WIDE, NOW, RISK_START, RISK))
def a30(t):
    return risk.risk_peak_per_day(risk.spike_risk(risk_input(t), risk_now(t))).select("local_date", "peak_hour")


@query("f34_risk_text", with_sql(", p AS (SELECT d, h FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY price DESC, ts) AS k FROM flagged WHERE is_risk) WHERE k = 1) SELECT CAST(a.d AS VARCHAR) AS local_date, CASE WHEN h IS NULL THEN 'none' ELSE greatest(h - 1, 0) || '–' || least(h + 1, 23) END AS risk_text FROM (SELECT DISTINCT d FROM flagged) a LEFT JOIN p USING (d)", WIDE, NOW, RISK_START, RISK))
def f34(t):
    return risk.risk_peak_per_day(risk.spike_risk(risk_input(t), risk_now(t))).select("local_date", "risk_text")


# Sorts and limits


@query("o1_sorted_by_key", with_sql("SELECT ts, series_id, value FROM hourly", HOURLY))
def o1(t):
    return hourly(t).select("ts", "series_id", "value").orderBy("ts", "series_id")


@query("o2_ranked_descending", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", digits=2)
def o2(t):
    return t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).orderBy(F.col("total").desc(), "o_custkey")


@query("o3_head_days", with_sql("SELECT CAST(date AS VARCHAR) AS date, n FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1) ORDER BY date LIMIT 6"))
def o3(t):
    return t.events.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n")).orderBy("date").limit(6)


@query(
    "o5_worst_coverage",
    with_sql(
        """, c AS (SELECT series_id, count(*) - count(value) AS missing, count(value) / count(*) AS coverage FROM gapped GROUP BY 1)
           SELECT series_id, round(coverage, 6) AS worst_coverage, missing FROM c""",
        HOURLY, GRID,
    ),
)
def o5(t):
    cov = quality.coverage(complete_grid(hourly(t), "series_id"), ["value"], "series_id")
    return quality.worst_coverage(cov, "series_id")


@query("o6_smallest_trials", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 10")
def o6(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy("l_extendedprice", "l_orderkey", "l_linenumber").limit(10)


# Feed refreshes


@query(
    "c1_station_series",
    with_sql(
        """, g AS (SELECT series_id, ts, value FROM dgapped),
             fi AS (SELECT series_id, ts, CASE WHEN value > 100000 THEN value END AS value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, 'f' AS src FROM fresh),
             hi AS (SELECT series_id, ts, CASE WHEN value > 100000 THEN value END AS value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, 'h' AS src FROM backup),
             u AS (SELECT * FROM fi UNION ALL SELECT * FROM hi),
             k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, last_value(value IGNORE NULLS) OVER p AS v0,
                          first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER n AS i1, first_value(value IGNORE NULLS) OVER n AS v1
                   FROM u WINDOW p AS (PARTITION BY src, series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                                 n AS (PARTITION BY src, series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
             l AS (SELECT src, series_id, ts, CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END AS value FROM k),
             feed AS (SELECT coalesce(f.series_id, h.series_id) AS series_id, coalesce(f.ts, h.ts) AS ts, CASE WHEN f.ts IS NOT NULL THEN f.value ELSE h.value END AS value
                      FROM (SELECT * FROM l WHERE src = 'f') f FULL JOIN (SELECT * FROM l WHERE src = 'h') h ON f.series_id = h.series_id AND f.ts = h.ts)
           SELECT g.series_id, g.ts, round(coalesce(g.value, feed.value), 4) AS temperature FROM g LEFT JOIN feed USING (series_id, ts)""",
        DAILY, STORE, FRESH, BACKUP, GRID_DAILY,
    ),
    digits=4,
)
def c1(t):
    """Frame: store on its complete days; forecast and history: the two other sources,
    with the low values missing."""
    frame = complete_grid(source(t, "F"), "series_id", step="1 day", bucket="365 days").withColumnRenamed("value", "temperature")
    cut = lambda s: source(t, s).withColumn("value", F.when(F.col("value") > 100000, F.col("value")))
    return feeds.station_series(frame, cut("O"), cut("P"), "temperature", "series_id")


@query(
    "c2_nuclear",
    with_sql(
        """, f AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
           SELECT w.ts, w.purchase, round(last_value(f.v IGNORE NULLS) OVER (ORDER BY w.ts), 6) AS nuclear FROM wide w LEFT JOIN f USING (ts)""",
        WIDE,
    ),
)
def c2(t):
    frame = wide(t).select("ts", "purchase", F.lit(-1.0).alias("nuclear"))
    return feeds.nuclear(frame, t.events.where("event_type = 'click'").select("ts", "value"), "nuclear")


EDGES = "coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query(
    "c3_import_capacity",
    with_sql(
        """, b AS (SELECT ts, click, error, signup, coalesce(click, 0) + coalesce(error, 0) + coalesce(signup, 0) AS s FROM wide WHERE coalesce(click, error, signup) IS NOT NULL),
             z AS (SELECT *, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (ORDER BY ts), s) AS total FROM b),
             j AS (SELECT w.ts, w.purchase, z.click, z.error, z.signup, z.total FROM wide w LEFT JOIN z USING (ts))
           SELECT ts, purchase, """
        + ", ".join(f"{EDGES.format(c=c)} AS {c}" for c in ("click", "error", "signup"))
        + f", round({EDGES.format(c='total')}, 6) AS import_capacity FROM j",
        WIDE,
    ),
)
def c3(t):
    flows = hourly(t).withColumnRenamed("series_id", "border").where("border IN ('click', 'error', 'signup')")
    return feeds.import_capacity(wide(t).select("ts", "purchase"), flows, ["click", "error", "signup"])


@query(
    "c3_import_capacity_with_backup",
    with_sql(
        f""", j AS (SELECT ts, purchase, coalesce(click, error) AS capacity FROM wide)
           SELECT ts, purchase, {EDGES.format(c='capacity')} AS capacity FROM j""",
        WIDE,
    ),
)
def c3_backup(t):
    h = hourly(t)
    primary, backup = (h.where(F.col("series_id") == s).select("ts", "value") for s in ("click", "error"))
    return feeds.import_capacity_with_backup(wide(t).select("ts", "purchase"), primary, backup, "capacity")


COMBINED = """combined AS (
    SELECT coalesce(h.series_id, f.series_id) AS series_id, coalesce(h.ts, f.ts) AS ts, coalesce(h.value, f.value) AS value
    FROM (SELECT series_id, ts, CASE WHEN value > 15 THEN value END AS value FROM hourly, now_ WHERE ts <= now) h
    FULL JOIN (SELECT series_id, ts, value + 1 AS value FROM hourly, now_ WHERE ts >= now - INTERVAL 2 DAY) f ON h.series_id = f.series_id AND h.ts = f.ts),
  cgrid AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM combined GROUP BY 1),
  cgapped AS (SELECT g.series_id, g.ts, c.value FROM cgrid g LEFT JOIN combined c USING (series_id, ts))"""


@query(
    "c4_location_wind",
    with_sql(
        "SELECT w.ts, w.purchase, "
        + ", ".join(f"round(max(l.value) FILTER (WHERE l.series_id = '{c}'), 6) AS {c}" for c in ("click", "error", "view"))
        + " FROM wide w LEFT JOIN lerped l USING (ts) GROUP BY w.ts, w.purchase",
        HOURLY, WIDE, NOW, COMBINED, INTERP.format(src="cgapped"),
    ),
)
def c4(t):
    """History up to now, forecast from two days before; history wins the overlap."""
    h, at = hourly(t).withColumnRenamed("series_id", "location"), now(t)
    history = h.where(F.col("ts") <= at).withColumn("value", F.when(F.col("value") > 15, F.col("value")))
    forecast = h.where(F.col("ts") >= at - F.expr("INTERVAL 2 DAYS")).withColumn("value", F.col("value") + 1)
    return feeds.location_wind(wide(t).select("ts", "purchase", "click"), history, forecast, ["click", "error", "view"])


@query(
    "c5_wind_power",
    with_sql(
        f""", r AS (SELECT date_trunc('hour', ts) AS ts, avg(value) FILTER (WHERE event_type = 'click') AS re, avg(value) FILTER (WHERE event_type = 'view') AS fc,
                         avg(value) FILTER (WHERE event_type = 'signup' AND value > 100) AS cap FROM events GROUP BY 1),
             j AS (SELECT w.ts, w.purchase, CASE WHEN w.ts <= now THEN coalesce(re, fc) ELSE fc END AS wind, cap FROM wide w LEFT JOIN r USING (ts), now_)
           SELECT ts, purchase, round(wind, 6) AS wind, round({EDGES.format(c='cap')}, 6) AS wind_capacity FROM j""",
        WIDE, NOW,
    ),
)
def c5(t):
    feed = lambda e: t.events.where(F.col("event_type") == e).select("ts", "value")
    capacity = feed("signup").withColumn("value", F.when(F.col("value") > 100, F.col("value")))
    return feeds.wind_power(wide(t).select("ts", "purchase"), feed("click"), feed("view"), capacity, now(t))


@query(
    "c5_wind_power_model",
    with_sql(
        f""", r AS (SELECT date_trunc('hour', ts) AS ts, avg(value) FILTER (WHERE event_type = 'click') AS re, avg(value) FILTER (WHERE event_type = 'view') AS fc,
                         avg(value) FILTER (WHERE event_type = 'signup' AND value > 100) AS cap FROM events GROUP BY 1),
             j AS (SELECT w.ts, w.purchase, CASE WHEN w.ts <= now THEN coalesce(re, fc) ELSE fc END AS wind, cap FROM wide w LEFT JOIN r USING (ts), now_),
             k AS (SELECT ts, purchase, wind, {EDGES.format(c='cap')} AS wind_capacity FROM j),
             m AS (SELECT regr_slope(wind / wind_capacity, purchase) AS slope, regr_intercept(wind / wind_capacity, purchase) AS base FROM k WHERE wind_capacity > 0)
           SELECT ts, purchase, round(coalesce(wind, (base + slope * purchase) * wind_capacity), 6) AS wind, round(wind_capacity, 6) AS wind_capacity FROM k, m""",
        WIDE, NOW,
    ),
)
def c5_model(t):
    """Hours with neither reading nor forecast get the share that a model of the other hours predicts."""
    from ..ml import models as mo

    feed = lambda e: t.events.where(F.col("event_type") == e).select("ts", "value")
    capacity = feed("signup").withColumn("value", F.when(F.col("value") > 100, F.col("value")))
    parts = (wide(t).select("ts", "purchase"), feed("click"), feed("view"), capacity, now(t))
    known = feeds.wind_power(*parts).where("wind_capacity > 0").withColumn("share", F.col("wind") / F.col("wind_capacity"))
    trained = mo.Trained(mo.fit_linear(known, ["purchase"], "share", l2=0.0), ["purchase"], 0)
    return feeds.wind_power(*parts, mo.share_predictor(trained))


@query(
    "c6_outage_capacity",
    with_sql(
        """SELECT w.ts, round(4372 - coalesce(sum(o.nominal_power - o.avail_qty), 0), 6) AS nuclear FROM wide w
           LEFT JOIN (SELECT * FROM outages, now_ WHERE "end" > now) o ON o.start <= w.ts AND w.ts < o."end" GROUP BY 1""",
        WIDE, OUTAGES, NOW,
    ),
)
def c6(t):
    at = now(t)
    from ..sources.feeds import open_outages

    return feeds.outage_capacity(wide(t).select("ts", F.col("click").alias("nuclear")), open_outages(outages(t), at), "nuclear", at)


@query(
    "c7_spot_price_linear",
    with_sql(
        ", patched AS (SELECT 'site' AS series_id, ts, coalesce(purchase, CASE WHEN view > 60 THEN view END) AS value FROM wide), "
        + INTERP.format(src="patched")
        + " SELECT ts, round(value, 6) AS price FROM lerped",
        WIDE,
    ),
)
def c7(t):
    frame = wide(t).select("ts", F.col("purchase").alias("price"))
    feed = wide(t).select("ts", F.when(F.col("view") > 60, F.col("view")).alias("price"))
    return feeds.spot_price(frame, feed, "price", cubic=False)


@query("c7_spot_price_cubic", with_sql("SELECT ts, coalesce(purchase, CASE WHEN view > 60 THEN view END) AS known, TRUE AS passes FROM wide", WIDE))
def c7_cubic(t):
    """Stored prices, then the feed's, stay as they are; the spline fills the rest."""
    frame = wide(t).select("ts", F.col("purchase").alias("price"))
    feed = wide(t).select("ts", F.when(F.col("view") > 60, F.col("view")).alias("price"))
    known = frame.join(feed.withColumnRenamed("price", "_feed"), "ts").select("ts", F.coalesce("price", "_feed").alias("known"))
    out = feeds.spot_price(frame, feed, "price").join(known, "ts")
    return out.select("ts", "known", F.coalesce(F.col("price") == F.col("known"), F.lit(True)).alias("passes"))


IRR_COLS = ["sum_irradiance", "mean_irradiance", "std_irradiance", "min_irradiance", "max_irradiance"]


def _lerp_sql(c: str) -> str:
    p = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    n = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    t0 = f"last_value(CASE WHEN {c} IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER (ORDER BY ts {p})"
    t1 = f"first_value(CASE WHEN {c} IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER (ORDER BY ts {n})"
    v0 = f"last_value({c} IGNORE NULLS) OVER (ORDER BY ts {p})"
    v1 = f"first_value({c} IGNORE NULLS) OVER (ORDER BY ts {n})"
    return f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {v0} IS NULL THEN NULL WHEN {v1} IS NULL THEN {v0} ELSE {v0} + ({v1} - {v0}) * (epoch(ts) - {t0}) / ({t1} - {t0}) END"


@query(
    "c9_irradiance",
    with_sql(
        """, x AS (SELECT ts, coalesce(sum(value), 0) AS sum_irradiance, avg(value) AS mean_irradiance, stddev_samp(value) AS std_irradiance,
                  min(value) AS min_irradiance, max(value) AS max_irradiance FROM (SELECT ts, CASE WHEN value > 45 THEN value END AS value FROM hourly) GROUP BY 1),
             g AS (SELECT unnest(generate_series((SELECT min(ts) FROM x), (SELECT max(ts) FROM x), INTERVAL 1 HOUR)) AS ts),
             j AS (SELECT ts, x.* EXCLUDE (ts) FROM g LEFT JOIN x USING (ts)),
             b AS (SELECT * REPLACE (coalesce(first_value(sum_irradiance IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                                              last_value(sum_irradiance IGNORE NULLS) OVER (ORDER BY ts)) AS sum_irradiance) FROM j),
             l AS (SELECT ts, sum_irradiance, """
        + ", ".join(f"{_lerp_sql(c)} AS {c}" for c in IRR_COLS[1:])
        + """ FROM b), f AS (SELECT w.ts, l.* EXCLUDE (ts) FROM wide w LEFT JOIN l USING (ts))
           SELECT ts, round(last_value(sum_irradiance IGNORE NULLS) OVER (ORDER BY ts), 6) AS sum_irradiance, """
        + ", ".join(f"round({c}, 6) AS {c}" for c in IRR_COLS[1:])
        + " FROM f",
        HOURLY, WIDE,
    ),
)
def c9(t):
    """Hours with large values only, so that the statistics have holes; the history covers
    the hours up to now, the forecast the hours after."""
    rows, at = hourly(t).withColumn("value", F.when(F.col("value") > 45, F.col("value"))), now(t)
    return feeds.irradiance(wide(t).select("ts"), rows.where(F.col("ts") <= at), rows.where(F.col("ts") > at))


@query(
    "c10_hydrology",
    with_sql(
        """, kept AS (SELECT * FROM places),
             kgrid AS (SELECT place, unnest(generate_series(min(ts), TIMESTAMP '2002-12-31', INTERVAL 1 DAY)) AS ts FROM kept GROUP BY 1),
             carried AS (SELECT g.ts, last_value(k.value IGNORE NULLS) OVER (PARTITION BY g.place ORDER BY g.ts) AS value FROM kgrid g LEFT JOIN kept k USING (place, ts)),
             d AS (SELECT CAST(ts AS DATE) AS date, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.1) AS q FROM carried WHERE ts >= TIMESTAMP '1996-01-01' GROUP BY 1),
             f AS (SELECT ts, max(value) AS held FROM ship GROUP BY 1)
           SELECT f.ts, round(coalesce(m, held), 4) AS hydro_median, round(q, 4) AS hydro_p10 FROM f LEFT JOIN d ON d.date = CAST(f.ts AS DATE)""",
        SHIP, PLACES,
    ),
    digits=4,
)
def c10(t):
    """Seven years of hours, refreshed from 1996 on."""
    frame = ship(t).groupBy("ts").agg(F.max("value").alias("hydro_median"))
    return feeds.hydrology(frame, places(t), start="1996-01-01 00:00:00", end="2002-12-31 00:00:00")


@query(
    "c11_hydrology_backfill",
    with_sql(
        """, d AS (SELECT date_trunc('day', ts) AS ts, round(avg(value), 6) AS median FROM events WHERE event_type = 'error' GROUP BY 1)
           SELECT w.ts, d.median FROM wide w ASOF LEFT JOIN d ON w.ts >= d.ts WHERE w.ts BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-28'""",
        WIDE,
    ),
)
def c11(t):
    from .registry import rnd

    d = t.events.where("event_type = 'error'").groupBy(F.date_trunc("day", "ts").alias("ts")).agg(rnd(F.avg("value")).alias("median"))
    return feeds.hydrology_backfill(wide(t), d, ["median"], start="2024-01-04 00:00:00", end="2024-01-28 00:00:00")


@query(
    "c15_gap_plan",
    with_sql(
        """, st AS (SELECT series_id, ts, value AS t, CASE WHEN value > 30 THEN value END AS ws FROM hourly),
             r AS (SELECT s.series_id, g.ts FROM (SELECT DISTINCT series_id FROM hourly) s CROSS JOIN (
                   SELECT unnest(generate_series(TIMESTAMP '2023-12-31', (SELECT now FROM now_), INTERVAL 1 HOUR)) AS ts) g),
             slice AS (SELECT r.series_id, r.ts, st.t, st.ws FROM r LEFT JOIN st USING (series_id, ts)),
             cand AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(max(value), 6) AS t, round(min(value), 6) AS ws FROM events GROUP BY 1, 2),
             merged AS (SELECT s.series_id, s.ts, coalesce(c.t, s.t) AS t, coalesce(c.ws, s.ws) AS ws FROM slice s LEFT JOIN cand c USING (series_id, ts)),
             b AS (SELECT series_id, count(*) AS expected, count(*) - count(t) AS mt, count(*) - count(ws) AS mw FROM slice GROUP BY 1),
             a AS (SELECT series_id, count(*) - count(t) AS mt, count(*) - count(ws) AS mw FROM merged GROUP BY 1)
           SELECT b.series_id, 't' AS column_name, b.expected, b.mt AS missing_before, a.mt AS remaining, b.mt - a.mt AS filled FROM b JOIN a USING (series_id)
           UNION ALL SELECT b.series_id, 'ws', b.expected, b.mw, a.mw, b.mw - a.mw FROM b JOIN a USING (series_id)""",
        HOURLY, NOW,
    ),
)
def c15(t):
    store, cand, bounds = gap_inputs(t)
    return quality.gap_plan(store, cand, "series_id", ["t", "ws"], *bounds)[2]


def gap_inputs(t):
    from .registry import rnd

    store = hourly(t).select("series_id", "ts", F.col("value").alias("t"), F.when(F.col("value") > 30, F.col("value")).alias("ws"))
    cand = t.events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts")).agg(
        rnd(F.max("value")).alias("t"), rnd(F.min("value")).alias("ws")
    )
    lit = lambda s: F.lit(s).cast("timestamp")
    return store, cand, (lit("2023-12-31 00:00:00"), lit("2024-03-01 00:00:00"), now(t))


@query(
    "c15_gap_plan_ranges",
    with_sql(
        """, r AS (SELECT s.series_id, g.ts FROM (SELECT DISTINCT series_id FROM hourly) s CROSS JOIN (
                   SELECT unnest(generate_series(TIMESTAMP '2023-12-31', (SELECT now FROM now_), INTERVAL 1 HOUR)) AS ts) g),
             m AS (SELECT r.* FROM r LEFT JOIN hourly h USING (series_id, ts) WHERE h.value IS NULL OR h.value <= 30),
             k AS (SELECT *, ts - to_hours(row_number() OVER (PARTITION BY series_id ORDER BY ts)) AS island FROM m)
           SELECT series_id, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS hours FROM k GROUP BY series_id, island""",
        HOURLY, NOW,
    ),
)
def c15_ranges(t):
    store, cand, bounds = gap_inputs(t)
    return quality.gap_plan(store, cand, "series_id", ["t", "ws"], *bounds)[1]


@query(
    "c15_gap_plan_updates",
    with_sql(
        """, st AS (SELECT series_id, ts, value AS t, CASE WHEN value > 30 THEN value END AS ws FROM hourly),
             cand AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(max(value), 6) AS t, round(min(value), 6) AS ws FROM events GROUP BY 1, 2)
           SELECT c.* FROM cand c LEFT JOIN st s USING (series_id, ts), now_ WHERE c.ts <= now AND (s.t IS NULL OR s.ws IS NULL)""",
        HOURLY, NOW,
    ),
)
def c15_updates(t):
    store, cand, bounds = gap_inputs(t)
    return quality.gap_plan(store, cand, "series_id", ["t", "ws"], *bounds)[0]


@query(
    "c18_serving_series",
    with_sql(
        f""", a AS (SELECT series_id, ts, value FROM hourly, now_ WHERE ts <= now),
             m AS (SELECT * FROM a UNION ALL SELECT series_id, ts, value + 1 FROM hourly WHERE ts >= (SELECT max(ts) + INTERVAL 1 HOUR FROM a))
           SELECT series_id, ts, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY series_id, CAST({local_sql('ts - INTERVAL 1 HOUR')} AS DATE)), 6) AS day_average FROM m""",
        HOURLY, NOW,
    ),
)
def c18(t):
    h, at = hourly(t), now(t)
    return serving.serving_series(h.where(F.col("ts") <= at), h.withColumn("value", F.col("value") + 1), "series_id", at)


@query(
    "c18_serving_windows",
    with_sql(
        """, a AS (SELECT series_id, ts, value FROM hourly, now_ WHERE ts <= now),
             m AS (SELECT * FROM a UNION ALL SELECT series_id, ts, value + 1 FROM hourly WHERE ts >= (SELECT max(ts) + INTERVAL 1 HOUR FROM a)),"""
        + cheapest_sql("m", (3, 6, 12), LOOKAHEAD, 'CAST("end" < now AS INTEGER)'),
        HOURLY, NOW,
    ),
)
def c18_windows(t):
    h, at = hourly(t), now(t)
    return serving.serving_windows(h.where(F.col("ts") <= at), h.withColumn("value", F.col("value") + 1), "series_id", at, digits=9)


@query(
    "c19_history_comparison",
    with_sql(
        f""", dates AS (SELECT DISTINCT snapshot_date FROM snapshots ORDER BY 1 DESC LIMIT 35),
             ages AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date DESC) - 1 AS age FROM dates),
             kept AS (SELECT * FROM snapshots JOIN ages USING (snapshot_date) WHERE age > 0 AND ts >= day + INTERVAL 2 DAY),
             pruned AS (SELECT k.* FROM kept k JOIN (SELECT snapshot_date, min(ts) AS t0 FROM kept GROUP BY 1) f USING (snapshot_date) WHERE ts < t0 + INTERVAL 240 HOUR),
             every AS (SELECT snapshot_date, age, ts, value FROM pruned UNION ALL SELECT NULL, NULL, ts, actual FROM actuals)
           SELECT snapshot_date, age, {utc_sql('CAST(d AS TIMESTAMP) + to_hours(h)')} AS ts, round(avg(value), 6) AS value FROM (
             SELECT *, CAST({local_sql('ts')} AS DATE) AS d, CAST(floor(hour({local_sql('ts')}) / 12) * 12 AS BIGINT) AS h FROM every) GROUP BY snapshot_date, age, d, h""",
        SNAPSHOTS, ACTUALS,
    ),
)
def c19(t):
    shown = actuals(t).withColumnRenamed("actual", "value")
    return serving.history_comparison(snapshots(t), shown, horizon_hours=240, bin_hours=12)


# Published views

YESTERDAY = utc_sql(f"date_trunc('day', {local_sql('now')}) - INTERVAL 1 DAY")


@query("k5_pair_series", with_sql(f"SELECT series_id, {ms_sql('ts')} AS ms, value FROM hourly, now_ WHERE ts >= {YESTERDAY}", HOURLY, NOW))
def k5(t):
    return publish.pair_series(publish.from_yesterday(hourly(t), now(t)), "value", "series_id")


@query("k5_pair_documents", with_sql(f"SELECT series_id, {ms_sql('ts')} AS ms, round(value, 6) AS value FROM ship", SHIP))
def k5_documents(t):
    """Bounded JSON documents, decoded again to show that nothing is lost."""
    from ..sources.feeds import decode_pairs

    docs = publish.pair_documents(ship(t), "value", "series_id")
    rows = decode_pairs(docs.select("series_id", "payload"))
    return rows.select("series_id", F.unix_millis("ts").alias("ms"), "value")


@query(
    "k6_local_records",
    with_sql(
        f"""SELECT series_id, strftime({local_sql('ts')}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch({local_sql('ts')}) - epoch(ts) = 7200 THEN '+02:00' ELSE '+03:00' END AS ts,
                   round(value, 6) AS value FROM ship""",
        SHIP,
    ),
)
def k6(t):
    return publish.local_records(ship(t))


@query(
    "k7_local_day_averages",
    with_sql(
        f"""SELECT series_id, {ms_sql(utc_sql('CAST(d AS TIMESTAMP)'))} AS ms, round(avg(value), 6) AS value
            FROM (SELECT *, CAST({local_sql('ts')} AS DATE) AS d FROM ship) GROUP BY series_id, d""",
        SHIP,
    ),
)
def k7(t):
    return publish.local_day_averages(ship(t), "value", "series_id")


@query(
    "k9_retained_snapshots",
    with_sql("SELECT snapshot_date, ts, value FROM snapshots WHERE snapshot_date IN (SELECT DISTINCT snapshot_date FROM snapshots ORDER BY 1 DESC LIMIT 40)", SNAPSHOTS),
)
def k9(t):
    return publish.retained_snapshots(snapshots(t), 40)


@query("k13_outage_records", with_sql('SELECT event_id, start, "end", round(epoch("end") / 3600 - epoch(start) / 3600, 3) AS hours, round(avail_qty / nominal_power, 6) AS availability FROM outages, now_ WHERE "end" > now', OUTAGES, NOW))
def k13(t):
    return publish.outage_records(outages(t), now(t)).select("event_id", "start", "end", "hours", "availability")

