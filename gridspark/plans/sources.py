"""Sources: documents are formed from the tables by Spark and decoded back into facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import utc_iso
from ..operators.quality import too_many_missing
from ..operators.spine import spine
from ..session import scratch_path
from ..sinks import publish
from ..sources import feeds
from ..sources.store import lookup, read_csv_table, read_store, scan_between, slice_on_grid
from ..sinks.store import write_store
from .inputs import DAILY, GRID, HOURLY, HOURLY_RAW, SHIP, TZ, daily, hourly, ship, with_sql
from .registry import query


@query("s1_store_scan", with_sql("SELECT series_id, ts, value FROM hourly", HOURLY))
def s1(t):
    """Written once, partitioned by date, and read back as a whole."""
    path = scratch_path(t.spark, "store")
    write_store(hourly(t), path)
    return read_store(t.spark, path, hourly(t).schema).select("series_id", "ts", "value")


def stored(t):
    """The hourly store on storage, partitioned by date."""
    path = scratch_path(t.spark, "store")
    write_store(hourly(t), path)
    return read_store(t.spark, path)


@query(
    "s2_keyed_lookup",
    with_sql(
        "SELECT h.series_id, h.ts, h.value FROM hourly h JOIN (SELECT date_trunc('hour', ts) AS ts, event_type AS series_id "
        "FROM events WHERE event_id % 7 = 0) k ON h.ts = k.ts AND h.series_id = k.series_id",
        HOURLY,
    ),
)
def s2(t):
    """Stored hours of every seventh event; a repeated key yields repeated rows."""
    keys = t.events.where("event_id % 7 = 0").select(
        F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("series_id")
    )
    return lookup(stored(t).drop("date"), keys, ["ts", "series_id"])


@query(
    "s3_bounded_scan",
    with_sql(
        "SELECT ts, series_id, value FROM hourly WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'",
        HOURLY,
    ),
)
def s3(t):
    return scan_between(stored(t), "2024-01-05 00:00:00", "2024-01-20 12:00:00", ["series_id", "value"])


@query(
    "s4_slice_reindex",
    with_sql(
        """SELECT s.series_id, r.ts, h.value
           FROM (SELECT DISTINCT series_id FROM hourly) s
           CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-02-03 05:00:00', INTERVAL 1 HOUR)) AS ts) r
           LEFT JOIN hourly h ON h.series_id = s.series_id AND h.ts = r.ts""",
        HOURLY,
    ),
)
def s4(t):
    return slice_on_grid(stored(t), "series_id", "2024-01-10 00:00:00", "2024-02-03 05:00:00", ["value"])


@query("s5_price_feed", "SELECT event_id, ts, round(value * 0.1, 6) AS price FROM events")
def s5(t):
    """One price document per event."""
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date"), "value")
    docs = t.events.select("event_id", F.to_json(F.struct(F.array(entry).alias("prices"))).alias("payload"))
    return feeds.decode_prices(docs)


@query(
    "s6_station_xml",
    """SELECT user_id % 1000 AS station, date_trunc('hour', ts) AS ts,
              round(sum(CASE WHEN event_type = 'click' AND value >= 1 THEN value END), 6) AS temperature,
              round(sum(CASE WHEN event_type = 'view' AND value >= 1 THEN value END), 6) AS wind_speed
       FROM events GROUP BY 1, 2""",
)
def s6(t):
    """Element documents; readings below one are sent as NaN and must come back missing."""
    reading = F.when(F.col("value") < 1, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    name = F.when(F.col("event_type") == "click", "temperature").when(F.col("event_type") == "view", "wind_speed").otherwise("other")
    xml = F.format_string(
        "<BsWfs:BsWfsElement><BsWfs:Time>%s</BsWfs:Time><BsWfs:ParameterName>%s</BsWfs:ParameterName>"
        "<BsWfs:ParameterValue>%s</BsWfs:ParameterValue></BsWfs:BsWfsElement>",
        utc_iso(F.date_trunc("hour", "ts")), name, reading,
    )
    docs = t.events.select((F.col("user_id") % 1000).alias("station"), xml.alias("payload"))
    rows = feeds.decode_station_xml(docs)
    # Several events of a station may share an hour; a real feed has one reading each.
    rows = rows.groupBy("station", "ts", "parameter").agg(F.sum("value").alias("value"))
    return feeds.station_wide(rows, ["temperature", "wind_speed"]).drop("repeats")


@query(
    "s6_station_documents",
    """SELECT user_id % 1000 AS station, date_trunc('hour', ts) AS ts,
              round(sum(CASE WHEN event_type = 'click' AND value >= 1 THEN value END), 6) AS temperature,
              round(sum(CASE WHEN event_type = 'view' AND value >= 1 THEN value END), 6) AS wind_speed
       FROM events GROUP BY 1, 2""",
)
def s6_documents(t):
    """One document per station and day with an element for every reading; readings below one are
    sent as NaN and must come back missing."""
    reading = F.when(F.col("value") < 1, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    name = F.when(F.col("event_type") == "click", "temperature").when(F.col("event_type") == "view", "wind_speed").otherwise("other")
    element = F.format_string(
        "<wfs:member><BsWfs:BsWfsElement><BsWfs:Time>%s</BsWfs:Time><BsWfs:ParameterName>%s</BsWfs:ParameterName>"
        "<BsWfs:ParameterValue>%s</BsWfs:ParameterValue></BsWfs:BsWfsElement></wfs:member>",
        utc_iso(F.date_trunc("hour", "ts")), name, reading,
    )
    rows = t.events.select((F.col("user_id") % 1000).alias("station"), F.to_date("ts").alias("day"), element.alias("e"))
    docs = rows.groupBy("station", "day").agg(F.concat_ws("", F.collect_list("e")).alias("e"))  # a station's readings of a day
    docs = docs.select("station", F.concat(F.lit("<wfs:FeatureCollection>"), "e", F.lit("</wfs:FeatureCollection>")).alias("payload"))
    rows = feeds.decode_station_documents(docs).groupBy("station", "ts", "parameter").agg(F.sum("value").alias("value"))
    return feeds.station_wide(rows, ["temperature", "wind_speed"]).drop("repeats")


@query(
    "s7_grid_feed",
    """SELECT event_type AS series_id, date_trunc('second', ts) AS ts,
              date_trunc('second', ts) + INTERVAL 3 MINUTE AS end_ts,
              CASE WHEN value < 5 THEN NULL ELSE value END AS value FROM events""",
)
def s7(t):
    """Start times as epoch milliseconds for errors and ISO text otherwise; small values
    arrive as text that is no number."""
    sec = F.date_trunc("second", "ts")
    begin = F.when(F.col("event_type") == "error", F.unix_millis(sec).cast("string")).otherwise(utc_iso(sec))
    entry = F.struct(
        F.col("event_type").alias("datasetId"),
        begin.alias("startTime"),
        utc_iso(sec + F.expr("INTERVAL 3 MINUTES")).alias("endTime"),
        F.when(F.col("value") < 5, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"),
    )
    docs = t.events.select(F.to_json(F.struct(F.array(entry).alias("data"))).alias("payload"))
    return feeds.decode_grid_feed(docs)


@query(
    "s8_border_flows",
    with_sql(
        """, last_ AS (
             SELECT date_trunc('hour', ts) AS ts, event_type, arg_max(value, (event_id)) AS value
             FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1, 2)
           SELECT ts, CASE event_type WHEN 'click' THEN 'SE1_FI' WHEN 'error' THEN 'SE3_FI' ELSE 'EE_FI' END AS border, value
           FROM last_""".replace(", last_ AS", "WITH last_ AS", 1),
    ),
)
def s8(t):
    """Every event is one fetched document; the latest one per hour and border wins."""
    cols = {"click": "border_SE1_FI", "error": "border_SE3_FI", "view": "border_EE_FI"}
    entry = F.struct(
        utc_iso(F.date_trunc("hour", "ts")).alias("dateTimeUtc"),
        *[F.when(F.col("event_type") == e, F.col("value").cast("string")).alias(c) for e, c in cols.items()],
    )
    docs = t.events.select("event_id", F.to_json(F.struct(F.array(entry).alias("data"))).alias("payload"))
    return feeds.decode_border_flows(docs, "event_id").drop("event_id")


@query(
    "s9_carried_capacity",
    with_sql(
        """SELECT s.series_id, r.ts, last_value(h.value IGNORE NULLS) OVER (PARTITION BY s.series_id ORDER BY r.ts) AS value
           FROM (SELECT DISTINCT series_id FROM hourly) s
           CROSS JOIN (SELECT unnest(generate_series((SELECT min(ts) FROM hourly), (SELECT max(ts) FROM hourly), INTERVAL 1 HOUR)) AS ts) r
           LEFT JOIN hourly h ON h.series_id = s.series_id AND h.ts = r.ts""",
        HOURLY,
    ),
)
def s9(t):
    h = hourly(t)
    lo, hi = h.agg(F.min("ts")).scalar(), h.agg(F.max("ts")).scalar()
    return feeds.carried_capacity(h, lo, hi)


def _array_docs(t, variable):
    """One document per user and hour: the hour's events as parallel arrays.  The arrays
    are short: a user has few events in an hour."""
    rows = t.events.select(
        F.col("user_id").alias("location"),
        "event_id",
        F.struct(
            F.struct(
                F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm")).alias("time"),
                F.array(F.col("value"), F.col("value") - 20).alias(variable),
            ).alias("hourly")
        ).alias("doc"),
    )
    return rows.select("location", "event_id", F.to_json("doc").alias("payload"))


ARRAY_ROWS = """array_rows AS (
    SELECT user_id AS location, event_id, date_trunc('minute', ts) AS ts, value FROM events
    UNION ALL SELECT user_id, event_id, date_trunc('minute', ts) + INTERVAL 1 HOUR, value - 20 FROM events)"""


@query("s10_parallel_arrays", with_sql("SELECT location, event_id, ts, round(value, 6) AS value FROM array_rows", ARRAY_ROWS))
def s10(t):
    return feeds.decode_arrays(_array_docs(t, "wind_speed_120m"), "wind_speed_120m")


@query(
    "s11_solar_arrays",
    with_sql(
        """SELECT ts, round(coalesce(sum(v), 0), 6) AS sum_irradiance, round(avg(v), 6) AS mean_irradiance,
                  round(stddev_samp(v), 6) AS std_irradiance, round(min(v), 6) AS min_irradiance, round(max(v), 6) AS max_irradiance
           FROM (SELECT date_trunc('hour', ts) AS ts, greatest(value, 0) AS v FROM array_rows) GROUP BY 1""",
        ARRAY_ROWS,
    ),
)
def s11(t):
    """Negative irradiance counts as zero; statistics across locations per hour."""
    from ..operators.rollup import across_locations

    rows = feeds.decode_arrays(_array_docs(t, "shortwave_radiation"), "shortwave_radiation", clip_negative=True)
    return across_locations(rows.withColumn("ts", F.date_trunc("hour", "ts")), "ts", "value", "irradiance")


@query(
    "s12_hydrology_rows",
    """SELECT CAST(user_id AS BIGINT) AS place, date_trunc('day', ts) AS ts, arg_max(value, event_id) AS value
       FROM events WHERE value >= 5 GROUP BY 1, 2""",
)
def s12(t):
    """Readings below five are sent without a value and must be dropped."""
    entry = F.struct(
        F.col("user_id").cast("string").alias("Paikka_Id"),
        utc_iso(F.date_trunc("day", "ts")).alias("Aika"),
        F.when(F.col("value") >= 5, F.col("value").cast("string")).alias("Arvo"),
    )
    docs = t.events.select("event_id", F.to_json(F.struct(F.array(entry).alias("value"))).alias("payload"))
    return feeds.decode_hydrology(docs, "event_id").drop("event_id")


HOLIDAYS = """days AS (
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(day(o_orderdate) % 3 AS INTEGER) AS kind_id
    FROM orders WHERE o_orderkey % 200 = 0)"""


def holiday_days(t):
    """The days of every two-hundredth order stand for the holidays."""
    big = t.orders.where("o_orderkey % 200 = 0").select(F.to_date("o_orderdate").alias("date")).distinct()
    return big.withColumn("kind_id", (F.dayofmonth("date") % 3).cast("int"))


@query(
    "s13_holiday_hours",
    with_sql(
        f"""SELECT ts, CAST(max(kind_id) AS BIGINT) AS holiday FROM (
              SELECT kind_id, unnest(generate_series(
                  timezone('UTC', timezone('{TZ}', CAST(date AS TIMESTAMP))),
                  timezone('UTC', timezone('{TZ}', CAST(date AS TIMESTAMP) + INTERVAL 1 DAY)) - INTERVAL 1 HOUR,
                  INTERVAL 1 HOUR)) AS ts FROM days) GROUP BY 1""",
        HOLIDAYS,
    ),
)
def s13(t):
    """True local days: 23 or 25 hours at the clock changes."""
    return feeds.holiday_hours(holiday_days(t), TZ)


@query(
    "s13_holiday_hours_24h",
    with_sql(
        f"""SELECT ts, CAST(max(kind_id) AS BIGINT) AS holiday FROM (
              SELECT kind_id, unnest(generate_series(
                  timezone('UTC', timezone('{TZ}', CAST(date AS TIMESTAMP))),
                  timezone('UTC', timezone('{TZ}', CAST(date AS TIMESTAMP))) + INTERVAL 23 HOUR,
                  INTERVAL 1 HOUR)) AS ts FROM days) GROUP BY 1""",
        HOLIDAYS,
    ),
)
def s13_legacy(t):
    """24 elapsed hours from local midnight, whatever the clock does."""
    return feeds.holiday_hours(holiday_days(t), TZ, legacy_24h=True)


OUTAGES = """outages AS (
    SELECT event_id, ts AS start, ts + to_hours(1 + CAST(user_id AS BIGINT) % 48) AS "end",
           value AS avail_qty, 890.0 AS nominal_power, event_type
    FROM events WHERE event_type IN ('error', 'signup'))"""


def outage_frames(t):
    """Errors and signups as two outage lists; clicks and views carry statuses and
    resolutions the cleaning must refuse, and small values are no numbers."""
    e = t.events.select(
        "event_id",
        F.col("ts").alias("start"),
        F.timestamp_micros(F.unix_micros("ts") + (1 + F.col("user_id") % 48) * 3_600_000_000).alias("end"),
        F.col("value").cast("string").alias("avail_qty"),
        F.lit("890").alias("nominal_power"),
        "event_type",
        F.lit("Nuclear").alias("plant_type"),
        F.when(F.col("event_type") == "error", "Unplanned outage").otherwise("Planned maintenance").alias("businesstype"),
        F.when(F.col("event_type") == "click", "Cancelled").alias("docstatus"),
        F.when(F.col("event_type") == "view", "PT15M").otherwise("PT60M").alias("resolution"),
    )
    return e.where("event_type IN ('error', 'click')"), e.where("event_type IN ('signup', 'view')")


def outages(t):
    return feeds.clean_outages(*outage_frames(t)).select(
        "event_id", "start", "end", "avail_qty", "nominal_power", "event_type"
    )


@query("s14_outage_cleaning", with_sql('SELECT event_id, start, "end", avail_qty, CAST(nominal_power AS DOUBLE) AS nominal_power, event_type FROM outages', OUTAGES))
def s14(t):
    return outages(t)


INTERP = """known AS (
    SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS t0, last_value(value IGNORE NULLS) OVER p AS v0,
           first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER n AS t1, first_value(value IGNORE NULLS) OVER n AS v1
    FROM {src} WINDOW p AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      n AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  lerped AS (
    SELECT series_id, ts, CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0
           ELSE v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / (epoch(t1) - epoch(t0)) END AS value FROM known)"""


@query("s15_station_csv", with_sql("SELECT series_id, ts, round(value, 6) AS value FROM lerped", HOURLY_RAW, GRID, INTERP.format(src="gapped")))
def s15(t):
    """One CSV folder per event type is written and read back; the station is the folder's
    files' name part, so the decoded rows carry it themselves."""
    path = scratch_path(t.spark, "station-csv")
    t.events.select("event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), "value").write.partitionBy(
        "event_type"
    ).csv(path, header=True)
    raw = t.spark.read.csv(path, header=True, schema="time string, value double, event_type string")
    rows = raw.select(F.col("event_type").alias("series_id"), feeds.parse_utc("time").alias("ts"), "value")
    return feeds.history_hourly(rows)


@query("s15_station_files", with_sql("SELECT series_id, ts, round(value, 6) AS value FROM lerped", HOURLY_RAW, GRID, INTERP.format(src="gapped")))
def s15_files(t):
    """A file per event type; the station is the name of the file."""
    path = scratch_path(t.spark, "station-files")
    rows = t.events.select("event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.col("value").cast("string").alias("value"))
    publish.write_named_csv(rows, path, "event_type")
    return feeds.read_station_csv(t.spark, f"{path}/*.csv", "time string, value string", "value")


@query(
    "s16_delimited_history",
    with_sql(
        "SELECT event_id, date_trunc('second', ts) AS ts, value FROM events WHERE value >= 2",
    ),
)
def s16(t):
    """Semicolon lines; values below two are no numbers and drop out."""
    line = F.concat_ws(
        ";", utc_iso(F.date_trunc("second", "ts")), F.when(F.col("value") < 2, F.lit("-")).otherwise(F.col("value").cast("string"))
    )
    return feeds.decode_delimited(t.events.select("event_id", line.alias("payload")))


@query(
    "s17_assembled_history",
    with_sql(
        """SELECT l.series_id, l.ts, round(l.value, 6) AS value, m.missing FROM lerped l
           JOIN (SELECT series_id, count(*) FILTER (WHERE value IS NULL) AS missing FROM gapped GROUP BY 1) m USING (series_id)""",
        HOURLY_RAW,
        GRID,
        INTERP.format(src="gapped"),
    ),
)
def s17(t):
    rows = t.events.select(F.col("event_type").alias("series_id"), "ts", "value")
    return feeds.assemble_history(rows, digits=9)


@query("s17_too_many_missing", with_sql("SELECT series_id, count(*) FILTER (WHERE value IS NULL) AS missing FROM gapped GROUP BY 1 HAVING count(*) FILTER (WHERE value IS NULL) > 24", HOURLY, GRID))
def s17_check(t):
    from ..operators.spine import complete_grid

    return too_many_missing(complete_grid(hourly(t), "series_id"), "value", "series_id")


@query("s18_pair_arrays", "SELECT event_id, date_trunc('millisecond', ts) AS ts, CASE WHEN value >= 3 THEN value END AS value FROM events")
def s18(t):
    pair = F.array(F.unix_millis("ts").cast("double"), F.when(F.col("value") >= 3, F.col("value")))
    return feeds.decode_pairs(t.events.select("event_id", F.to_json(F.array(pair)).alias("payload")))


@query("s19_price_csv", with_sql("SELECT series_id, ts, value FROM hourly", HOURLY))
def s19(t):
    """Written with a header and read back, malformed lines dropped."""
    path = scratch_path(t.spark, "price-csv")
    out = hourly(t).select("series_id", utc_iso("ts").alias("time"), "value")
    out.write.csv(path, header=True)
    rows = feeds.read_delimited(t.spark, path, "series_id string, time string, value double", sep=",")
    return rows.select("series_id", feeds.parse_utc("time").alias("ts"), "value").where("value IS NOT NULL")


@query("s20_table_csv", with_sql("SELECT series_id, source, ts, value FROM daily", DAILY))
def s20(t):
    path = scratch_path(t.spark, "table-csv")
    d = daily(t)
    d.write.csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss'Z'")
    return read_csv_table(t.spark, path, "series_id string, source string, ts timestamp, value double")


@query(
    "s21_chunked_history",
    """SELECT event_type AS series_id, ts, min(value) AS value FROM (
         SELECT event_type, date_trunc('hour', ts) AS ts, first_value(value) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS value
         FROM events WHERE date_trunc('hour', ts) BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25') GROUP BY 1, 2""",
)
def s21(t):
    """Every event is a landed row of some chunk; the first one per hour is kept."""
    chunks = t.events.select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"), "event_id", "value")
    return feeds.assemble_chunks(chunks, ["series_id", "ts"], "event_id", "2024-01-03 00:00:00", "2024-01-25 00:00:00").drop("event_id")


@query(
    "j13_spine",
    with_sql(
        """SELECT s.series_id, r.ts FROM (SELECT DISTINCT series_id FROM ship) s
           CROSS JOIN (SELECT unnest(generate_series((SELECT min(ts) FROM ship), (SELECT max(ts) FROM ship), INTERVAL 1 HOUR)) AS ts) r""",
        SHIP,
    ),
)
def j13_spine(t):
    s = ship(t)
    return spine(s.select("series_id").distinct(), "series_id", s.agg(F.min("ts")).scalar(), s.agg(F.max("ts")).scalar())
