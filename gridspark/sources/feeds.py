"""Decoding of recorded feed documents into long facts.

Every decoder takes a DataFrame with a text column `payload` (one document per row) plus
any columns that identify the document, and returns typed rows.  `read_documents` makes
that frame from files; documents may as well sit in a table column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import EUR_MWH_TO_CKWH, finite, number
from ..functions.time import parse_utc
from ..operators.buckets import salted_join
from ..operators.fill import forward_fill
from ..operators.patch import dedup, union_all
from ..operators.rollup import hourly_mean
from ..operators.spine import densify, spine


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its text and its name without folder and extension."""
    raw = spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return raw.withColumn("document", stem)


def _ids(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "payload"]


def decode_prices(docs: DataFrame) -> DataFrame:
    """{"prices": [{date, value}]}; the price unit becomes c/kWh."""
    schema = "prices array<struct<date string, value double>>"
    rows = docs.withColumn("_d", F.from_json("payload", schema)).select(*_ids(docs), F.inline("_d.prices"))
    return rows.select(
        *_ids(docs),
        parse_utc("date").alias("ts"),
        (finite("value") * F.lit(EUR_MWH_TO_CKWH)).alias("price"),
    ).where("ts IS NOT NULL")


def decode_grid_feed(docs: DataFrame) -> DataFrame:
    """{"data": [{datasetId, startTime, endTime, value}]}; times as epoch ms or ISO text."""
    schema = "data array<struct<datasetId string, startTime string, endTime string, value string>>"
    rows = docs.withColumn("_d", F.from_json("payload", schema)).select(*_ids(docs), F.inline("_d.data"))
    return rows.select(
        *_ids(docs),
        F.col("datasetId").alias("series_id"),
        parse_utc("startTime").alias("ts"),
        parse_utc("endTime").alias("end_ts"),
        number("value").alias("value"),
    ).where("ts IS NOT NULL")


# Border columns of the flow feed and the names used for them.
BORDERS = {"border_SE1_FI": "SE1_FI", "border_SE3_FI": "SE3_FI", "border_EE_FI": "EE_FI"}


def decode_border_flows(docs: DataFrame, order: str | None = None) -> DataFrame:
    """{"data": [{dateTimeUtc, border_*}]} to (ts, border, value); the latest document
    wins where fetch windows overlap, by the column `order`."""
    fields = ", ".join(f"{c} string" for c in BORDERS)
    schema = f"data array<struct<dateTimeUtc string, {fields}>>"
    ids = _ids(docs)
    rows = docs.withColumn("_d", F.from_json("payload", schema)).select(*ids, F.inline("_d.data"))
    typed = rows.select(*ids, parse_utc("dateTimeUtc").alias("ts"), *[number(c).alias(n) for c, n in BORDERS.items()])
    long = typed.unpivot([*ids, "ts"], list(BORDERS.values()), "border", "value")
    long = long.where("value IS NOT NULL AND ts IS NOT NULL")
    if order:
        long = dedup(long, ["ts", "border"], order, keep="last")
    return long


def carried_capacity(rows: DataFrame, start, end) -> DataFrame:
    """Older capacity feed: every dataset carried forward over the hourly range."""
    grid = spine(rows.select("series_id").distinct(), "series_id", start, end)
    return forward_fill(grid.join(rows, ["series_id", "ts"], "left"), "value", "series_id")


def decode_arrays(docs: DataFrame, variable: str, *, clip_negative: bool = False) -> DataFrame:
    """{"hourly": {"time": [], "<variable>": []}}: parallel arrays to (ts, value)."""
    schema = f"hourly struct<time: array<string>, `{variable}`: array<double>>"
    zipped = F.arrays_zip(F.col("_d.hourly.time").alias("time"), F.col(f"_d.hourly.`{variable}`").alias("v"))
    rows = docs.withColumn("_d", F.from_json("payload", schema)).select(*_ids(docs), F.inline(zipped))
    value = finite("v")
    if clip_negative:
        # greatest() skips nulls, so a missing reading must stay missing.
        value = F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))
    return rows.select(*_ids(docs), parse_utc("time").alias("ts"), value.alias("value")).where("ts IS NOT NULL")


XML_ROW_TAG = "BsWfs:BsWfsElement"


def read_station_xml(spark: SparkSession, path: str, station_pattern: str = r"(\d+)") -> DataFrame:
    """Element lists from files; the station id is the first number in the file name."""
    schema = "`BsWfs:Time` string, `BsWfs:ParameterName` string, `BsWfs:ParameterValue` string"
    raw = spark.read.format("xml").option("rowTag", XML_ROW_TAG).schema(schema).load(path)
    station = F.regexp_extract(F.col("_metadata.file_name"), station_pattern, 1)
    return raw.select(
        station.alias("station"),
        parse_utc("BsWfs:Time").alias("ts"),
        F.col("BsWfs:ParameterName").alias("parameter"),
        number("BsWfs:ParameterValue").alias("value"),
    )


def decode_station_xml(docs: DataFrame) -> DataFrame:
    """The same elements from documents held in a column."""
    schema = "`BsWfs:Time` string, `BsWfs:ParameterName` string, `BsWfs:ParameterValue` string"
    one = F.from_xml("payload", schema, {"rowTag": XML_ROW_TAG})
    rows = docs.withColumn("_e", one)
    return rows.select(
        *_ids(docs),
        parse_utc(F.col("_e.`BsWfs:Time`")).alias("ts"),
        F.col("_e.`BsWfs:ParameterName`").alias("parameter"),
        number(F.col("_e.`BsWfs:ParameterValue`")).alias("value"),
    )


def decode_station_documents(docs: DataFrame) -> DataFrame:
    """All elements of each document held in a column: a collection of members with one element
    each.  Documents that are no XML, and members without an element, have no rows."""
    element = "`BsWfs:Time` string, `BsWfs:ParameterName` string, `BsWfs:ParameterValue` string"
    schema = f"`wfs:member` array<struct<`{XML_ROW_TAG}` struct<{element.replace('` string', '`: string')}>>>"
    parsed = docs.withColumn("_d", F.from_xml("payload", schema, {"mode": "PERMISSIVE"}))
    rows = parsed.select(*_ids(docs), F.explode("_d.`wfs:member`").alias("_m")).select(*_ids(docs), F.col(f"_m.`{XML_ROW_TAG}`").alias("_e"))
    return rows.where("_e IS NOT NULL").select(
        *_ids(docs),
        parse_utc(F.col("_e.`BsWfs:Time`")).alias("ts"),
        F.col("_e.`BsWfs:ParameterName`").alias("parameter"),
        number(F.col("_e.`BsWfs:ParameterValue`")).alias("value"),
    )


def station_wide(rows: DataFrame, parameters: Sequence[str], station: str = "station") -> DataFrame:
    """One column per parameter; a repeated (station, ts, parameter) is reported in
    `repeats`, so a check can refuse it."""
    return (
        rows.groupBy(station, "ts")
        .pivot("parameter", list(parameters))
        .agg(F.first("value", ignorenulls=True).alias("value"), F.count(F.lit(1)).alias("n"))
        .select(
            station,
            "ts",
            *[F.col(f"{p}_value").alias(p) for p in parameters],
            F.greatest(*[F.coalesce(F.col(f"{p}_n"), F.lit(0)) for p in parameters], F.lit(0)).alias("repeats"),
        )
    )


def decode_hydrology(docs: DataFrame, order: str | None = None) -> DataFrame:
    """{"value": [{Paikka_Id, Aika, Arvo}]}: incomplete rows dropped, the last one per
    place and time kept (by `order`, else by the other columns, else the largest)."""
    schema = "value array<struct<Paikka_Id string, Aika string, Arvo string>>"
    ids = _ids(docs)
    rows = docs.withColumn("_d", F.from_json("payload", schema)).select(*ids, F.inline("_d.value"))
    typed = rows.select(
        *ids,
        F.col("Paikka_Id").try_cast("int").alias("place"),
        parse_utc("Aika").alias("ts"),
        number("Arvo").alias("value"),
    ).dropna("any", subset=["place", "ts", "value"])
    return dedup(typed, ["place", "ts"], order or ids or ["value"], keep="last")


def holiday_hours(days: DataFrame, tz: str, *, legacy_24h: bool = False) -> DataFrame:
    """(date, kind_id) to one row per UTC hour of the local day, highest kind per hour.

    True local days have 23 or 25 hours at the clock changes; `legacy_24h` counts 24
    elapsed hours from local midnight instead.
    """
    begin = F.to_utc_timestamp(F.col("date").cast("timestamp"), tz)
    if legacy_24h:
        last = begin + F.expr("INTERVAL 23 HOURS")
    else:
        last = F.to_utc_timestamp(F.date_add("date", 1).cast("timestamp"), tz) - F.expr("INTERVAL 1 HOUR")
    hours = days.withColumn("ts", F.explode(F.sequence(begin, last, F.expr("INTERVAL 1 HOUR"))))
    return hours.groupBy("ts").agg(F.coalesce(F.max("kind_id"), F.lit(0)).cast("int").alias("holiday"))


# Outage record filters.
OUTAGE_PLANT = "Nuclear"
OUTAGE_TYPES = ("Planned maintenance", "Unplanned outage")
OUTAGE_CANCELLED = "Cancelled"
OUTAGE_RESOLUTION = "PT60M"


def clean_outages(*frames: DataFrame) -> DataFrame:
    """Outage lists as one: wanted plant, type and resolution, not cancelled, numeric."""
    rows = union_all(*frames)
    return rows.where(
        (F.col("plant_type") == OUTAGE_PLANT)
        & F.col("businesstype").isin(*OUTAGE_TYPES)
        & (F.coalesce(F.col("docstatus"), F.lit("")) != OUTAGE_CANCELLED)
        & (F.col("resolution") == OUTAGE_RESOLUTION)
    ).withColumns({"avail_qty": number("avail_qty"), "nominal_power": number("nominal_power")})


def open_outages(df: DataFrame, now, end: str = "end") -> DataFrame:
    return df.where(F.col(end) > (now if not isinstance(now, str) else F.lit(now).cast("timestamp")))


def read_station_csv(spark: SparkSession, path: str, schema: str, value: str, time: str = "time") -> DataFrame:
    """One CSV per station, station id from the file name; hourly means, gaps interpolated."""
    raw = spark.read.csv(path, header=True, schema=schema)
    station = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1)
    typed = raw.select(station.alias("series_id"), parse_utc(time).alias("ts"), number(value).alias("value"))
    return history_hourly(typed.where("ts IS NOT NULL"))


def history_hourly(rows: DataFrame, series: str = "series_id") -> DataFrame:
    """Resample to hourly means and interpolate the gaps linearly."""
    return densify(hourly_mean(rows, series), "value", series)


def read_delimited(spark: SparkSession, path: str, schema: str, *, sep: str = ";", header: bool = True) -> DataFrame:
    return spark.read.csv(path, header=header, schema=schema, sep=sep, mode="DROPMALFORMED")


def decode_delimited(docs: DataFrame, *, sep: str = ";", fields: Sequence[str] = ("time", "value")) -> DataFrame:
    """Delimited lines held in a column: time and value, bad values dropped."""
    schema = ", ".join(f"{f} string" for f in fields)
    rows = docs.withColumn("_r", F.from_csv("payload", schema, {"sep": sep}))
    return rows.select(
        *_ids(docs), parse_utc(F.col(f"_r.{fields[0]}")).alias("ts"), number(F.col(f"_r.{fields[1]}")).alias("value")
    ).where("ts IS NOT NULL AND value IS NOT NULL")


def decode_pairs(docs: DataFrame) -> DataFrame:
    """[[epoch ms, value], …] to (ts, value); a null value stays null."""
    rows = docs.withColumn("_p", F.explode(F.from_json("payload", "array<array<double>>")))
    return rows.select(
        *_ids(docs),
        F.timestamp_millis(F.col("_p")[0].cast("bigint")).alias("ts"),
        finite(F.get("_p", F.lit(1))).alias("value"),
    )


def assemble_chunks(chunks: DataFrame, keys: Sequence[str], order: str, start, end, ts: str = "ts") -> DataFrame:
    """All landed chunks of a history fetch, clipped to the wanted range, first one kept
    on equal keys."""
    inside = chunks.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return dedup(inside, keys, order, keep="first")


def assemble_history(rows: DataFrame, series: str = "series_id", digits: int = 0) -> DataFrame:
    """Bad values dropped, hourly mean, time interpolation, rounding; `missing` holds the
    series' number of missing hours, so a check can refuse more than a day."""
    hours = hourly_mean(rows.where("value IS NOT NULL"), series)
    span = (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 3600 + 1
    gaps = hours.groupBy(series).agg((span - F.count(F.lit(1))).cast("long").alias("missing"))
    filled = densify(hours, "value", series).withColumn("value", F.round("value", digits))
    return salted_join(filled, gaps, series)

