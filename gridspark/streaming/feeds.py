"""Streaming forms of the feed polls: late readings by watermark instead of re-reading."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.buckets import as_list
from ..operators.fill import forward_fill
from ..sinks.store import _exists, upsert
from ..sinks.versions import VersionedTable


def hourly_mean_stream(stream: DataFrame, series, *, ts: str = "ts", value: str = "value", delay: str = "2 hours") -> DataFrame:
    """Hourly mean per series, emitted once the watermark has passed the hour."""
    hour = F.window(ts, "1 hour")
    out = stream.withWatermark(ts, delay).groupBy(*as_list(series), hour.alias("_w")).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return out.select(*as_list(series), F.col("_w.start").alias(ts), value, "n")


def sliding_mean_stream(stream: DataFrame, series, *, ts: str = "ts", value: str = "value", length: str = "24 hours", slide: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Trailing mean every `slide`."""
    w = F.window(ts, length, slide)
    out = stream.withWatermark(ts, delay).groupBy(*as_list(series), w.alias("_w")).agg(F.avg(value).alias(value))
    return out.select(*as_list(series), F.col("_w.end").alias("window_end"), value)


def dedup_stream(stream: DataFrame, keys: str | Sequence[str], *, ts: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Exact repeats from overlapping polls dropped.  Revised values belong in an upsert."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(as_list(keys))


def episode_stream(stream: DataFrame, series, *, ts: str = "ts", gap: str = "3 hours", delay: str = "2 hours") -> DataFrame:
    """Episodes of rows at most `gap` apart.

    Spark merges a task's rows of one session before they are shuffled
    (`spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`, set here), so what
    reaches the one state key of a series is a few partial sessions per task, not its rows.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    s = F.session_window(ts, gap)
    out = stream.withWatermark(ts, delay).groupBy(*as_list(series), s.alias("_s")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"))
    return out.select(*as_list(series), F.col("_s.start").alias("episode_start"), "last_ts", "n")


def write_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_upsert(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str, *, ts: str = "ts") -> StreamingQuery:
    """Each micro-batch is a null-skipping upsert.  A repeated batch finds its values
    already in place, so replays change nothing."""

    def apply(batch: DataFrame, _batch_id: int) -> None:
        upsert(batch.sparkSession, path, batch, keys, ts=ts, order=order)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_versions(stream: DataFrame, table: VersionedTable, checkpoint: str, keys: Sequence[str], order: str, *, name: str = "stream", ts: str = "ts", null_policy: str = "skip") -> StreamingQuery:
    """Each micro-batch is one version of the table, all of it or none; a version knows the
    batches that it holds, so a replayed one is passed over."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        VersionedTable(batch.sparkSession, table.root).upsert(batch, keys, ts=ts, order=order, null_policy=null_policy, stream=name, batch_id=batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def carried_stream(stream: DataFrame, series, *, ts: str = "ts", value: str = "value", delay: str = "2 hours") -> DataFrame:
    """Rows with their missing values carried forward, whatever order they come in.

    A series' state is its last known value and the rows that the watermark has not passed;
    a timer sends them on, in the order of time, as soon as it has.  Rows that come when later
    times of their series have been sent on are dropped; none is that keeps to `delay`.  The state of a series holds the rows of that delay, so it belongs to
    feeds of a bounded rate; of several rows at one time those with the smaller value come first,
    missing ones before all.
    """
    keys = as_list(series)
    typed = stream.withWatermark(ts, delay).select(*keys, ts, F.col(value).cast("double").alias(value))
    fields = {f.name: f.dataType.simpleString() for f in typed.schema.fields}

    def advance(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sent, times, values = state.get if state.exists else (None, None, [], [])
        rows = [(int(t), v) for t, v in zip(times, values)]
        if not state.hasTimedOut:
            for part in parts:
                micros = part[ts].astype("datetime64[us]").astype("int64")
                rows += [(int(t), None if pd.isna(v) else float(v)) for t, v in zip(micros, part[value]) if sent is None or t >= sent]
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        mark = state.getCurrentWatermarkMs() * 1000
        due = [r for r in rows if r[0] < mark]
        rows = rows[len(due) :]
        out = []
        for t, v in due:
            last = v if v is not None else last
            out.append((*key, pd.Timestamp(t, unit="us"), last))
        state.update((last, mark if out else sent, [t for t, _ in rows], [v for _, v in rows]))
        if rows:
            state.setTimeoutTimestamp(max(rows[0][0] // 1000, mark // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=[*keys, ts, value])

    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*keys, ts, value])
    return typed.groupBy(*keys).applyInPandasWithState(advance, schema, "last double, sent long, times array<long>, values array<double>", "append", GroupStateTimeout.EventTimeTimeout)


HOUR_MS = 3_600_000


def missing_hours_stream(stream: DataFrame, series, *, ts: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Episodes of hours without a row: series, event ('open' or 'closed'), gap_start, hours.

    A timer fires when the watermark has passed an hour in which no row came: that opens an
    episode (hours is null).  The next hour with a row closes it.  A series begins with its first
    hour.  Tasks first reduce their rows to hours; the state of a series holds the hours that the
    watermark has not passed.
    """
    keys = as_list(series)
    hours = stream.select(*keys, F.date_trunc("hour", ts).alias(ts))
    names = hours.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hours.schema.fields)

    def distinct(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.drop_duplicates()

    hours = hours.mapInPandas(distinct, types).withWatermark(ts, delay)

    def advance(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, opened, waiting = state.get if state.exists else (None, False, [])
        seen = set(waiting)
        if not state.hasTimedOut:
            for part in parts:
                seen |= set((part[ts].astype("datetime64[us]").astype("int64") // 1000).tolist())
        mark, out = state.getCurrentWatermarkMs(), []

        def emit(event: str, count: int | None) -> None:
            out.append((*key, event, pd.Timestamp(expected, unit="ms"), count))

        for hour in sorted(seen):
            if hour + HOUR_MS > mark:
                break
            seen.discard(hour)
            if expected is not None and hour > expected:
                if not opened:
                    emit("open", None)
                emit("closed", (hour - expected) // HOUR_MS)
            if expected is None or hour >= expected:
                expected, opened = hour + HOUR_MS, False
        if expected is not None and not opened and expected + HOUR_MS <= mark:
            emit("open", None)
            opened = True
        state.update((expected, opened, sorted(seen)))
        due = [min(seen) + HOUR_MS] if seen else []
        if expected is not None and not opened:
            due.append(expected + HOUR_MS)
        if due:
            state.setTimeoutTimestamp(max(min(due) - 1, mark + 1))
        if out:
            frame = pd.DataFrame(out, columns=[*keys, "event", "gap_start", "hours"])
            yield frame.astype({"hours": "Int64"})

    schema = ", ".join([types.rsplit(", ", 1)[0], "event string", "gap_start timestamp", "hours long"])
    return hours.groupBy(*names[:-1]).applyInPandasWithState(advance, schema, "expected long, opened boolean, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def write_carried(
    stream: DataFrame, path: str, checkpoint: str, series, *, ts: str = "ts", value: str = "value", bucket: str = "1 day"
) -> StreamingQuery:
    """Rows with their missing values carried forward across micro-batches.

    The last known value per series is kept as one small folder per batch; a batch starts
    from its predecessor's, so a replayed batch reads and writes the same folders.  Batches
    are expected in time order; within a batch the bucketed fill does the work, in buckets
    narrow enough for raw readings.
    """
    keys = as_list(series)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.select(*keys, ts, value).withColumn("_new", F.lit(True))
        seed = None
        if batch_id > 0 and _exists(spark, f"{path}/state/batch={batch_id - 1}"):
            seed = spark.read.parquet(f"{path}/state/batch={batch_id - 1}")
            # Series reach the batch at times of their own: every seed stays, just before its time.
            known = seed.withColumns({ts: F.col(ts) - F.expr("INTERVAL 1 MICROSECOND"), "_new": F.lit(False)})
            rows = rows.unionByName(known.select(*rows.columns))
        filled = forward_fill(rows, value, keys, ts, bucket=bucket).where("_new").drop("_new")
        filled.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        known = batch.where(F.col(value).isNotNull()).select(*keys, ts, value)
        known = known if seed is None else known.unionByName(seed.select(*keys, ts, value))
        state = known.groupBy(*keys).agg(F.max(ts).alias("_t"), F.max_by(value, ts).alias(value)).withColumnRenamed("_t", ts)
        state.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

