"""Versions of a table: all of a batch or nothing, several writers, keyed state of streams."""

import os
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridspark.sinks.archive import Archive
from gridspark.sinks.versions import VersionedTable, _take, claim_number
from gridspark.streaming import feeds as st

DAY = datetime(2026, 1, 1)
SCHEMA = "series_id string, ts timestamp, a double, b double"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"{tmp_path}/table")


def rows(spark, items, schema=SCHEMA):
    return spark.createDataFrame([(s, DAY + timedelta(hours=h), *v) for s, h, *v in items], schema)


def content(df):
    return sorted((r.series_id, int((r.ts - DAY).total_seconds() // 3600), r.a, r.b) for r in df.collect())


def test_versions_and_nulls(spark, table):
    assert table.read() is None and table.version().number == 0
    got = table.upsert(rows(spark, [("x", 0, 1.0, None), ("x", 30, 2.0, 2.0)]), ["series_id", "ts"])
    assert (got.inserted, got.updated) == (2, 0)
    got = table.upsert(rows(spark, [("x", 0, None, 5.0), ("y", 1, 3.0, None)]), ["series_id", "ts"])
    assert (got.inserted, got.updated) == (1, 1)
    assert content(table.read()) == [("x", 0, 1.0, 5.0), ("x", 30, 2.0, 2.0), ("y", 1, 3.0, None)]
    assert content(table.read(1)) == [("x", 0, 1.0, None), ("x", 30, 2.0, 2.0)]
    one, two = table.version(1), table.version(2)
    assert two.parent == 1 and one.dates["2026-01-02"] == two.dates["2026-01-02"] and one.dates["2026-01-01"] != two.dates["2026-01-01"]
    table.upsert(rows(spark, [("z", 2, 1.0, None, 7.0)], SCHEMA + ", c double"), ["series_id", "ts"])
    assert {(r.series_id, r.c) for r in table.read().select("series_id", "c").collect()} == {("x", None), ("y", None), ("z", 7.0)}
    assert table.upsert(rows(spark, []), ["series_id", "ts"]).inserted == 0 and table.version().number == 3
    with pytest.raises(ValueError):
        table.upsert(rows(spark, [("x", 0, 1.0, 1.0)]), "series_id")
    with pytest.raises(ValueError):
        table.version(9)


def test_two_writers_lose_nothing(spark, table):
    """All writers start from the same version; dates in common are merged again, others taken over."""
    table.upsert(rows(spark, [("x", 0, 0.0, 0.0)]), ["series_id", "ts"])
    start, failures = threading.Barrier(4), []

    def write(n):
        try:
            start.wait()
            for k in range(2):
                mine = [(f"w{n}", 2 * k, 1.0 * n, None), ("x", 0, None, None) if n % 2 else ("x", 24 * n, 1.0, None)]
                VersionedTable(spark, table.root).upsert(rows(spark, mine), ["series_id", "ts"])
        except Exception as error:  # noqa: BLE001
            failures.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    want = [("x", 0, 0.0, 0.0), ("x", 48, 1.0, None), ("x", 96, 1.0, None)]
    want += [(f"w{n}", 2 * k, 1.0 * n, None) for n in range(1, 5) for k in range(2)]
    assert content(table.read()) == sorted(want) and table.version().number == 9


def test_a_crash_before_the_manifest_changes_nothing(spark, table, monkeypatch):
    table.upsert(rows(spark, [("x", 0, 1.0, 1.0), ("x", 24, 1.0, 1.0)]), ["series_id", "ts"])

    def crash(self, made):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", crash)
        with pytest.raises(RuntimeError):
            table.upsert(rows(spark, [("x", 0, 2.0, 2.0), ("x", 24, 2.0, 2.0)]), ["series_id", "ts"])
    assert content(table.read()) == [("x", 0, 1.0, 1.0), ("x", 24, 1.0, 1.0)] and table.version().number == 1
    table.upsert(rows(spark, [("x", 24, 3.0, None)]), ["series_id", "ts"])
    assert content(table.read()) == [("x", 0, 1.0, 1.0), ("x", 24, 3.0, 1.0)]


def test_what_a_writer_left_aside_is_passed_over(spark, table):
    table.upsert(rows(spark, [("x", 0, 1.0, 1.0)]), ["series_id", "ts"])
    os.makedirs(f"{table.root}/versions/_cut")
    with open(f"{table.root}/versions/_cut/text", "w") as f:
        f.write('_cut\n{"dates": {"2026-01-01": "no')
    assert table.version().number == 1 and content(table.read()) == [("x", 0, 1.0, 1.0)]
    table.upsert(rows(spark, [("y", 0, 2.0, 2.0)]), ["series_id", "ts"])
    assert (table.version().number, table.version().parent) == (2, 1) and len(content(table.read())) == 2
    assert not _take(spark, f"{table.root}/versions", f"{2:012d}", "other") and table.version().parent == 1


def test_a_replayed_batch_is_passed_over(spark, table):
    keys = ["series_id", "ts"]
    table.upsert(rows(spark, [("x", 0, 1.0, 1.0)]), keys, stream="s", batch_id=0)
    table.upsert(rows(spark, [("x", 0, None, 2.0)]), keys, null_policy="overwrite", stream="s", batch_id=1)
    table.upsert(rows(spark, [("x", 0, 1.0, 1.0)]), keys, null_policy="overwrite", stream="s", batch_id=0)
    assert content(table.read()) == [("x", 0, None, 2.0)] and table.version().batches == {"s": 1}
    table.upsert(rows(spark, [("x", 0, 9.0, 9.0)]), keys, stream="t", batch_id=0)
    assert content(table.read()) == [("x", 0, 9.0, 9.0)] and table.version().batches == {"s": 1, "t": 0}


def test_numbers_and_runs_are_given_once(spark, tmp_path):
    got, start = [], threading.Barrier(4)

    def take():
        start.wait()
        got.extend(claim_number(spark, f"{tmp_path}/claims", 3) for _ in range(5))

    threads = [threading.Thread(target=take) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(3, 23))
    frame = spark.createDataFrame([(DAY, 1.0)], "ts timestamp, predicted double")
    ids, start = [], threading.Barrier(2)

    def snapshot():
        archive = Archive(spark, f"{tmp_path}/archive")
        start.wait()
        ids.append(archive.insert_snapshot(frame, DAY))

    threads = [threading.Thread(target=snapshot) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(ids)) == 2 and Archive(spark, f"{tmp_path}/archive").predictions().count() == 2


def streamed(spark, tmp_path, batches, schema):
    """One file, and one micro-batch, for each of `batches`, in this order."""
    folder = f"{tmp_path}/landing"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/part={k}")
        for name in os.listdir(f"{folder}/part={k}"):
            os.utime(f"{folder}/part={k}/{name}", (time.time() - 1000 + k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).select(*[c.split()[0] for c in schema.split(", ")])


def finish(spark, tmp_path, stream):
    st.write_append(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")


def test_carry_does_not_depend_on_the_order_of_batches(spark, tmp_path):
    at = lambda h: DAY + timedelta(hours=h)
    batches = [
        [("x", at(3), None), ("x", at(1), 1.0), ("y", at(2), None)],
        [("x", at(0), 5.0), ("x", at(2), None), ("y", at(1), 8.0)],
        [("x", at(4), 4.0), ("x", at(1.5), None), ("x", at(5), None)],
        [("x", at(30), None), ("y", at(30), 2.0)],
        [("z", at(31), 0.5)],
        [("x", at(6), 9.0), ("x", at(29), None)],  # the first comes too late and is dropped
        [("z", at(60), 0.0)],
    ]
    got = finish(spark, tmp_path, st.carried_stream(streamed(spark, tmp_path, batches, "series_id string, ts timestamp, value double"), "series_id", delay="10 hours"))
    hours = sorted((r.series_id, (r.ts - DAY).total_seconds() / 3600, r.value) for r in got.collect())
    assert hours == [
        ("x", 0, 5.0), ("x", 1, 1.0), ("x", 1.5, 1.0), ("x", 2, 1.0), ("x", 3, 1.0), ("x", 4, 4.0), ("x", 5, 4.0), ("x", 29, 4.0), ("x", 30, 4.0),
        ("y", 1, 8.0), ("y", 2, 8.0), ("y", 30, 2.0), ("z", 31, 0.5),
    ]


def test_timers_tell_of_hours_without_rows(spark, tmp_path):
    at = lambda h: DAY + timedelta(hours=h, minutes=10)
    batches = [
        [("x", at(0)), ("x", at(0)), ("y", at(0)), ("x", at(2))],
        [("x", at(1)), ("y", at(1)), ("x", at(3))],
        [("x", at(9)), ("y", at(12))],
        [("z", at(20))],
        [("x", at(21))],
    ]
    got = finish(spark, tmp_path, st.missing_hours_stream(streamed(spark, tmp_path, batches, "series_id string, ts timestamp"), "series_id", delay="3 hours"))
    hours = sorted((r.series_id, r.event, int((r.gap_start - DAY).total_seconds() // 3600), r.hours) for r in got.collect())
    # The watermark ends at 18 h: z has no hour that it has passed.
    assert hours == [("x", "closed", 4, 5), ("x", "open", 4, None), ("x", "open", 10, None), ("y", "closed", 2, 10), ("y", "open", 2, None), ("y", "open", 13, None)]
