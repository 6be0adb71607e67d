"""Repeated keys, seeds of slow series, exact samples and workers without the package."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gridspark.operators import metrics, patch
from gridspark.operators.feeds import spot_price
from gridspark.operators.quantile import stable_hash
from gridspark.session import scratch_path
from gridspark.sinks.store import upsert, upsert_frame
from gridspark.sources.feeds import decode_hydrology
from gridspark.sources.store import read_store
from gridspark.sources.tables import nan_to_null
from gridspark.streaming.feeds import episode_stream, write_append, write_carried

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_patch_does_not_fan_out(spark):
    base = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    updates = spark.createDataFrame([(1, 2.0, 0), (1, 3.0, 1), (2, 9.0, 0), (2, None, 1)], "k int, v double, n int")
    assert sorted(patch.patch(base, updates, "k", ["v"], order="n").collect()) == [(1, 3.0), (2, None)]
    assert sorted(patch.patch(base, updates.orderBy("n"), "k", ["v"]).collect()) == [(1, 3.0), (2, 9.0)]
    assert sorted(patch.update_frame(base, updates, "k", order="n").collect()) == [(1, 3.0), (2, None)]
    assert sorted(patch.replace_feed(base, updates, "k", ["v"], order="n").collect()) == [(1, 3.0), (2, None)]


@pytest.mark.parametrize("policy, want", [("skip", 2.0), ("overwrite", None), ("default", -1.0)])
def test_last_row_of_a_key_decides(spark, policy, want):
    batch = spark.createDataFrame([(1, 2.0, 0), (1, None, 1)], "k int, v double, n int")
    one = patch.collapse_batch(batch, "k", "n", policy)
    store = spark.createDataFrame([(1, 5.0)], "k int, v double")
    got = upsert_frame(store, one, "k", null_policy=policy, default=-1.0).collect()
    assert [(r.k, r.v) for r in got] == [(1, want)]


def test_upsert_without_order_writes_each_key_once(spark, frame):
    path = scratch_path(spark, "store")
    batch = frame([("2024-01-01 00:00:00", 1.0), ("2024-01-01 00:00:00", 2.0)], "ts timestamp, v double")
    for _ in range(2):
        upsert(spark, path, batch, "ts")
    assert [r.v for r in read_store(spark, path).collect()] == [2.0]


def test_feed_order_settles_prices(frame):
    base = frame([("2024-01-01 00:00:00", None), ("2024-01-01 01:00:00", 4.0)], "ts timestamp, price double")
    feed = frame([("2024-01-01 00:00:00", 9.0, 1), ("2024-01-01 00:00:00", 3.0, 2)], "ts timestamp, price double, n int")
    got = spot_price(base, feed, "price", cubic=False, order="n").orderBy("ts").collect()
    assert [r.price for r in got] == [3.0, 4.0]


def test_hydrology_repeats_go_without_ids(spark):
    doc = '{"value": [{"Paikka_Id": "1", "Aika": "2024-01-01T00:00:00Z", "Arvo": "2"}, {"Paikka_Id": "1", "Aika": "2024-01-01T00:00:00Z", "Arvo": "3"}]}'
    assert [r.value for r in decode_hydrology(spark.createDataFrame([(doc,)], "payload string")).collect()] == [3.0]


def test_carry_keeps_the_seed_of_every_series(spark, frame):
    schema = "series_id string, ts timestamp, value double"
    batches = [
        [("A", "2024-01-01 01:00:00", 5.0), ("B", "2024-01-01 00:00:00", 7.0)],
        [("B", "2024-01-01 00:30:00", None), ("A", "2024-01-01 02:00:00", None)],
    ]
    folder, out, check = (scratch_path(spark, x) for x in ("in", "out", "check"))
    for k, rows in enumerate(batches):
        frame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        write_carried(stream, out, check, "series_id").awaitTermination()
    got = {(r.series_id, r.ts.strftime("%H:%M")): r.value for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == {("A", "01:00"): 5.0, ("B", "00:00"): 7.0, ("B", "00:30"): 7.0, ("A", "02:00"): 5.0}


def test_sample_is_exact(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("p"))
    assert {r.n for r in metrics.sampled_metrics(rows, "a", "p", ["id"], replicates=4, size=500).collect()} == {500}
    assert {r.n for r in metrics.sampled_metrics(rows.limit(60), "a", "p", ["id"], replicates=3, size=500).collect()} == {60}


def test_samples_sort_few_rows(spark, monkeypatch, capsys):
    """What the samples write is bounded by their size; a key of many rows is taken with a higher bound."""
    written = []
    keep = metrics.materialize
    monkeypatch.setattr(metrics, "materialize", lambda df, label: written.append(df) or keep(df, label))
    rows = spark.range(200_000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("p"))
    got = metrics.sampled_metrics(rows, "a", "p", ["id"], replicates=3, size=100).collect()
    assert {r.replicate: r.n for r in got} == {0: 100, 1: 100, 2: 100}
    assert len(written) == 1
    # Rows are filtered by their hash before anything sorts them.
    written[0].explain()
    assert "< 0.00115" in capsys.readouterr().out
    # The same rows as a sort of all of them.
    want = []
    for r in range(3):
        first = rows.orderBy(stable_hash("id", seed=r), "a", "p").limit(100)
        want.append(first.agg(F.avg(F.abs(F.col("a") - F.col("p")))).first()[0])
    assert [r.mae for r in sorted(got, key=lambda r: r.replicate)] == pytest.approx(want, abs=1e-12)
    # Three keys: most bounds hold no hash at first.
    same = rows.limit(3000).withColumn("id", F.col("id") % 3)
    written.clear()
    assert {r.n for r in metrics.sampled_metrics(same, "a", "p", ["id"], replicates=4, size=500).collect()} == {500}
    assert len(written) > 1
    assert metrics.sampled_metrics(rows.limit(0), "a", "p", ["id"]).collect() == []


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "v double")
    assert nan_to_null(df).agg(F.avg("v")).first()[0] == 2.0


def test_workers_need_no_package():
    """Started from another folder, with the package on the driver's path only."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from gridspark.session import local_session; "
        "s = local_session('2', 2); print('rows', e.queries()['w5_cubic_interpolation'](s, '/root/testdata/sf0.001').count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=600)
    assert "rows " in done.stdout, done.stderr[-2000:]


def test_a_gap_of_decades_is_emitted_in_stretches(spark):
    from pyspark.sql import functions as F

    from gridspark.operators import interval, spine

    ends = [("s", "1990-01-01 00:00:00", 0.0), ("s", "2030-01-01 00:00:00", 100.0), ("t", "2000-01-01 00:00:00", 1.0)]
    rows = spark.createDataFrame(ends, "series_id string, at string, value double").select("series_id", F.to_timestamp("at").alias("ts"), "value")
    hours = 40 * 365 * 24 + 10 * 24
    for grid in (spine.complete_grid(rows, "series_id"), spine.densify(rows, "value", "series_id")):
        got = grid.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ts").alias("d"), F.min("ts").alias("a"), F.max("ts").alias("z"), F.max("value").alias("v"))
        assert {r.series_id: (r.n, r.d, r.a.year, r.z.year, r.v) for r in got.collect()} == {
            "s": (hours + 1, hours + 1, 1990, 2030, 100.0), "t": (1, 1, 2000, 2000, 1.0)
        }
    both = spine.complete_grid(rows, "series_id", start="1999-12-31 22:00:00", end="2000-01-01 03:00:00").where("series_id = 't'")
    assert [r.ts.hour for r in both.orderBy("ts").collect()] == [22, 23, 0, 1, 2, 3]
    one = spark.createDataFrame([("1990-01-01 00:30:00", "2030-01-01 00:30:00")], "a string, b string").select(F.to_timestamp("a").alias("start"), F.to_timestamp("b").alias("end"))
    got = interval.interval_sum(one, F.lit(2.0)).agg(F.count(F.lit(1)), F.min("ts"), F.max("ts"), F.sum("amount")).first()
    assert got[0] == hours and (got[1].hour, got[2].hour) == (1, 0) and got[3] == 2.0 * hours


def test_hot_keys_alone_are_copied(spark):
    from pyspark.sql import functions as F

    from gridspark.operators import buckets

    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    small = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = buckets.hot_salted_join(big, small, "k", hot_rows=500, salts=4)
    assert sorted(map(tuple, got.collect())) == sorted((k, v, 2 * k) for v in range(3000) for k in [1 if v % 3 == 0 else v])


def test_pair_documents_hold_one_pair_an_hour(spark):
    import json

    from pyspark.sql import functions as F

    from gridspark.sinks import publish

    rows = [("s", f"2026-01-01 {h:02d}:{m:02d}:00", float(10 * h + m)) for h in range(3) for m in (0, 20, 40)] + [("s", "2026-01-01 02:40:00", 1.0), ("s", "2026-02-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "k string, at string, v double").select("k", F.to_timestamp("at").alias("ts"), "v")
    got = {r.month.month: json.loads(r.payload) for r in publish.pair_documents(df, "v", "k").collect()}
    assert [p[1] for p in got[1]] == [40.0, 50.0, 60.0] and len(got[2]) == 1
