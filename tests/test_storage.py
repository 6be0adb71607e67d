"""Store upserts, archive on storage, published files, feeds from files, streams."""

import json
import os
import tempfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gridspark.operators import archive as ar
from gridspark.operators.quality import QualityError
from gridspark.session import materialize, shared_dir
from gridspark.sinks import publish
from gridspark.sinks.archive import Archive
from gridspark.sinks.store import append_model_stats, model_stats, update_existing, upsert, write_store
from gridspark.sources import feeds
from gridspark.sources.store import lookup, read_store
from gridspark.streaming import feeds as st

H = ["2026-01-01 00:00:00", "2026-01-01 01:00:00", "2026-01-02 02:00:00"]
UTC = timezone.utc


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_upsert_on_storage(spark, frame, folder):
    path = f"{folder}/store"
    schema = "ts timestamp, a double, b double"
    assert upsert(spark, path, frame([(H[0], 1.0, 2500.0), (H[2], 3.0, None)], schema)).inserted == 2
    r = upsert(spark, path, frame([(H[0], 9.0, None), (H[1], 5.0, 5.0)], schema))
    assert (r.inserted, r.updated) == (1, 1)
    want = {(H[0], 9.0, 2500.0), (H[1], 5.0, 5.0), (H[2], 3.0, None)}
    assert {(str(x.ts), x.a, x.b) for x in read_store(spark, path).collect()} == want
    r = upsert(spark, path, frame([(H[0], 9.0, None), (H[1], 5.0, 5.0)], schema))
    assert (r.inserted, r.updated) == (0, 2)
    assert {(str(x.ts), x.a, x.b) for x in read_store(spark, path).collect()} == want


def test_upsert_adds_columns_and_applies_repeats_in_order(spark, frame, folder):
    path = f"{folder}/store"
    upsert(spark, path, frame([(H[0], 1.0)], "ts timestamp, a double"))
    batch = frame([(H[0], 1, 2.0, 7.0), (H[0], 2, None, 8.0), (H[0], 3, 4.0, None)], "ts timestamp, n int, a double, c double")
    upsert(spark, path, batch, order="n")
    assert [(x.a, x.c) for x in read_store(spark, path).collect()] == [(4.0, 8.0)]


def test_update_existing_lets_nulls_through(frame):
    store = frame([(H[0], 1.0), (H[1], 2.0)], "ts timestamp, a double")
    batch = frame([(H[0], None), (H[2], 5.0)], "ts timestamp, a double")
    assert {(str(r.ts), r.a) for r in update_existing(store, batch, "ts", ["a"]).collect()} == {(H[0], None), (H[1], 2.0)}


def test_lookup(frame):
    store = frame([(H[0], 1.0), (H[1], 2.0)], "ts timestamp, a double")
    keys = frame([(H[1],), (H[1],), (H[2],)], "ts timestamp")
    assert [r.a for r in lookup(store, keys).collect()] == [2.0, 2.0]
    assert lookup(store, keys.limit(0)).count() == 0


def test_store_scan_prunes_dates(spark, frame, folder):
    write_store(frame([(h, 1.0) for h in H], "ts timestamp, a double"), f"{folder}/s")
    plan = read_store(spark, f"{folder}/s").where("date = DATE'2026-01-02'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(date" in plan._jdf.queryExecution().toString()


def test_archive(spark, frame, folder):
    a = Archive(spark, folder)
    schema = "ts timestamp, predicted double, actual double"
    assert a.insert_snapshot(frame([(H[0], 4.0, 3.0), (H[1], 5.0, None)], schema), datetime(2026, 1, 1, tzinfo=UTC)) == 1
    assert json.loads(a.runs().first().columns_json) == ["ts", "predicted", "actual"]
    assert [(r.actual, r.source) for r in a.actuals().collect()] == [(3.0, "run 1")]
    for bad, cols in (
        ([(H[0], 1.0, None), (H[0], 2.0, None)], schema),
        ([(None, 1.0, None)], schema),
        ([(H[0], None, None)], schema),
        ([], schema),
        ([(H[0], 1.0, [1.0])], "ts timestamp, predicted double, nested array<double>"),
        ([(H[0], 1.0)], "ts timestamp, other double"),
    ):
        with pytest.raises(QualityError):
            a.insert_snapshot(frame(bad, cols))
    assert a.runs().count() == 1 and a.predictions().count() == 2
    assert a.insert_snapshot(frame([(H[0], 6.0, 3.5, 1.0)], schema + ", extra double"), datetime(2026, 1, 2, tzinfo=UTC)) == 2
    assert a.predictions().where("extra IS NULL").count() == 2
    assert [r.actual for r in a.actuals().collect()] == [3.5]
    a.sync_actuals(frame([(H[0], 3.25)], "ts timestamp, price double"), "price", datetime(2026, 1, 3, tzinfo=UTC))
    scored = ar.get_predictions(a.runs(), a.predictions(), a.actuals(), frame([(H[0],)], "ts timestamp"))
    assert {(r.run_id, r.actual) for r in scored.collect()} == {(1, 3.25), (2, 3.25)}
    ranges = frame([(1, H[0], H[0]), (2, H[2], H[2])], "range_id int, start timestamp, end timestamp")
    got = {r.range_id: r.mae for r in ar.range_errors(a.predictions(), a.actuals(), ranges).collect()}
    assert got == {1: pytest.approx((0.75 + 2.75) / 2), 2: None}
    assert [(r.run_id, r.prediction_count) for r in ar.run_info(a.runs(), a.predictions()).collect()] == [(2, 1), (1, 2)]


def test_unfinished_snapshot_is_invisible(spark, frame, folder):
    a = Archive(spark, folder)
    rows = frame([(H[0], 4.0)], "ts timestamp, predicted double")
    a.insert_snapshot(rows, datetime(2026, 1, 1, tzinfo=UTC))
    rows.withColumn("run_id", F.lit(2)).write.mode("append").partitionBy("run_id").parquet(f"{folder}/predictions")
    assert a.predictions().count() == 1
    assert a.insert_snapshot(rows, datetime(2026, 1, 2, tzinfo=UTC)) == 3


def test_migration(spark, frame, folder):
    a = Archive(spark, folder)
    a.insert_snapshot(frame([(H[0], 4.0)], "ts timestamp, predicted double"), datetime(2026, 1, 1, tzinfo=UTC))
    source = frame([(H[0], 1.0, 2)], "ts timestamp, wind double, holiday int")
    dry = a.migrate(source, dry_run=True)
    assert dry["missing_columns"] == ["holiday", "wind"] and "wind" not in a.predictions().columns
    done = a.migrate(source)
    assert done["rows_before"] == done["rows_after"] == 1 and "wind" in a.predictions().columns
    assert a.migrate(source)["missing_columns"] == []


def test_model_stats(spark, frame, folder):
    for d, mae in ((H[0], 1.0), (H[2], 2.0)):
        append_model_stats(frame([(d, mae)], "training_timestamp timestamp, mae double"), f"{folder}/m")
    assert [r.mae for r in model_stats(spark, f"{folder}/m").collect()] == [2.0, 1.0]
    assert [r.mae for r in model_stats(spark, f"{folder}/m", H[0]).collect()] == [1.0]


def test_snapshots(spark, frame, folder):
    rows = frame([(H[0], 1.0)], "ts timestamp, value double")
    for day, v in (("2026-01-01", 1.0), ("2026-01-02", 2.0), ("2026-01-01", 3.0)):
        publish.write_snapshot(rows.withColumn("value", F.lit(v)), f"{folder}/s", F.lit(day))
    back = spark.read.schema("ts timestamp, value double, snapshot_date string").parquet(f"{folder}/s")
    assert {(r.snapshot_date, r.value) for r in back.collect()} == {("2026-01-01", 3.0), ("2026-01-02", 2.0)}
    odd = back.unionByName(rows.withColumn("snapshot_date", F.lit("notes")))
    assert [r.snapshot_date for r in publish.retained_snapshots(odd, 1).collect()] == ["2026-01-02"]


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_price_file(spark, folder):
    write(folder, "p/prices.json", json.dumps({"prices": [{"date": "2026-01-01T00:00:00.000Z", "value": 55.5}, {"date": "bad", "value": 1}]}, indent=1))
    got = feeds.decode_prices(feeds.read_documents(spark, f"{folder}/p")).collect()
    assert [(str(r.ts), r.price, r.document) for r in got] == [(H[0], pytest.approx(5.55), "prices")]


def test_empty_feed_is_typed(spark, folder):
    write(folder, "p/empty.json", '{"prices": []}')
    out = feeds.decode_prices(feeds.read_documents(spark, f"{folder}/p"))
    assert out.count() == 0 and dict(out.dtypes)["ts"] == "timestamp"


def test_station_xml_file(spark, folder):
    el = "<BsWfs:BsWfsElement><BsWfs:Time>{}</BsWfs:Time><BsWfs:ParameterName>{}</BsWfs:ParameterName><BsWfs:ParameterValue>{}</BsWfs:ParameterValue></BsWfs:BsWfsElement>"
    body = "".join(el.format(*r) for r in [("2026-01-01T00:00:00Z", "T", "-3.5"), ("2026-01-01T00:00:00Z", "W", "NaN"), ("2026-01-01T01:00:00Z", "W", "7")])
    write(folder, "x/101_forecast.xml", f'<?xml version="1.0"?><wfs:Col xmlns:wfs="a" xmlns:BsWfs="b">{body}</wfs:Col>')
    wide = feeds.station_wide(feeds.read_station_xml(spark, f"{folder}/x"), ["T", "W"]).orderBy("ts").collect()
    assert [(r.station, str(r.ts), r.T, r.W, r.repeats) for r in wide] == [("101", H[0], -3.5, None, 1), ("101", H[1], None, 7.0, 1)]


def test_station_csv_takes_the_id_from_the_file(spark, folder):
    write(folder, "c/101.csv", "time,value\n2026-01-01T00:10:00Z,1\n2026-01-01T00:50:00Z,3\n2026-01-01T02:00:00Z,6\n")
    got = feeds.read_station_csv(spark, f"{folder}/c", "time string, value string", "value").orderBy("ts").collect()
    assert [(r.series_id, r.value) for r in got] == [("101", 2.0), ("101", 4.0), ("101", 6.0)]


def test_parallel_arrays_file(spark, folder):
    doc = {"latitude": 1, "hourly": {"time": ["2026-01-01T00:00", "2026-01-01T01:00"], "r": [-1.0, None]}}
    write(folder, "a/EE.json", json.dumps(doc))
    docs = feeds.read_documents(spark, f"{folder}/a")
    assert [r.value for r in feeds.decode_arrays(docs, "r", clip_negative=True).orderBy("ts").collect()] == [0.0, None]


def test_border_flows_latest_document_wins(frame):
    doc = lambda v: json.dumps({"data": [{"dateTimeUtc": "2026-01-01T00:00:00Z", "border_SE1_FI": v, "border_SE3_FI": None, "border_EE_FI": 3}]})
    out = feeds.decode_border_flows(frame([(1, doc(5)), (2, doc(6))], "n int, payload string"), "n").collect()
    assert {(r.border, r.value) for r in out} == {("SE1_FI", 6.0), ("EE_FI", 3.0)}


@pytest.mark.parametrize("day, hours", [("2025-03-30", 23), ("2025-10-26", 25), ("2025-06-01", 24)])
def test_holiday_hours(frame, day, hours):
    days = frame([(day, 2)], "date string, kind_id int").withColumn("date", F.to_date("date"))
    assert feeds.holiday_hours(days, "Europe/Helsinki").count() == hours
    assert feeds.holiday_hours(days, "Europe/Helsinki", legacy_24h=True).count() == 24


def test_outage_cleaning(frame):
    schema = "start timestamp, end timestamp, avail_qty string, nominal_power string, plant_type string, businesstype string, docstatus string, resolution string"
    good = (H[0], H[2], "1", "2", "Nuclear", "Unplanned outage", None, "PT60M")
    rows = [good, good[:6] + ("Cancelled", "PT60M"), good[:4] + ("Wind",) + good[5:], good[:7] + ("PT15M",)]
    assert feeds.clean_outages(frame(rows, schema)).count() == 1


def test_shared_folder_is_read_from_the_session(spark, frame):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(frame([(H[0], 1.0)], "ts timestamp, a double"), "t")
    assert df.inputFiles()[0].replace("file://", "").startswith(shared_dir(spark))


def landing(spark, frame, folder, batches):
    for i, rows in enumerate(batches):
        frame(rows, "series_id string, ts timestamp, n long, value double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema("series_id string, ts timestamp, n long, value double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_stream_upsert_replayed_is_the_same(spark, frame, folder):
    batches = [[("s", H[0], 1, 5.0), ("s", H[0], 2, None)], [("s", H[0], 3, 6.0), ("s", H[1], 4, 7.0)]]
    stream = landing(spark, frame, folder, batches).select("series_id", "ts", "n", "value")
    for check in ("c1", "c2"):
        st.write_upsert(stream, f"{folder}/out", f"{folder}/{check}", ["series_id", "ts"], "n").awaitTermination()
        got = {(str(r.ts), r.value) for r in read_store(spark, f"{folder}/out").collect()}
        assert got == {(H[0], 6.0), (H[1], 7.0)}


def test_stream_carry_crosses_batches(spark, frame, folder):
    batches = [[("s", H[0], 1, 5.0)], [("s", H[1], 2, None), ("s", H[2], 3, 8.0)]]
    stream = landing(spark, frame, folder, batches)
    st.write_carried(stream, f"{folder}/out", f"{folder}/c", "series_id").awaitTermination()
    got = spark.read.parquet(f"{folder}/out/rows").orderBy("ts").collect()
    assert [r.value for r in got] == [5.0, 5.0, 8.0]


def test_stream_drops_late_hours(spark, frame, folder):
    batches = [[("s", "2026-01-01 00:10:00", 1, 1.0), ("s", "2026-01-01 09:00:00", 2, 1.0)], [("s", "2026-01-01 10:00:00", 5, 1.0)], [("s", "2026-01-01 00:20:00", 3, 99.0), ("s", "2026-01-01 20:00:00", 4, 1.0)]]
    stream = st.hourly_mean_stream(landing(spark, frame, folder, batches), "series_id")
    st.write_append(stream, f"{folder}/out", f"{folder}/c").awaitTermination()
    got = {str(r.ts): r.value for r in spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()}
    assert got == {f"2026-01-01 {h}:00:00": 1.0 for h in ("00", "09", "10")}


def test_documents_with_many_elements(spark):
    element = "<wfs:member><BsWfs:BsWfsElement gml:id='e{0}'><BsWfs:Time>2026-01-01T0{0}:00:00Z</BsWfs:Time><BsWfs:ParameterName>{1}</BsWfs:ParameterName><BsWfs:ParameterValue>{2}</BsWfs:ParameterValue></BsWfs:BsWfsElement></wfs:member>"
    whole = "<?xml version='1.0'?><wfs:FeatureCollection numberMatched='3' xmlns:wfs='w' xmlns:BsWfs='b' xmlns:gml='g'>" + "".join(
        element.format(*e) for e in [(0, "temperature", "1.5"), (1, "temperature", "NaN"), (1, "wind", "4")]
    ) + "<wfs:member/></wfs:FeatureCollection>"
    docs = spark.createDataFrame([(7, whole), (8, "<wfs:FeatureCollection/>"), (9, "no xml <"), (10, None)], "station int, payload string")
    got = feeds.decode_station_documents(docs).collect()
    assert sorted((r.station, r.ts.hour, r.parameter, r.value) for r in got if r.value is not None) == [(7, 0, "temperature", 1.5), (7, 1, "wind", 4.0)]
    assert len(got) == 3


def test_named_files(spark, folder):
    rows = spark.createDataFrame([(f"s{k % 3}", k, f"x{k}") for k in range(30)], "name string, n int, v string").repartition(5)
    publish.write_named_csv(rows, f"{folder}/named", "name")
    for k in range(3):
        back = spark.read.csv(f"{folder}/named/s{k}.csv", header=True, schema="n int, v string")
        assert sorted(r.n for r in back.collect()) == list(range(k, 30, 3))
