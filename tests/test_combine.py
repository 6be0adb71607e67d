"""Patches, dedup, capacity totals, quantiles, ranks, checks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.operators import feeds, patch, quality, rollup, weather
from gridspark.operators.buckets import salted_join
from gridspark.operators.interval import available_capacity, range_totals
from gridspark.operators.metrics import classifier_metrics, forecast_evaluation, spearman
from gridspark.operators.quantile import exact_quantiles, global_average_rank, iqr_filter, quantile_clip, quantile_values
from gridspark.sinks.store import upsert_frame

H = ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-01 02:00:00"]


def test_old_wins(frame):
    df = frame([(1, 1.0, None), (2, None, 2.5), (3, 3.0, 3.5)], "k int, v_x double, v_y double")
    assert [r.v for r in patch.coalesce_suffixed(df).orderBy("k").collect()] == [1.0, 2.5, 3.0]


@pytest.mark.parametrize("prefer, want", [("old", [1.0, 2.5, 3.0]), ("new", [1.0, 2.5, 3.5])])
def test_patch(frame, prefer, want):
    base = frame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    new = frame([(1, None), (2, 2.5), (3, 3.5)], "k int, v double")
    assert [r.v for r in patch.patch(base, new, "k", ["v"], prefer=prefer).orderBy("k").collect()] == want


def test_patch_refuses_bad_calls(frame):
    base = frame([(1, 1.0)], "k int, v double")
    for bad in (dict(keys="x", columns=["v"]), dict(keys="k", columns=[]), dict(keys="k", columns=["w"])):
        with pytest.raises(ValueError):
            patch.patch(base, base, **bad)


def test_update_frame_adds_nothing(frame):
    base = frame([(1, 1.0), (2, 2.0)], "k int, v double")
    other = frame([(2, 9.0, 1.0), (3, 9.0, 1.0)], "k int, v double, extra double")
    out = patch.update_frame(base, other, "k")
    assert out.columns == ["k", "v"] and sorted((r.k, r.v) for r in out.collect()) == [(1, 1.0), (2, 9.0)]


def test_dedup_is_deterministic_on_equal_order(frame):
    df = frame([("k", 1, v) for v in (3.0, 9.0, 5.0)], "k string, o int, v double")
    assert {patch.dedup(df.repartition(n), "k", "o").first().v for n in (1, 2, 3)} == {9.0}


def test_total_capacity_repeats_last_nonzero(frame):
    rows = [(H[i], b, v) for i, vs in enumerate(((100.0, 200.0, 300.0), (0.0, 0.0, 0.0))) for b, v in zip(("x", "y", "z"), vs)]
    out = rollup.total_capacity(frame(rows, "ts timestamp, border string, value double"), ["x", "y", "z"]).orderBy("ts").collect()
    assert [r.total for r in out] == [600.0, 600.0] and (out[1].x, out[1].y, out[1].z) == (0.0, 0.0, 0.0)


def test_import_capacity(frame):
    rows = [(H[0], "x", 100.0), (H[0], "y", 200.0), (H[0], "z", 300.0), (H[1], "x", 120.0), (H[1], "y", 240.0), (H[1], "z", 360.0)]
    out = feeds.import_capacity(frame([(h, 7.0) for h in H[:2]], "ts timestamp, other double"), frame(rows, "ts timestamp, border string, value double"), ["x", "y", "z"]).orderBy("ts").collect()
    assert [r.import_capacity for r in out] == [600.0, 720.0] and [r.other for r in out] == [7.0, 7.0]


def test_station_series_prefers_forecast_and_store(frame):
    base = frame([("s", H[0], 5.0), ("s", H[1], None), ("s", H[2], None)], "series_id string, ts timestamp, t double")
    fc = frame([("s", H[0], 1.0), ("s", H[1], 2.0)], "series_id string, ts timestamp, value double")
    hist = frame([("s", H[1], 8.0), ("s", H[2], 9.0)], "series_id string, ts timestamp, value double")
    assert [r.t for r in feeds.station_series(base, fc, hist, "t", "series_id").orderBy("ts").collect()] == [5.0, 2.0, 9.0]


def test_merge_actual_forecast(frame):
    a = frame([(H[1], 10.0), (H[2], 11.0)], "ts timestamp, value double")
    f = frame([(H[0], 9.0), (H[1], 12.0), (H[2], float("nan"))], "ts timestamp, value double")
    assert [r.value for r in patch.merge_actual_forecast(a, f, "ts").orderBy("ts").collect()] == [9.0, 10.0, 11.0]


def test_all_zero_backup_is_no_information(frame):
    p = frame([(H[0], None)], "ts timestamp, value double")
    zero = frame([(H[0], 0.0), (H[1], 0.0)], "ts timestamp, value double")
    assert [r.value for r in patch.primary_or_backup(p, zero, "ts").collect()] == [None, None]


def test_upsert_keeps_old_value_on_null(frame):
    store = frame([(1, 2500.0, 1.0)], "k int, a double, b double")
    batch = frame([(1, None, 9.0), (2, 5.0, None)], "k int, a double, b double")
    out = {r.k: (r.a, r.b, r._change) for r in upsert_frame(store, batch, "k").collect()}
    assert out == {1: (2500.0, 9.0, "updated"), 2: (5.0, None, "inserted")}
    again = upsert_frame(upsert_frame(store, batch, "k").drop("_change"), batch, "k")
    assert {r.k: (r.a, r.b) for r in again.collect()} == {k: v[:2] for k, v in out.items()}


def test_overlapping_outages_add_up(frame):
    grid = frame([(h,) for h in H], "ts timestamp")
    out = frame(
        [(H[0], H[2], 100.0, 900.0), ("2024-01-01 00:30:00", "2024-01-01 01:30:00", 0.0, 400.0)],
        "start timestamp, end timestamp, avail_qty double, nominal_power double",
    )
    got = [r.capacity for r in available_capacity(grid, out).orderBy("ts").collect()]
    assert got == [4372.0 - 800.0, 4372.0 - 800.0 - 400.0, 4372.0]


def test_range_totals_brute_force(frame):
    rng = random.Random(1)
    ts = [str(t) for t in pd.date_range("2024-01-01", periods=400, freq="h")]
    rows = [(rng.choice(ts), float(rng.randint(1, 9))) for _ in range(2000)]
    ranges = []
    for i in range(40):
        a, b = sorted((rng.randrange(400), rng.randrange(400)))
        ranges.append((i, ts[a], ts[b]))
    ranges.append((99, "2030-01-01 00:00:00", "2030-01-02 00:00:00"))
    got = {r.range_id: r.s for r in range_totals(frame(ranges, "range_id int, start timestamp, end timestamp"), frame(rows, "ts timestamp, v double"), {"s": F.col("v")}).collect()}
    want = {i: sum(v for t, v in rows if a <= t <= b) or None for i, a, b in ranges}
    assert got == want


@pytest.mark.parametrize("accuracy", [20, 200])
def test_exact_quantiles_with_a_hot_group(frame, accuracy):
    """A coarse sketch still gives the exact answer; one group holds most rows, ties abound."""
    rng, rows = random.Random(2), []
    for g, n in (("hot", 6000), ("small", 7), ("one", 1)):
        rows += [(g, float(rng.choice([rng.randint(0, 5), rng.gauss(0, 100)]))) for _ in range(n)]
    probs = [0.0, 0.0008, 0.1, 0.25, 0.5, 0.9995, 1.0]
    df = frame(rows + [("hot", None)], "g string, v double")
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))] for r in exact_quantiles(df, "v", probs, "g", slices=accuracy // 10).collect()}
    for g in ("hot", "small", "one"):
        np.testing.assert_allclose(got[g], np.quantile([v for k, v in rows if k == g], probs), rtol=1e-12)
    whole = quantile_values(df, "v", probs, accuracy=accuracy)
    np.testing.assert_allclose(whole, np.quantile([v for _, v in rows], probs), rtol=1e-12)
    assert quantile_values(df.where("v IS NULL"), "v", [0.5]) == [None]


def test_average_ranks_and_spearman(frame):
    rng = random.Random(4)
    rows = [(float(rng.randint(0, 30)), rng.gauss(0, 1)) for _ in range(3000)]
    df = frame(rows, "a double, b double")
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    got = {r.a: r["rank"] for r in global_average_rank(df, "a", slices=8).collect()}
    want = dict(zip(pdf["a"], pdf["a"].rank()))
    assert got == want
    want_s = np.corrcoef(pdf["a"].rank(), pdf["b"].rank())[0, 1]
    assert spearman(df, "a", "b").first()[0] == pytest.approx(want_s, abs=1e-12)


def test_clip_and_iqr(frame):
    v = list(np.random.default_rng(0).normal(size=500)) + [50.0, -60.0]
    df = frame([(float(x),) for x in v] + [(None,)], "v double")
    lo, hi = np.quantile(v, [0.01, 0.99])
    got = sorted(r.v for r in quantile_clip(df, "v", 0.01, 0.99).collect() if r.v is not None)
    np.testing.assert_allclose(got, np.sort(np.clip(v, lo, hi)))
    q1, q3 = np.quantile(v, [0.25, 0.75])
    assert iqr_filter(df, "v").count() == sum(q1 - 2.5 * (q3 - q1) <= x <= q3 + 2.5 * (q3 - q1) for x in v)


def test_salted_join_keeps_every_row(frame):
    big = frame([("hot", i) for i in range(500)] + [("k", 1)], "k string, i int")
    small = frame([("hot", 1.0), ("k", 2.0)], "k string, m double")
    out = salted_join(big, small, "k", salts=4)
    assert out.count() == 501 and out.where("k = 'hot'").agg(F.sum("m")).first()[0] == 500.0


def test_classifier_metrics(frame):
    df = frame([(True, 0.9), (True, 0.4), (False, 0.4), (False, 0.1), (False, 0.7)], "y boolean, s double")
    r = classifier_metrics(df, "y", "s").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 2)
    assert r.auc == pytest.approx((3 + 1.5) / 6) and r.accuracy == pytest.approx(0.6)


def test_evaluation_of_zero_pairs(frame):
    df = frame([("2024-01-01 00:00:00", 0.0, 0.0), ("2024-01-01 01:00:00", 2.0, 1.0)], "ts timestamp, a double, p double")
    r = forecast_evaluation(df, "a", "p").first()
    assert r.smape == pytest.approx(2 * (1 / 3) * 100) and r.mae == 0.5


def test_daily_wind_level_counts_long_calm(frame):
    rows = [(str(t), 800.0 if i < 18 else 2400.0) for i, t in enumerate(pd.date_range("2026-01-14 22:00", periods=24, freq="h"))]
    assert [r.wind_level for r in weather.daily_wind_level(frame(rows, "ts timestamp, wind double")).collect()] == ["calm"]


def test_representative_condition_prefers_severe_on_ties(frame):
    rows = [("2026-01-15 10:00:00", s) for s in (1.0, 1.0, 32.0, 32.0)] + [("2026-01-15 03:00:00", 64.0)] * 9
    assert weather.representative_condition(frame(rows, "ts timestamp, symbol double")).first().condition == "rain"


def test_daily_weather_record(frame):
    days = pd.date_range("2026-01-14 22:00", periods=48, freq="h")
    winds = frame([(str(t), 500.0 if i < 24 else 4000.0) for i, t in enumerate(days)], "ts timestamp, wind double")
    symbols = frame([(str(t), 2.0) for t in days for _ in range(4)], "ts timestamp, symbol double")
    out = weather.daily_weather(symbols, winds, F.lit("2026-01-15 08:00:00").cast("timestamp")).orderBy("noon_ms").collect()
    assert [(r.condition, r.wind_level) for r in out] == [("partly-cloudy-day", "calm"), ("partly-cloudy-day", "strong")]
    assert out[0].noon_ms == pd.Timestamp("2026-01-15 10:00:00", tz="UTC").value // 10**6


def test_quality_guards(frame):
    df = frame([(H[0], 1.0), (H[0], 2.0), (None, None)], "ts timestamp, predicted double")
    got = {r.violation for r in quality.snapshot_violations(df, "ts", ["predicted"]).collect()}
    assert got == {"null_ts", "null_predicted", "repeated_key"}
    assert {r.violation for r in quality.snapshot_violations(df.limit(0), "ts", ["predicted"]).collect()} == {"empty"}
    with pytest.raises(quality.QualityError):
        quality.require_columns(df, ["nope"])
    with pytest.raises(quality.QualityError):
        quality.require_storable(df.withColumn("a", F.array("predicted")))
    with pytest.raises(quality.QualityError):
        quality.require_empty(quality.nulls_after_join(df, ["predicted"]), "nulls")


def test_gap_plan_on_an_empty_slice(frame):
    store = frame([("s", h, None, None) for h in H], "series_id string, ts timestamp, t double, ws double")
    cand = frame([("s", h, 1.0, 2.0) for h in H], "series_id string, ts timestamp, t double, ws double")
    lit = lambda x: F.lit(x).cast("timestamp")
    updates, ranges, summary = quality.gap_plan(store, cand, "series_id", ["t", "ws"], lit(H[0]), lit("2030-01-01 00:00:00"), lit(H[2]))
    assert updates.count() == 3
    assert sorted((r.column_name, r.filled, r.expected) for r in summary.collect()) == [("t", 3, 3), ("ws", 3, 3)]
    assert [(r.hours) for r in ranges.collect()] == [3]


def test_sample_windows_are_seeded():
    lo, hi = pd.Timestamp("2024-01-01"), pd.Timestamp("2024-03-01")
    assert quality.sample_windows(lo, hi, 7, 3, 1) == quality.sample_windows(lo, hi, 7, 3, 1)
    assert quality.sample_windows(lo, hi, 365, 3, 1) == [(lo, hi)]
    assert all(lo <= a and b <= hi for a, b in quality.sample_windows(lo, hi, 7, 20, 2))


def test_volatility_mapping(frame):
    hours = frame([(f"2024-01-0{d} 0{h}:00:00",) for d in (1, 2) for h in (0, 1)], "ts timestamp")
    daily = frame([("2024-01-01", 0.1), ("2024-01-02", 0.9)], "date string, p double").withColumn("date", F.to_date("date"))
    assert [r.p for r in feeds.volatility_to_hours(hours, daily, "p").orderBy("ts").collect()] == [0.1, 0.1, 0.9, 0.9]


def test_wind_power_model_fills_only_gaps(frame):
    frame_ = frame([(h, 0.0) for h in H], "ts timestamp, wind double")
    real = frame([(H[0], 10.0)], "ts timestamp, value double")
    fc = frame([(H[1], 20.0)], "ts timestamp, value double")
    cap = frame([(H[0], 100.0)], "ts timestamp, value double")
    out = feeds.wind_power(frame_, real, fc, cap, H[0], lambda d: d.withColumn("share", F.lit(0.3)))
    assert [r.wind for r in out.orderBy("ts").collect()] == [10.0, 20.0, 30.0]


def test_holidays_default_to_zero(frame):
    f = frame([(H[0], 5), (H[1], None), (H[2], None)], "ts timestamp, holiday int")
    cal = frame([(H[0], 1), (H[1], 2)], "ts timestamp, holiday int")
    assert [r.holiday for r in feeds.holidays(f, cal).orderBy("ts").collect()] == [5, 2, 0]
