"""Grids, fills, windows: worked examples, and brute force on random series."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.operators import fill, risk, rollup, windows
from gridspark.operators.asof import asof_backward
from gridspark.operators.buckets import with_halo, with_position
from gridspark.operators.cubic import cubic_interpolate, second_derivatives
from gridspark.operators.spine import complete_grid, densify, forecast_spine, spine


def hours(n, start="2024-01-01"):
    return [str(t) for t in pd.date_range(start, periods=n, freq="h")]


@pytest.fixture(scope="module")
def gappy(frame):
    """Three series over 200 days with random holes; one is mostly empty."""
    rng, rows = random.Random(5), []
    for s, keep in (("a", 0.7), ("b", 0.05), ("c", 0.4)):
        for t in hours(4800):
            r = rng.random()
            if r < 0.85:
                rows.append((s, t, round(rng.uniform(-5, 50), 3) if rng.random() < keep else None))
    return frame(rows, "series_id string, ts timestamp, value double").repartition(7).cache()


def as_pandas(df):
    return df.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)


def by_series(df, fn):
    pdf = as_pandas(df)
    return pd.concat([g.assign(value=fn(g.set_index("ts")["value"]).to_numpy()) for _, g in pdf.groupby("series_id")]).reset_index(drop=True)


@pytest.mark.parametrize(
    "op, ref",
    [
        (fill.forward_fill, lambda s: s.ffill()),
        (fill.backward_fill, lambda s: s.bfill()),
        (fill.fill_edges, lambda s: s.ffill().bfill()),
        (fill.back_then_forward, lambda s: s.bfill().ffill()),
        (fill.interpolate, lambda s: s.interpolate(method="time", limit_direction="forward")),
        (fill.zero_to_last, lambda s: s.where(s != 0).ffill().combine_first(s)),
    ],
)
@pytest.mark.parametrize("bucket", ["1 day", "30 days", "4000 days"])
def test_fills_equal_pandas_whatever_the_bucket(gappy, op, ref, bucket):
    got = as_pandas(op(gappy, "value", "series_id", bucket=bucket))
    want = by_series(gappy, ref)
    np.testing.assert_allclose(got["value"].to_numpy(float), want["value"].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_fill_does_not_depend_on_partitioning(gappy):
    one = fill.interpolate(gappy.coalesce(1), "value", "series_id")
    many = fill.interpolate(gappy.repartition(31, "ts"), "value", "series_id")
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_positional_interpolation(gappy):
    got = as_pandas(fill.interpolate(with_position(gappy, "series_id", bucket="2 days"), "value", "series_id", at="pos"))
    want = by_series(gappy, lambda s: s.reset_index(drop=True).interpolate(limit_direction="forward"))
    np.testing.assert_allclose(got["value"].to_numpy(float), want["value"].to_numpy(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("start,end", [(None, None), ("2023-12-30 00:00:00", "2024-08-01 00:00:00")])
def test_complete_grid_equals_spine_join(gappy, start, end):
    got = complete_grid(gappy, "series_id", start=start, end=end, bucket="5 days")
    bounds = gappy.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = spine(
        bounds, "series_id",
        F.col("lo") if start is None else start, F.col("hi") if end is None else end, bucket="3 days",
    )
    want = grid.join(gappy, ["series_id", "ts"], "left").select("series_id", "ts", "value")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("method", ["linear", "forward"])
def test_densify_equals_grid_then_fill(gappy, method):
    got = as_pandas(densify(gappy, "value", "series_id", method=method, bucket="3 days"))
    grid = complete_grid(gappy.where("value IS NOT NULL"), "series_id")
    full = fill.interpolate(grid, "value", "series_id") if method == "linear" else fill.forward_fill(grid, "value", "series_id")
    want = as_pandas(full)
    assert list(got["ts"]) == list(want["ts"])
    np.testing.assert_allclose(got["value"], want["value"], rtol=1e-9)


def test_position_counts_across_buckets(gappy):
    got = as_pandas(with_position(gappy, "series_id", bucket="1 day"))
    assert (got.groupby("series_id").cumcount() == got["pos"]).all()


def test_halo_keeps_each_row_once(frame):
    df = frame([(i,) for i in range(100)], "i long")
    h = with_halo(df, "i", 10, before=2, after=3)
    assert h.where("_own").count() == 100
    seen = {r["_block"]: sorted(r["v"]) for r in h.groupBy("_block").agg(F.collect_list("i").alias("v")).collect()}
    assert seen[3] == list(range(28, 43))


def test_spine_range_not_on_bucket_edges(frame):
    s = frame([("a",)], "series_id string")
    got = [str(r.ts) for r in spine(s, "series_id", "2024-01-31 22:30:00", "2024-02-03 01:30:00", bucket="1 day").orderBy("ts").collect()]
    assert got == [str(t) for t in pd.date_range("2024-01-31 22:30", "2024-02-03 01:30", freq="h")]


def test_forecast_spine_ends_with_the_last_hour_of_the_day(frame):
    df = frame([("a", "2024-01-01 05:00:00"), ("a", "2023-12-01 00:00:00")], "series_id string, ts timestamp")
    got = [str(r.ts) for r in forecast_spine(df, "series_id", "2024-01-03 10:00:00").orderBy("ts").collect()]
    assert got[0] == "2024-01-01 05:00:00" and got[1] == "2024-01-03 11:00:00" and got[-1] == "2024-01-10 23:00:00"
    assert len(got) == 1 + 13 + 7 * 24


def test_hourly_mean_then_forward(frame):
    rows = frame([("n", "2024-01-01 00:00:00", 1000.0), ("n", "2024-01-01 00:30:00", 1010.0), ("n", "2024-01-01 01:00:00", 1020.0)], "series_id string, ts timestamp, value double")
    full = complete_grid(rollup.hourly_mean(rows, "series_id"), "series_id", end="2024-01-01 02:00:00")
    got = [r.value for r in fill.forward_fill(full, "value", "series_id").orderBy("ts").collect()]
    assert got == [1005.0, 1020.0, 1020.0]


def test_cubic_equals_dense_solve():
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.integers(1, 6, 40)).astype(float)
    y = rng.normal(size=40)
    m = second_derivatives(x, y)
    n, h, s = len(x), np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = [h[i - 1], 2 * (h[i - 1] + h[i]), h[i]]
        b[i] = 6 * (s[i] - s[i - 1])
    a[0, :3] = [-h[1], h[0] + h[1], -h[0]]
    a[-1, -3:] = [-h[-1], h[-2] + h[-1], -h[-2]]
    np.testing.assert_allclose(m, np.linalg.solve(a, b), rtol=1e-8, atol=1e-10)


def test_cubic_reproduces_cubics(frame):
    f = lambda i: 0.5 * i**3 - 4 * i**2 + i - 7
    rows = [("a", t, f(i) if i % 4 == 0 or i == 61 else None) for i, t in enumerate(hours(64))]
    got = cubic_interpolate(frame(rows, "series_id string, ts timestamp, value double"), "value", "series_id", bucket="1 day").orderBy("ts").collect()
    for i, r in enumerate(got):
        if i <= 61:
            assert r.value == pytest.approx(f(i), abs=1e-6)
        else:
            assert r.value is None


def test_cubic_chunks_equal_the_whole_series(gappy):
    whole = as_pandas(cubic_interpolate(gappy, "value", "series_id", chunk=100_000))
    parts = as_pandas(cubic_interpolate(gappy, "value", "series_id", chunk=100))
    np.testing.assert_allclose(parts["value"].to_numpy(float), whole["value"].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_moving_average(frame):
    df = frame([("a", t, float(i + 1)) for i, t in enumerate(hours(4))], "series_id string, ts timestamp, value double")
    got = [r.moving_average for r in windows.moving_average(df, 2, "series_id").orderBy("ts").collect()]
    assert got == [1.0, 1.5, 2.5, 3.5]


def test_moving_average_across_blocks(gappy):
    full = gappy.where("value IS NOT NULL")
    got = as_pandas(windows.moving_average(full, 24, "series_id", block=24))
    want = as_pandas(full).groupby("series_id")["value"].rolling(24, min_periods=1).mean().reset_index(drop=True)
    np.testing.assert_allclose(got["moving_average"], want, rtol=1e-9)


def test_cheapest_window_examples(frame):
    base = [("a", t, float(i + 1)) for i, t in enumerate(hours(8, "2025-01-14 00:00"))]
    df = frame(base, "series_id string, ts timestamp, value double")
    now = F.lit("2025-01-14 02:00:00").cast("timestamp")
    r = windows.cheapest_windows(df, now, "series_id", durations=(3,)).first()
    assert str(r.start) == "2025-01-14 00:00:00" and r.average == 2.0
    local = 2 + 3  # b + 3h in Helsinki winter time
    r = windows.cheapest_windows(df, now, "series_id", durations=(2,), start_hour=local, end_hour=local).first()
    assert str(r.start) == "2025-01-14 03:00:00"


def test_cheapest_window_brute_force(gappy):
    rows = as_pandas(gappy.where("value IS NOT NULL"))
    got = {(r.series_id, r.hours): (str(r.start), round(r.average, 6)) for r in windows.cheapest_windows(gappy, None, "series_id", durations=(2, 3)).collect()}
    want = {}
    for s, g in rows.groupby("series_id"):
        ts, v = list(g["ts"]), list(g["value"])
        for h in (2, 3):
            best = None
            for i in range(len(ts) - h + 1):
                if all((ts[j + 1] - ts[j]).total_seconds() == 3600 for j in range(i, i + h - 1)):
                    m = sum(v[i : i + h]) / h
                    if best is None or m < best[1] - 1e-12:
                        best = (str(ts[i]), m)
            if best:
                want[(s, h)] = (best[0], round(best[1], 6))
    assert got == want


def test_gap_islands(frame):
    have = ["2024-01-01 01:00:00", "2024-01-01 02:00:00", "2024-01-01 05:00:00", "2024-03-01 00:00:00"]
    df = frame([("a", t) for t in have], "series_id string, ts timestamp")
    got = [(str(r.gap_start), str(r.gap_end), r.hours) for r in windows.gap_islands(df, "series_id", start="2024-01-01 00:00:00", end="2024-03-01 02:00:00", bucket="1 day").orderBy("gap_start").collect()]
    assert got[0] == ("2024-01-01 00:00:00", "2024-01-01 00:00:00", 1)
    assert got[1] == ("2024-01-01 03:00:00", "2024-01-01 04:00:00", 2)
    assert got[2][:2] == ("2024-01-01 06:00:00", "2024-02-29 23:00:00")
    assert got[3] == ("2024-03-01 01:00:00", "2024-03-01 02:00:00", 2)


def test_asof_across_empty_buckets(gappy):
    """Left hours against sparse right points at odd minutes, buckets of a day."""
    right = gappy.where("value > 45").withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + 600))
    got = as_pandas(asof_backward(gappy.select("series_id", "ts"), right, "series_id", bucket="1 day"))
    l, r = as_pandas(gappy.select("series_id", "ts")).sort_values("ts"), right.toPandas().sort_values("ts")
    want = pd.merge_asof(l, r.rename(columns={"value": "want"}), on="ts", by="series_id").sort_values(["series_id", "ts"]).reset_index(drop=True)
    np.testing.assert_allclose(got["value"].to_numpy(float), want["want"].to_numpy(float))
    twice = gappy.select("series_id", "ts").unionByName(gappy.select("series_id", "ts"))
    again = asof_backward(twice, right, "series_id", bucket="1 day", unique_left=False)
    assert again.count() == 2 * len(got)
    assert again.select("series_id", "ts", "value").distinct().where("value IS NOT NULL").count() == got["value"].notna().sum()


def daily_prices(frame, prices, wind=500.0):
    rows = [(t, prices.get(i, 1.0), wind) for i, t in enumerate(hours(24, "2026-01-14 22:00"))]
    return frame(rows, "ts timestamp, price double, wind double")


def test_spike_risk_example(frame):
    df = daily_prices(frame, {8: 20.0, 9: 19.0, 10: 18.0, 19: 30.0, 20: 29.0, 21: 28.0})
    out = risk.spike_risk(df, F.lit("2026-01-10 00:00:00").cast("timestamp"))
    assert [r.local_hour for r in out.where("is_risk").orderBy("ts").collect()] == [8, 9, 19, 20]
    text = risk.risk_peak_per_day(out).collect()
    assert [(r.peak_hour, r.risk_text) for r in text] == [(19, "18–20")]


def test_top_hours_ignore_night(frame):
    df = daily_prices(frame, {5: 99.0, 22: 98.0, 6: 50.0, 8: 40.0, 16: 60.0, 19: 55.0})
    out = risk.top_price_hours(df, "price")
    assert {r.local_hour for r in out.where("is_top_hour").collect()} == {6, 8, 16, 19}


def test_short_half_gives_its_quota_away(frame):
    rows = [(t, float(i)) for i, t in enumerate(hours(16, "2026-01-15 09:00"))]  # 11:00 local on
    out = risk.top_price_hours(frame(rows, "ts timestamp, price double").where("ts < '2026-01-15 20:00:00'"), "price")
    assert [r.local_hour for r in out.where("is_top_hour").orderBy("ts").collect()] == [11, 20, 21]


def test_no_wind_column_means_no_risk(frame):
    df = daily_prices(frame, {8: 20.0}).drop("wind")
    out = risk.scale_prices(df, F.lit("2026-01-10 00:00:00").cast("timestamp"))
    assert out.where("is_risk OR price_scaled IS NOT NULL").count() == 0


def test_day_average_on_rows(frame):
    df = frame([("a", "2025-01-14 22:30:00", 10.0), ("a", "2025-01-14 23:00:00", 14.0), ("a", "2025-01-15 00:00:00", 30.0)], "series_id string, ts timestamp, value double")
    got = [r.day_average for r in rollup.local_day_average_on_rows(df, "series_id").orderBy("ts").collect()]
    assert got == [10.0, 22.0, 22.0]


def test_time_bins(frame):
    df = frame([(t, 10.0 * (i + 1)) for i, t in enumerate(hours(4, "2025-01-14 22:00"))], "ts timestamp, value double")
    got = rollup.time_bins(df, 2).orderBy("ts").collect()
    assert [r.value for r in got] == [15.0, 35.0]
    assert rollup.time_bins(df, 1).count() == 4


def test_electricity_day_summary(frame):
    df = frame([("2025-01-14 10:00:00", 9.0, 5.0, 1000.0, 4.0, 6.0), ("2025-01-14 11:00:00", None, 5.0, 2000.0, 4.0, 6.0)], "ts timestamp, actual double, predicted double, wind double, t_1 double, t_2 double")
    from gridspark.functions.scalar import row_mean

    m = {"price": F.coalesce("actual", "predicted"), "wind": F.col("wind"), "temperature": row_mean(["t_1", "t_2"])}
    r = rollup.electricity_day_summary(df, m).first()
    assert (r.price_avg, r.price_min, r.price_max, r.wind_avg, r.temperature_avg) == (7.0, 5.0, 9.0, 1500.0, 5.0)


def test_calendar_matrix_at_the_clock_changes(frame):
    autumn = frame([(t, float(i)) for i, t in enumerate(hours(25, "2025-10-25 21:00"))], "ts timestamp, value double")
    cells = {r.hour: r for r in windows.calendar_matrix(autumn).collect()}
    assert len(cells) == 24 and cells[3].price == 4.0 and cells[3].earlier_price == 3.0 and cells[4].price == 5.0
    spring = frame([(t, float(i)) for i, t in enumerate(hours(23, "2025-03-29 22:00"))], "ts timestamp, value double")
    cells = {r.hour: r for r in windows.calendar_matrix(spring).collect()}
    assert cells[3].price is None and cells[2].price == 2.0 and cells[4].price == 3.0


def test_horizon_prune(frame):
    df = frame([("r", t, 1.0) for t in hours(4)], "run_id string, ts timestamp, value double")
    assert windows.horizon_prune(df, 2).count() == 2
    assert windows.horizon_prune(df, None).count() == 4
